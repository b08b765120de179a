"""Incremental loading: raw rows that arrive as files are normalized once each and appended to a table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.normalize import RAW, normalize

RAW_SCHEMA = ", ".join(f"{c} string" for c in RAW)


def append_new_exports(spark: SparkSession, source: str, target: str, checkpoint: str, codes: dict[str, str]) -> StreamingQuery:
    """Normalize every new Parquet file of raw rows under `source` into `target`, then stop; a restart goes on where it ended."""
    raw = spark.readStream.schema(RAW_SCHEMA).parquet(source)
    return normalize(raw, codes).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
