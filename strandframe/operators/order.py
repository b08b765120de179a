"""Rows in the order of their files, and checks and writing of ordered tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed


def with_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): each line of text files with its number in its file, from 1.

    A file is read in blocks, each by one task from its start to its end. Lines are counted within a block, and
    the lines of the blocks before are added, so that no file passes through one task.
    """
    meta = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    # numbered once, as another run may deal blocks to other tasks
    rows = checkpointed(meta)
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    return rows.join(starts, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Parquet files with `file` and `line`, their number in it from 1, as the format itself has it."""
    frame = spark.read.parquet(path)
    return frame.select("*", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.row_index") + 1).alias("line"))


def order_breaks(rows: DataFrame, value: str, run: int = 1 << 16) -> DataFrame:
    """(file, line, value, previous, kind): lines whose `value` isn't above that of the line before, which the last line of the file before may be.

    `rows` has file and line. Files follow each other by name. Lines are compared within runs of a fixed number of
    lines, then only the ends of runs with each other, those of a file first: no window holds a file. A null
    value breaks the order and is skipped as the previous one of another.
    """
    one = rows.select("file", "line", F.col(value).alias("value"), F.floor((F.col("line") - 1) / run).alias("run"))
    by_run = Window.partitionBy("file", "run").orderBy("line")
    last_known = F.last("value", ignorenulls=True)
    inner = one.withColumn("previous", last_known.over(by_run.rowsBetween(Window.unboundedPreceding, -1)))
    ends = one.groupBy("file", "run").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("line"))).alias("last"))
    by_file = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", last_known_of("last").over(by_file))
    # the last value of each file before: a row a file
    files = ends.groupBy("file").agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("run"))).alias("last"))
    # a row a file, no more
    entry = files.select("file", last_known_of("last").over(Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)).alias("entry"))
    joined = inner.join(carried.select("file", "run", "carried"), ["file", "run"]).join(entry, "file")
    known = joined.withColumn("previous", F.coalesce("previous", "carried", "entry"))
    kind = F.when(F.col("value").isNull(), "missing").when(F.col("value") == F.col("previous"), "repeated").when(F.col("value") < F.col("previous"), "descending")
    return known.select("file", "line", "value", "previous", kind.alias("kind")).where("kind is not null")


def last_known_of(column: str) -> Column:
    return F.last(column, ignorenulls=True)


def require_ascending(rows: DataFrame, value: str) -> DataFrame:
    """`rows`, refused if order_breaks() finds a line; the message names the first."""
    first = order_breaks(rows, value).orderBy("file", "line").first()
    if first:
        raise ValueError(f"{first['file'].rpartition('/')[2]}, line {first['line']}: {first['kind']} {value} {first['value']} after {first['previous']}")
    return rows


def write_sorted(df: DataFrame, path: str, keys: list[str | Column], partitions: int | None = None) -> None:
    """Write `df` as Parquet files that follow each other in the order of `keys`: sorted within each, by ranges between them."""
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    spread.sortWithinPartitions(*keys).write.mode("error").parquet(path)


def sorted_proof(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """One row for a table that write_sorted() wrote, read again: n_rows, n_files, and n_breaks, lines whose keys fall below those of the line before."""
    rows = parquet_rows(spark, path).select("file", "line", F.struct(*keys).alias("key"))
    breaks = order_breaks(rows, "key").where("kind = 'descending'").agg(F.count("*").alias("n_breaks"))
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("file").alias("n_files")).crossJoin(breaks)
