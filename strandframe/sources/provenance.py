"""Content digests of files and tables, derived tables with a record of what they were made from, and results found again by it."""

from __future__ import annotations

import json
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "_provenance"


class ProvenanceError(ValueError):
    """A derived table that isn't what its record says, or none at all."""


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, bytes, sha256) of each file under `path`; a task holds one file at a time, so files should be of the size of a part file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def files_digest(spark: SparkSession, path: str, pattern: str = "part-*") -> str:
    """One digest of all files under `path`: of their own digests and sizes, in order, whatever their names."""
    listed = file_digests(spark, path, pattern).select("sha256", "bytes").orderBy("sha256", "bytes")
    return sha256("\n".join(f"{r[0]}:{r[1]}" for r in listed.toLocalIterator()).encode()).hexdigest()


def row_text(df: DataFrame) -> Column:
    """A row as text that no other row of these columns has: JSON of the columns by name, nulls included."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def table_digest(df: DataFrame) -> DataFrame:
    """One row (n_rows, digest): the same for the same rows in any order and number of files, another with a row more, less or changed.

    The SHA-256 of each row is added up in four numbers of 64 bits, in one aggregation that needs no sorting; the
    sums, the number of rows and the columns' names and types are hashed.
    """
    parts = [F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)").alias(f"p{i}") for i in range(4)]
    rows = df.select(F.sha2(row_text(df), 256).alias("h")).select(*parts)
    sums = rows.agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(f"p{i}"), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)])
    form = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(df.schema.fields, key=lambda f: f.name))
    return sums.select("n_rows", F.sha2(F.concat_ws("|", F.lit(form), F.col("n_rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("digest"))


def address(step: str, version: int, inputs: dict[str, str], params: dict) -> str:
    """The name under which a step's result for these inputs (name: digest) and parameters is kept."""
    return sha256(json.dumps([step, version, inputs, params], sort_keys=True).encode()).hexdigest()


def write_recorded(df: DataFrame, path: str, step: str, version: int, inputs: dict[str, str], params: dict) -> DataFrame:
    """Write `df` as Parquet and, last, the record of how it came about; a table without record is unfinished."""
    spark = df.sparkSession
    df.write.mode("error").parquet(f"{path}/data")
    back = spark.read.parquet(f"{path}/data")
    record = {"step": step, "version": version, "inputs": inputs, "params": params, "output": files_digest(spark, f"{path}/data"), "rows": back.count()}
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(f"{path}/{RECORD}")
    return back


def read_record(spark: SparkSession, path: str) -> dict | None:
    """The record of a table, null if it has none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{RECORD}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    lines = spark.read.text(f"{path}/{RECORD}").collect()
    try:
        record = json.loads(lines[0][0])
    except (IndexError, ValueError):
        raise ProvenanceError("the record can't be read") from None
    if not isinstance(record, dict) or set(record) != {"step", "version", "inputs", "params", "output", "rows"}:
        raise ProvenanceError("the record has other fields than it should")
    return record


def read_recorded(spark: SparkSession, path: str, step: str, version: int, inputs: dict[str, str], params: dict) -> DataFrame:
    """A recorded table, refused if it was made by another step or version, from other inputs or parameters, or has changed since."""
    record = read_record(spark, path)
    if record is None:
        raise ProvenanceError("the table has no record")
    for name, want in (("step", step), ("version", version), ("inputs", inputs), ("params", params)):
        if record[name] != want:
            raise ProvenanceError(f"the table was made with other {name}")
    found = spark.read.parquet(f"{path}/data")
    if files_digest(spark, f"{path}/data") != record["output"] or found.count() != record["rows"]:
        raise ProvenanceError("the table's files have changed since it was made")
    return found


def remembered(spark: SparkSession, root: str, step: str, version: int, inputs: dict[str, str], params: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` gave for these inputs and parameters before, checked, or gives now and is then kept for the next time.

    An unfinished attempt is replaced.
    """
    path = f"{root}/{step}-{address(step, version, inputs, params)}"
    if read_record(spark, path) is not None:
        return read_recorded(spark, path, step, version, inputs, params)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return write_recorded(make(), path, step, version, inputs, params)
