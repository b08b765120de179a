"""Run bundles: findings and quality reports saved once as Parquet beside a small manifest with their digests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .provenance import files_digest

FORMAT_VERSION = 2
PARTS = ("cards", "qc")
#: The fields of a manifest; the digests came with version 2.
KEYS = {1: {"format_version", "run_id", "created_at"}, 2: {"format_version", "run_id", "created_at", "files", "counts"}}
STAGED = ".incoming-"


class BundleError(ValueError):
    """A bundle that can't be written or isn't what its manifest says."""


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_bundle(cards: DataFrame, qc: DataFrame, root: str, run_id: str, created_at: str) -> str:
    """Write a run under a staged name, its manifest last, and rename it once it is whole; an existing run is refused."""
    path, staged, spark = f"{root}/{run_id}", f"{root}/{STAGED}{run_id}", cards.sparkSession
    fs, place = _fs(spark, path)
    if fs.exists(place):
        raise BundleError(f"run {run_id} already exists")
    left = _fs(spark, staged)[1]
    fs.delete(left, True)
    for name, frame in zip(PARTS, (cards, qc), strict=True):
        frame.write.mode("error").parquet(f"{staged}/{name}")
    manifest = {
        "created_at": created_at, "format_version": FORMAT_VERSION, "run_id": run_id,
        "files": {n: files_digest(spark, f"{staged}/{n}") for n in PARTS}, "counts": {n: spark.read.parquet(f"{staged}/{n}").count() for n in PARTS},
    }
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(f"{staged}/manifest")
    # on a file system one of two writers of the same run gets the name
    if fs.exists(place) or not fs.rename(left, place):
        raise BundleError(f"run {run_id} already exists")
    return path


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, created_at, format_version, state) of each folder, newest first, from the manifests alone; nothing in them ends the query.

    A state is readable, future-version, damaged (no manifest, none that can be read, or one of another run) or incoming (staged, not whole
    yet). Other folders with a dot are skipped.
    """
    fs, place = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory() and not s.isSymlink()] if fs.exists(place) else []
    shown = [(n, n.removeprefix(STAGED), n.startswith(STAGED)) for n in names if n.startswith(STAGED) or not n.startswith(".")]
    folders = spark.createDataFrame(shown, "folder string, name string, staged boolean")
    lines = [f"{root}/{n}/manifest" for n, _, staged in shown if not staged and fs.exists(_fs(spark, f"{root}/{n}/manifest")[1])]
    form = "run_id string, created_at string, format_version int"
    text = spark.read.option("wholetext", True).text(lines) if lines else spark.createDataFrame([], "value string")
    files = text.select(F.regexp_extract(F.col("_metadata.file_path") if lines else F.lit(""), r"([^/]+)/manifest/[^/]*$", 1).alias("folder"), F.from_json("value", form).alias("m"))
    found = files.groupBy("folder").agg(F.first("m", ignorenulls=True).alias("m"))
    whole = F.coalesce((F.col("m.run_id") == F.col("folder")) & F.col("m.created_at").isNotNull() & (F.col("m.format_version") >= 1), F.lit(False))
    state = F.when(F.col("staged"), "incoming").when(~whole, "damaged").when(F.col("m.format_version") > FORMAT_VERSION, "future-version").otherwise("readable")
    rows = folders.join(found, "folder", "left").select(F.col("name").alias("run_id"), "m.created_at", "m.format_version", state.alias("state"))
    return rows.orderBy(F.desc_nulls_last("created_at"), F.desc("run_id"))


def read_bundle(spark: SparkSession, path: str, verify: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cards, qc) of a finished run of this or an older format.

    Refused are later formats, unknown or missing fields of the manifest, and, with `verify`, tables whose digests or numbers
    of rows are not those of the manifest. Older formats have no digests.
    """
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except (TypeError, ValueError):
        raise BundleError("the manifest can't be read") from None
    version = manifest.get("format_version") if isinstance(manifest, dict) else None
    if version not in KEYS:
        raise BundleError(f"bundle format {version} is not supported")
    if odd := sorted(set(manifest) ^ KEYS[version]):
        raise BundleError(f"the manifest has unknown or lacks known fields: {', '.join(odd)}")
    frames = [spark.read.parquet(f"{path}/{n}") for n in PARTS]
    if verify and version >= 2:
        for name, frame in zip(PARTS, frames, strict=True):
            if files_digest(spark, f"{path}/{name}") != manifest["files"].get(name) or frame.count() != manifest["counts"].get(name):
                raise BundleError(f"{name} is not what was saved")
    return frames[0], frames[1]
