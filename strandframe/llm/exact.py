"""Exact dedup: sorted digest runs of partitions, merged in binomial rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require_columns, scratch_tables, stored

#: A merge takes 2 ** ROUNDS runs, whose numbers differ in their lowest bits: so many binomial rounds in one exchange.
ROUNDS = 4
#: What must agree for two texts to be one: SHA-256, the length in bytes and a 64-bit hash of another family.
IDENTITY = ("digest", "n_bytes", "second")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, digest, n_bytes, second, run, row): each row's identity, its run (the partition that made it) and a number of its own.

    Texts are read here only. A null text counts as empty. `normal` maps the text column before it is hashed.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    body = normal(body) if normal else body
    # named once, so that a costly `normal` runs once
    read = docs.select(F.col(doc_id).alias("doc_id"), F.get(F.array(F.struct(body.alias("t"))), F.lit(0)).alias("b"))
    return read.select(
        "doc_id",
        F.unhex(F.sha2(F.col("b.t"), 256)).alias("digest"),
        F.octet_length("b.t").cast("long").alias("n_bytes"),
        F.xxhash64("b.t").alias("second"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )


def tree_merge(runs: DataFrame, n_runs: int, best: Callable[[Column], Column]) -> DataFrame:
    """(digest, n_bytes, second, winner, copies): one row an identity, from runs numbered 0 to n_runs - 1.

    `winner` and `copies` are combined at every level: first within each partition, whose rows are sorted by
    identity and folded into a run; then 2 ** ROUNDS neighbouring runs are dealt by identity and merged into
    one, until a single run is left, dealt over all tasks. An identity that a third of all rows share
    thus arrives anywhere at most once from each of the merged runs.
    """
    merged, left = runs, n_runs
    while True:
        left = -(-left >> ROUNDS)
        node = [] if left <= 1 else [F.shiftright("run", ROUNDS).alias("run")]
        merged = merged.groupBy(*node, *IDENTITY).agg(best(F.col("winner")).alias("winner"), F.sum("copies").alias("copies"))
        if left <= 1:
            return merged


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest", normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are copies if their texts, after `normal` if given, are identical. Of a group the row with the
    `keep` ("smallest" or "largest") doc_id stays; a null id only if the group has no other. Rows that repeat
    id and text are counted one by one and one of them stays. Null and empty texts are copies of each
    other. Other columns are not read; an empty table gives no rows.
    """
    require_columns(docs, doc_id, text)
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    rows = stored(digests(docs, doc_id, text, normal), keep=True)
    with scratch_tables(docs.sparkSession):
        several = stored(_merged(rows, keep).where("copies > 1"), keep=True)
    groups = several.select(*[F.col(c).alias(f"g_{c}") for c in IDENTITY], "winner", "copies")
    same = [F.col(c) == F.col(f"g_{c}") for c in IDENTITY]
    # two plain tables: adaptive execution splits the rows of a large group
    both = rows.join(groups, same, "left")
    alone = F.col("copies").isNull()
    return both.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("winner.doc_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("winner.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _merged(rows: DataFrame, keep: str) -> DataFrame:
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    first, sign = ("no_id", 1) if keep == "smallest" else ("has_id", -1)
    has = F.col("doc_id").isNull() if keep == "smallest" else F.col("doc_id").isNotNull()
    winner = F.struct(has.alias(first), "doc_id", (F.col("row") * sign).alias("at"), F.col("row"))
    one = rows.select("run", *IDENTITY, winner.alias("winner"), F.lit(1).cast("long").alias("copies"))
    return tree_merge(one, n_runs, F.min if keep == "smallest" else F.max)


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest", normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of `docs` that exact_duplicates() keeps, with all their columns; of rows that repeat id and text one stays."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marked = docs.withColumn("__digest", F.sha2(normal(body) if normal else body, 256))
    winners = exact_duplicates(docs, doc_id, text, keep, normal).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    kept = marked.join(winners, marked[doc_id].eqNullSafe(winners["__id"]) & (marked["__digest"] == winners["__sha"]), "left_semi")
    return kept.dropDuplicates([doc_id, "__digest"]).drop("__digest")
