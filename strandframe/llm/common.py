"""Helpers shared by the operators: shared-folder checkpoints, row keys and connected components."""

from __future__ import annotations

import os
import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed


class _Scratch(threading.local):
    """The tables to delete, a list for each scratch_tables() that is open in this thread."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_SCRATCH = _Scratch()

#: Spark deletes the shuffle files of what runs under this setting at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that stored() writes meanwhile, but for those to keep; nothing lazy may still need them. Inside another, kept ones go with that."""
    _SCRATCH.open.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.open.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write `df` once as a table in the shared checkpoint folder and read it from there; for frames of the operators' own columns.

    Smaller than a checkpoint, and its size is known to the planner. Its shuffle files go as soon as it is written,
    not when the driver collects garbage. It stays until the innermost
    scratch_tables() ends, with `keep` until the next outer one does, and outside of any until the driver does: results may read it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        checkpointed(spark.range(0))
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if len(_SCRATCH.open) > keep:
        _SCRATCH.open[-1 - keep].append(path)
    else:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def equal_nulls(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """A join condition that also matches null with null; it stays an equi-join."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def crc_remainder(column: str, divisor: int) -> Column:
    """crc32 of the value's text, modulo `divisor`; null for a null value."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)


#: A frame of a few longs a row is broadcast up to this many bytes and dealt by its key beyond.
MOST_BROADCAST, ROW_BYTES = 64 << 20, 16


def small(df: DataFrame, longs: int = 1, most: int = MOST_BROADCAST) -> DataFrame:
    """`df`, a stored frame of `longs` longs a row, with a hint to broadcast it if it is small enough."""
    return F.broadcast(df) if df.count() * longs * ROW_BYTES <= most else df


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Label each node of an undirected graph with the smallest node it can reach.

    Alternates large-star and small-star steps until the edges form stars, which they do after a number of steps
    that grows with the logarithm of the nodes squared at most. Each step is a map-side
    combined minimum and an equi-join that adaptive execution may split, so a hub needs no single task.
    Returns (node, component) for nodes with at least one link to another node; self links and null ends
    are ignored.
    """
    current = stored(
        edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct()
    )
    seen = _state(current)
    if seen[0] == 0:
        return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(lowest, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        current = stored(small)
        now = _state(current)
        if now == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = now


#: Buckets of more rows than STAR_ROWS compare theirs with up to STARS further ones, before rows of different groups are compared with each other.
STARS, STAR_ROWS = 2, 32


def shared_keys(rows: DataFrame, picks: Column, crowd: int | None, similarity: float, most: int = MOST_BROADCAST) -> DataFrame:
    """(key, h1, n, copies, lines): each h1 of `rows` (h1, n, ...) under those of its `picks`, an array of longs, that another h1 has, too; lines counts a key's.

    Two rows alone under a key whose sizes n differ by more than `similarity` allows are left out. With a `crowd`, a pick of
    more rows than that is no key by itself but together with each other pick of a row, so that pairs which share
    nothing else are lost; the operators give None, which keeps every pick, and have large buckets cut without loss.
    """
    with scratch_tables(rows.sparkSession):
        return stored(_shared_keys(rows, picks, crowd, similarity, most), keep=True)


def _shared_keys(rows: DataFrame, picks: Column, crowd: int | None, similarity: float, most: int) -> DataFrame:
    picked = rows.select("h1", "n", picks.alias("picks"))
    keyed = picked.select("h1", "n", F.explode("picks").alias("key"))
    # size above, a part of the hash below: two numbers tell whether there are different rows, and of what sizes
    mixed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("h1").bitwiseAND(F.lit(0xFFFFFFFF)))
    shared = keyed.select("key", mixed.alias("row")).groupBy("key").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.count("*").alias("rows"))
    fits = (F.col("lo") != F.col("hi")) & ((F.col("rows") > 2) | (F.shiftright("hi", 32) * similarity <= F.shiftright("lo", 32) + 1e-9))
    shared = shared.where(fits)
    if crowd is None:
        met = keyed.join(small(stored(shared.select("key")), most=most), "key")
    else:
        shared = stored(shared.select("key", (F.col("rows") > crowd).alias("crowded")))
        met = picked.select("h1", "n", "picks", F.explode("picks").alias("key")).join(small(shared, 2, most), "key")
        finer = F.transform(F.array_except("picks", F.array("key")), lambda other: F.xxhash64(F.least(other, F.col("key")), F.greatest(other, F.col("key"))))
        met = met.select("h1", "n", F.explode(F.when(F.col("crowded"), finer).otherwise(F.array("key"))).alias("key"))
    members = stored(met.groupBy("key", "h1", "n").agg(F.count("*").alias("copies")))
    several = stored(members.groupBy("key").agg(F.count("*").alias("lines")).where("lines > 1"))
    return members.join(small(several, 2, most), "key")


def rarest_tokens(tokens: DataFrame, first: Column) -> DataFrame:
    """(h1, token): the `first` so many, a column over size n, of each row's `tokens` (h1, n, token), the rarest first.

    If of two rows all but k - 1 tokens of each are tokens of the other, they share one of the k that come first in any
    order that is the same for both: none before the first common one is common. Tokens of one row alone are left out.
    """
    rated = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("rows")), "token")
    ranked = rated.groupBy("h1", "n").agg(F.sort_array(F.collect_list(F.struct("rows", "token"))).alias("all"))
    return ranked.select("h1", F.explode(F.slice("all", F.lit(1), first)).alias("t")).where("t.rows > 1").select("h1", "t.token")


def cut_by_tokens(rows: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, indexed): rows of large buckets keyed by a token of `prefixes` (h1, token) too; only those outside their bucket's largest group ask.

    Of a pair in different groups at least one does.
    """
    indexed = stored(rows.join(prefixes, "h1").withColumn("key", F.xxhash64("key", "token")).drop("token"))
    return indexed.where("root <> main"), indexed


def pair_ends(pairs: DataFrame) -> DataFrame:
    """(h1): both ends of pairs (a, b)."""
    return pairs.select(F.explode(F.array("a", "b")).alias("h1"))


def bucket_groups(members: DataFrame, alike: Column, verified: Callable[[DataFrame], DataFrame], bucket_rows: int, cut: Callable[[DataFrame], tuple[DataFrame, DataFrame]], marked: Callable[[DataFrame], DataFrame] | None = None, fits: Column | None = None) -> DataFrame:
    """(node, component): the groups that verified pairs of `members` (key, h1, fp, n, copies, lines) connect; all pairs of a bucket are possible.

    Each row of a bucket is first compared with its most frequent one and, in buckets of many rows still in different
    groups, with the most frequent one outside its largest group, a few times. After that only what is in different groups is
    compared with each other: groups of near copies need a few comparisons a row. `alike` is what a pair (a, a_n, a_fp, b,
    b_n, b_fp) must pass before `verified` reads more. Buckets of more than `bucket_rows` go through `cut` for it, which keys
    rows more finely, without loss. `marked` adds columns to rows for this last comparison, of which pairs must pass `fits`, too.
    """

    def checked(pairs: DataFrame) -> DataFrame:
        with scratch_tables(pairs.sparkSession):
            different = stored(pairs.distinct())
            return stored(verified(different), keep=True)

    def star(rows: DataFrame, centres: DataFrame) -> DataFrame:
        c = centres.groupBy("key").agg(F.max(F.struct("copies", "h1", "fp", "n", "root")).alias("c")).select("key", *[F.col(f"c.{x}").alias(y) for x, y in (("h1", "b"), ("fp", "b_fp"), ("n", "b_n"), ("root", "b_root"))])
        a = rows.select("key", F.col("h1").alias("a"), F.col("n").alias("a_n"), F.col("fp").alias("a_fp"), "root")
        return a.join(c, "key").where("a <> b and root <> b_root").where(alike).select("a", "a_n", "b", "b_n")

    alone = members.withColumn("root", F.col("h1"))
    grouped = stored(connected_components(checked(star(alone, alone))))
    rest = _mixed(members, grouped)
    crowded, before = rest.where(F.col("lines") > STAR_ROWS), grouped
    for _ in range(STARS):
        links = checked(star(crowded, crowded.where("root <> main")))
        if links.isEmpty():
            break
        grouped = _joined_groups(grouped, links)
        crowded = _mixed(crowded.drop("root", "main"), grouped)
    if grouped is not before:
        rest = _mixed(rest.drop("root", "main"), grouped)
    extra = []
    if marked is not None:
        marks = marked(rest)
        extra, alike = [c for c in marks.columns if c != "h1"], alike & fits
        rest = stored(rest.join(marks, "h1"))
    large = rest.where(F.col("lines") > bucket_rows)
    few = rest.where(F.col("lines") <= bucket_rows)
    pairs = _bucket_pairs(few.where("root <> main"), few, alike, extra)
    if not large.isEmpty():
        pairs = pairs.unionByName(_bucket_pairs(*cut(large), alike, extra))
    more = checked(pairs)
    return grouped if more.isEmpty() else _joined_groups(grouped, more)


def _bucket_pairs(one: DataFrame, two: DataFrame, alike: Column, extra: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows of one bucket in different groups that pass `alike`, which may read the `extra` columns as a_ and b_, too."""
    left, right = (rows.select("key", F.col("h1").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "fp", "root", *extra)]) for rows, x in ((one, "a"), (two, "b")))
    return left.join(right, "key").where("a_root <> b_root").where(alike).select("a", "a_n", "b", "b_n").distinct()


def _mixed(members: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of buckets with rows in different groups, each with its group (root) and its bucket's largest one (main)."""
    rooted = members.where("lines > 2").join(grouped, members.h1 == grouped.node, "left").select("key", "h1", "fp", "n", "copies", "lines", F.coalesce("component", "h1").alias("root"))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("k"))
    main = sizes.groupBy("key").agg(F.max(F.struct("k", "root")).alias("m"), F.count("*").alias("groups")).where("groups > 1").select("key", F.col("m.root").alias("main"))
    return stored(rooted.join(main, "key"))


def _joined_groups(grouped: DataFrame, more: DataFrame) -> DataFrame:
    """`grouped` after further links, which are few and join whole groups."""
    root = {x: grouped.select(F.col("node").alias(x), F.col("component").alias(f"{x}_root")) for x in "ab"}
    joins = more.join(root["a"], "a", "left").join(root["b"], "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    over = connected_components(joins)
    moved = grouped.join(over.select(F.col("node").alias("component"), F.col("component").alias("lower")), "component", "left").select("node", F.coalesce("lower", "component").alias("component"))
    return stored(moved.unionByName(over.join(grouped, "node", "left_anti")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine find the package as the driver does; a cluster installs it or uses --py-files."""
    root, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, paths)))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    with_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
