"""Merkle manifest of a dataset: hash trees combined from partial parents, and a proof for each leaf."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require_columns, scratch_tables, stored

ARITY = 3
#: A task of the first reshuffle gathers what lies below one node of this level; each further one as many levels more.
FIRST_LEVEL, MORE_LEVELS = 13, 6
#: Proofs go down this many levels at a time: a task then holds at most ARITY ** TIER leaves of one tree at once.
TIER = 7

NODE = "tree string, level int, at long, size long, digest binary, children array<binary>, open boolean"


def field(value: Column) -> Column:
    """A value as a leaf has it: `-` for null, else its UTF-8 length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def parent_digest(children: list[bytes]) -> bytes:
    """The hash of digests as hexadecimal text, one after the other."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


@dataclass(frozen=True)
class Forest:
    """Trees over ordered leaves: `leaves` (tree, at, size, digest, ...), `links` (each parent with its children) and `roots` (tree, level, digest)."""

    leaves: DataFrame
    links: DataFrame
    roots: DataFrame
    arity: int


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `at`, their place within their `tree` by `order`, and `size`, the number of rows of the tree.

    Rows are dealt by ranges of tree and order, so that a tree of any size is spread; a place is the offset
    of its range plus the place within it.
    """
    spread = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = stored(spread.withColumn("place", F.monotonically_increasing_id())).withColumn("run", F.shiftright("place", 33))
    runs = placed.groupBy("tree", "run").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(runs.select("tree", "run", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size")))
    return placed.join(offsets, ["tree", "run"]).select(*rows.columns, (F.col("place") + F.col("shift")).alias("at"), "size")


def combined(batches: Iterator[pa.RecordBatch], arity: int) -> Iterator[pa.RecordBatch]:
    """Nodes arrive in any order; a parent gathers its children's digests by place and, with the last one, becomes a node that arrives.

    How many it waits for follows from its level's size. Parents that are still partial at the end give
    their children back as open rows. Rows in order of their leaves keep a few partial parents a level.
    """
    waiting: dict[tuple, tuple[int, dict[int, bytes]]] = {}
    schema = _arrow_schema(NODE)
    for batch in batches:
        done: list[tuple] = []
        for tree, level, at, size, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "level", "at", "size", "digest")), strict=True):
            while size > 1:
                up = at // arity
                _, got = waiting.setdefault((tree, level, up), (size, {}))
                got[at] = digest
                if len(got) < min(arity, size - arity * up):
                    break
                del waiting[tree, level, up]
                children = [got[i] for i in sorted(got)]
                digest, level, at, size = parent_digest(children), level + 1, up, -(-size // arity)
                done.append((tree, level, at, size, digest, children, False))
        if done:
            yield _batch(done, schema)
    rest = [(tree, level, at, size, digest, None, True) for (tree, level, _), (size, got) in waiting.items() for at, digest in got.items()]
    for i in range(0, len(rest), 10_000):
        yield _batch(rest[i : i + 10_000], schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "boolean": pa.bool_()}
    return pa.schema([pa.field(*(name, kinds[kind])) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _above(level: Column, at: Column, top: Column, arity: int) -> Column:
    """The place at level `top` of the node above `at`."""
    powers, step = [1], 1
    while step * arity < 1 << 62:
        step *= arity
        powers.append(step)
    power = F.get(F.array(*[F.lit(p).cast("long") for p in powers]), top - level)
    # a power beyond the array is beyond any place
    return F.coalesce(F.call_function("div", at, power), F.lit(0).cast("long"))


def build(leaves: DataFrame, order: list[str], arity: int = ARITY) -> Forest:
    """The trees over `leaves` (tree, digest, ...), each in the order of `order`.

    Every task combines the nodes that it reads as far as it can. What its first and last rows leave
    unresolved, a few nodes a level, is dealt anew by ever larger subtrees until nothing is open.
    """
    if not 2 <= arity <= 255:
        raise ValueError("arity must be from 2 to 255")
    # not inside another scratch_tables(), with which the kept leaves would go; computed once, before ranges are sampled
    with scratch_tables(leaves.sparkSession):
        leaves = stored(ranked(stored(leaves), order), keep=True)
    rows, links, top = leaves.select("tree", F.lit(0).alias("level"), "at", "size", "digest"), None, FIRST_LEVEL
    while True:
        made = stored(rows.mapInArrow(lambda batches: combined(batches, arity), NODE), keep=True)
        closed = made.where("not open").drop("open")
        links = closed if links is None else links.unionByName(closed)
        open_ = made.where("open")
        if open_.isEmpty():
            break
        under = F.greatest(F.lit(top), F.col("level") + 1)
        rows = open_.withColumns({"under": under, "cell": _above(F.col("level"), F.col("at"), under, arity)}).repartition("tree", "under", "cell").select("tree", "level", "at", "size", "digest")
        top += MORE_LEVELS
    single = leaves.where("size = 1").select("tree", F.lit(0).alias("level"), "digest")
    return Forest(leaves, links, links.where("size = 1").select("tree", "level", "digest").unionByName(single), arity)


def proofs(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """`forest.leaves` with `root`, `siblings` and `shape`: each leaf's proof, from its run upwards.

    `siblings` are the digests (32 bytes each) of the other nodes of the leaf's run and of each run above, left
    to right; `shape` has two bytes a level, the place within the run and the run's length. `above` (tree,
    siblings, shape, root) continues the proofs beyond the trees' roots, whose digest `root` then stays.
    Links are followed backwards, from parents to children, a tier of levels at a time.
    """
    arity = forest.arity
    heights = forest.roots.select("tree", "level", F.col("digest").alias("root"))
    if above is None:
        above = heights.select("tree", F.unhex(F.lit("")).alias("siblings"), F.unhex(F.lit("")).alias("shape"))
    starts = heights.join(above.select("tree", "siblings", "shape"), "tree").select("tree", F.greatest(F.lit(0), F.floor((F.col("level") - 1) / TIER)).cast("int").alias("tier"), F.lit(0).cast("long").alias("cell"), "siblings", "shape", "root")
    # used once a tier
    starts = stored(starts, keep=True)
    last = starts.agg(F.max("tier")).first()[0] or 0
    found = None
    for tier in range(last, -1, -1):
        low, high = tier * TIER, (tier + 1) * TIER
        cell = lambda level, high=high: _above(level, F.col("at"), F.lit(high), arity).alias("cell")
        tops = starts.where(F.col("tier") == tier).select("tree", "cell", "siblings", "shape", "root")
        if found is not None:
            tops = tops.unionByName(found.select("tree", F.col("at").alias("cell"), "siblings", "shape", "root"))
        parents = forest.links.where((F.col("level") > low) & (F.col("level") <= high)).select("tree", cell(F.col("level")), "level", "at", "children")
        targets = (forest.leaves if tier == 0 else forest.links.where((F.col("level") == low) & (F.col("size") > 1)).drop("level", "children")).select("*", cell(F.lit(low)))
        carried = [f for f in targets.schema.fields if f.name not in ("tree", "cell", "at")]
        rows = tops.withColumn("kind", F.lit(0)).unionByName(parents.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        rows = rows.unionByName(targets.withColumn("kind", F.lit(2)), allowMissingColumns=True)
        out = ", ".join(["tree string", "at long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in carried], "root binary", "siblings binary", "shape binary"])
        found = rows.repartition("tree", "cell").sortWithinPartitions("tree", "cell", "kind").mapInArrow(_prover(low, [f.name for f in carried], arity), out)
    return found


def _prover(low: int, carried: list[str], arity: int):
    """For rows sorted by tree, cell and kind (the cell's own proof, its parents, then the nodes of level `low`)."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, start = None, (b"", b"", None)
        parents: dict[tuple[int, int], list[bytes]] = {}
        known: dict[tuple[int, int], tuple[bytes, bytes]] = {}

        def path(level: int, at: int) -> tuple[bytes, bytes]:
            if (found := known.get((level, at))) is None:
                run = parents.get((level + 1, at // arity))
                if run is None:  # the root, or the cell's own node
                    return start[0], start[1]
                siblings, shape = path(level + 1, at // arity)
                place = at % arity
                found = known[level, at] = b"".join(run[:place] + run[place + 1 :]) + siblings, bytes((place, len(run))) + shape
            return found

        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("tree", "cell", "kind", "level", "at", "children", "siblings", "shape", "root")}
            made, roots = [], []
            for i, (tree, key, kind) in enumerate(zip(columns["tree"], columns["cell"], columns["kind"], strict=True)):
                if (tree, key) != cell:
                    cell, start = (tree, key), (b"", b"", None)
                    parents.clear()
                    known.clear()
                if kind == 0:
                    start = columns["siblings"][i], columns["shape"][i], columns["root"][i]
                elif kind == 1:
                    parents[columns["level"][i], columns["at"][i]] = columns["children"][i]
                else:
                    made.append(path(low, columns["at"][i]))
                    roots.append(start[2])
            if made:
                kept = batch.filter(pc.equal(batch.column("kind"), 2))
                siblings, shapes = zip(*made, strict=True)
                arrays = [kept.column(c) for c in ("tree", "at", *carried)] + [pa.array(x, type=pa.binary()) for x in (roots, siblings, shapes)]
                yield pa.RecordBatch.from_arrays(arrays, names=["tree", "at", *carried, "root", "siblings", "shape"])

    return prove


def folded(digest: bytes, siblings: bytes, shape: bytes) -> bytes:
    """The root that a leaf's digest and its proof lead to."""
    at = 0
    for place, run in zip(shape[::2], shape[1::2], strict=True):
        left, end = at + 32 * place, at + 32 * (run - 1)
        digest = sha256((siblings[at:left].hex() + digest.hex() + siblings[left:end].hex()).encode()).digest()
        at = end
    return digest


def folded_root(digest: Column, siblings: Column, shape: Column) -> Column:
    @F.pandas_udf("binary")
    def roots(digest: pd.Series, siblings: pd.Series, shape: pd.Series) -> pd.Series:
        return pd.Series([folded(*x) for x in zip(digest, siblings, shape, strict=True)], dtype=object)

    return roots(digest, siblings, shape)


def tree_key(name: Column) -> Column:
    """A tree's name, null or not, as a key that is never null and sorts the null first."""
    return F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), name))


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, others: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """One row per row of `docs`: `order`, leaf, subroot, root, siblings, shape, and a digest for each of `others`.

    A leaf hashes the `columns` in turn. Leaves of one `group` value form a tree, by `order` (nulls first) and
    then by digest; the trees' roots, by group (null first, then by bytes), form one more tree with the
    dataset's root. `others` maps names to replacements of a column in a leaf: name -> (column, new value), and
    null for rows that have none. Repeated rows are leaves of their own. An empty table gives no rows.
    """
    require_columns(docs, *columns, group, order)
    extra = {}
    for name, (column, new, where) in (others or {}).items():
        extra[name] = F.when(where, leaf_digest(*[new if c == column else F.col(c) for c in columns]))
    key = F.col(order).alias("key")
    leaves = docs.select(tree_key(F.col(group).cast("string")).alias("tree"), key, leaf_digest(*[F.col(c) for c in columns]).alias("digest"), *[v.alias(n) for n, v in extra.items()])
    groups = build(leaves, ["key", "digest"], arity)
    subroots = groups.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    whole = build(subroots, ["name"], arity)
    over = proofs(whole).select(F.col("name").alias("tree"), "siblings", "shape")
    root = whole.roots.select("digest").first()
    proved = proofs(groups, over)
    return proved.select(F.col("key").alias(order), F.col("digest").alias("leaf"), F.col("root").alias("subroot"), F.lit(None if root is None else bytes(root[0])).cast("binary").alias("root"), "siblings", "shape", *extra)


def tamper_report(docs: DataFrame) -> DataFrame:
    """The manifest of `documents`, and whether each leaf still leads to the root after lines of every second document were joined.

    Rows with an even crc32 of their doc_id have the line breaks deleted from their text; a null id has none.
    """
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    joined = ("text", F.translate("text", "\n", ""), even)
    rows = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"tampered": joined})
    judged = rows.withColumn("folded", folded_root(F.coalesce("tampered", "leaf"), F.col("siblings"), F.col("shape")))
    shown = {c: F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")}
    proof = F.sha2(F.lower(F.hex("siblings")).cast("binary"), 256).alias("proof_sha256")
    return judged.select("doc_id", *shown.values(), proof, F.lower(F.hex("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
