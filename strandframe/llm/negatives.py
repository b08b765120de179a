"""Hard negatives: inner products bounded by the leading components of a rotation, and verified as integers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require_columns, scratch_tables, stored

#: So many rows, the smallest by a hash of their number, fit the rotation. It decides the speed alone: any rotation gives the same rows.
FIT_ROWS = 4096
#: Shards are cut for SHARDS tasks until they hold MOST_ROWS rows; anchors meet a shard's rows so many at a time.
SHARDS, LEAST_ROWS, MOST_ROWS, BLOCK = 64, 2048, 65_536, 64
LONG = 1 << 63


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def prepared(rows: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(row, vec_id, label, x): usable rows with integer components, padded with zeros to one length, and a number of their own."""
    v = F.col(vector)
    kept = rows.where(F.col(label).isNotNull() & usable(v)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("x"))
    # the number is fixed with the table
    held = stored(kept.withColumn("row", F.monotonically_increasing_id()), keep=True)
    width = held.agg(F.max(F.size("x"))).first()[0] or 0
    return held.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))


def rotation(rows: DataFrame) -> np.ndarray:
    """An orthogonal matrix whose first columns hold most of the vectors' squared length, from FIT_ROWS rows at most."""
    sample = rows.select("x", F.xxhash64("row").alias("h")).orderBy("h").limit(FIT_ROWS).select("x").toPandas()["x"]
    if not len(sample) or not len(sample[0]):
        return np.eye(0)
    x = np.stack(sample).astype(np.float64)
    x /= max(1.0, np.abs(x).max())
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


class Shard:
    """Rows of one shard: integers, rotated doubles, and what remains of each row's length behind each cut."""

    def __init__(self, parts: list[pa.RecordBatch], turn: np.ndarray):
        self.rows = np.concatenate([p.column("row").to_numpy() for p in parts])
        ids = pa.concat_arrays([p.column("vec_id") for p in parts])
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(LONG - 1).to_numpy()
        self.labels = pa.concat_arrays([p.column("label") for p in parts])
        self.x = np.concatenate([matrix(p) for p in parts])
        self.turned = turned(self.x, turn)
        self.rest = {c: remainder(self.turned, c) for c in cuts(len(turn))}
        self.length = remainder(self.turned, 0)
        self.most = largest(self.x)

    def bounded(self, anchors: Anchors, among: np.ndarray, least: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) in order of anchors, for `among` (anchors x rows), of all whose score may reach `least`.

        The first components of all are multiplied at once. What the others can add is bounded by the lengths of both
        remainders, and what rounding may hide by the whole lengths; `least` gets the lower and upper bounds and
        returns what each anchor asks for. Those who may reach it add components up to the next cut; the rest are
        left out, and the survivors' scores are sums of integer products.
        """
        first, *more = cuts(len(anchors.turned[0])) or [0]
        slack = 16 * (anchors.turned.shape[1] + 1) * np.finfo(float).eps * anchors.length[:, None] * self.length + 1e-9
        part = anchors.turned[:, :first] @ self.turned[:, :first].T
        rest = (anchors.rest(first)[:, None] * self.rest[first] if first else 0) + slack
        # scores end where a long does
        lower, upper = np.clip(np.where(among, part - rest, -np.inf), -LONG, LONG), np.clip(part + rest, -LONG, LONG)
        asked = least(lower, upper)
        a, r = np.nonzero(among & (upper >= asked[:, None]))
        sums, slack, at = part[a, r], slack[a, r], first
        for cut in more:
            sums = sums + np.einsum("ij,ij->i", anchors.turned[a, at:cut], self.turned[r, at:cut])
            stays = sums + anchors.rest(cut)[a] * self.rest[cut][r] + slack >= asked[a]
            a, r, sums, slack, at = a[stays], r[stays], sums[stays], slack[stays], cut
        return a, r, products(anchors.x, self.x, a, r, anchors.most * self.most * max(1, self.x.shape[1]))


class Anchors:
    def __init__(self, part: pa.RecordBatch, turn: np.ndarray):
        self.rows = part.column("row").to_numpy()
        self.ids = part.column("vec_id").to_numpy()
        self.labels = part.column("label")
        self.x = matrix(part)
        self.turned = turned(self.x, turn)
        self.length = remainder(self.turned, 0)
        self.most = largest(self.x)

    def rest(self, cut: int) -> np.ndarray:
        return remainder(self.turned, cut)


def matrix(part: pa.RecordBatch) -> np.ndarray:
    flat = part.column("x").flatten().to_numpy()
    return flat.reshape(part.num_rows, len(flat) // max(1, part.num_rows))


def turned(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) @ turn


def cuts(width: int) -> list[int]:
    return sorted({c for c in (width // 4, width // 2) if c})


def remainder(x: np.ndarray, cut: int) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x[:, cut:], x[:, cut:]))


def largest(x: np.ndarray) -> int:
    return max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0


def products(one: np.ndarray, two: np.ndarray, a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """The integer inner products of rows a of `one` and b of `two`; by Python's own integers where a long may not hold them."""
    out = np.empty(len(a), dtype=np.int64)
    for i in range(0, len(a), 8192):
        x, y = one[a[i : i + 8192]], two[b[i : i + 8192]]
        out[i : i + 8192] = np.einsum("ij,ij->i", x, y) if bound < LONG else [_whole(v, w) for v, w in zip(x, y, strict=True)]
    return out


def _whole(v: np.ndarray, w: np.ndarray) -> int:
    return max(-LONG, min(LONG - 1, sum(int(p) * int(q) for p, q in zip(v, w, strict=True))))


def nearest_first(score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places by falling score, rising id and number."""
    return np.lexsort((rows, ids, ~score))


FOUND = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, negative_row long, negative_id long, negative_score long"


def _schema() -> pa.Schema:
    return pa.schema([(c.split(" ")[0], pa.int64()) for c in FOUND.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = _schema()
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], type=pa.int64()) for _ in schema], schema=schema)


def positives_of(shard: Shard, anchors: Anchors, part: pa.RecordBatch, k: int) -> list[tuple]:
    """The k best of the shard's rows, all of the anchors' own label, but for each anchor itself."""
    among = anchors.rows[:, None] != shard.rows

    def least(lower: np.ndarray, _: np.ndarray) -> np.ndarray:
        # k rows reach their lower bounds
        return np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] > k else np.full(len(lower), -np.inf)

    a, r, score = shard.bounded(anchors, among, least)
    edges, out = np.searchsorted(a, np.arange(len(anchors.rows) + 1)), []
    for i in range(len(anchors.rows)):
        own, s = r[edges[i] : edges[i + 1]], score[edges[i] : edges[i + 1]]
        for j in nearest_first(s, shard.ids[own], shard.rows[own])[:k]:
            at = own[j]
            out.append((int(anchors.rows[i]), int(anchors.ids[i]), int(shard.rows[at]), int(shard.ids[at]) if shard.known[at] else None, int(s[j]), None, None, None))
    return out


def negatives_of(shard: Shard, anchors: Anchors, part: pa.RecordBatch, k: int, low: int, high: int) -> list[tuple]:
    """For each anchor and positive the k best of the shard's rows of other labels with low * positive <= 100 * score <= high * positive."""
    lists = part.column("positives").to_pylist()
    # scores lie from -(-low * p // 100) to high * p // 100; with a negative p from none
    asked = np.array([min([-(-low * p["score"] // 100) for p in ps if low * p["score"] <= high * p["score"]], default=np.inf) for ps in lists], dtype=float)
    # integers beyond 2 ** 53 may have been rounded up
    asked = np.where(np.abs(asked) < 2**53, asked, asked - np.abs(asked) * 1e-15)
    own, other = (pa.chunked_array([c]).combine_chunks().dictionary_encode() for c in (anchors.labels, shard.labels))
    place = {v: i for i, v in enumerate(other.dictionary.to_pylist())}
    mine = np.array([place.get(v, -1) for v in own.dictionary.to_pylist()])[own.indices.to_numpy()]
    a, r, score = shard.bounded(anchors, mine[:, None] != other.indices.to_numpy(), lambda lower, upper: asked)
    edges, out = np.searchsorted(a, np.arange(len(anchors.rows) + 1)), []
    for i, ps in enumerate(lists):
        rows, s = r[edges[i] : edges[i + 1]], score[edges[i] : edges[i + 1]]
        if not len(rows):
            continue
        best = nearest_first(s, shard.ids[rows], shard.rows[rows])
        falling = ~s[best]
        for p in ps:
            most = min(high * p["score"] // 100, LONG - 1)
            for j in best[(start := np.searchsorted(falling, ~most)) : start + k]:
                if 100 * int(s[j]) < low * p["score"]:
                    break
                at = rows[j]
                out.append((int(anchors.rows[i]), int(anchors.ids[i]), p["row"], p["vec_id"], p["score"], int(shard.rows[at]), int(shard.ids[at]) if shard.known[at] else None, int(s[j])))
    return out


def _met(rows: DataFrame, anchors: DataFrame, turn: np.ndarray, found: Callable[[Shard, Anchors, pa.RecordBatch], list[tuple]]) -> DataFrame:
    """What `found` makes of each shard's rows and the anchors sent to it; `rows` and `anchors` have shard columns s1 and s2.

    A task reads a shard's rows, then its anchors as they come: memory holds a shard and a block of anchors.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, shard = None, [], None
        for batch in batches:
            keys = list(zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), batch.column("kind").to_pylist(), strict=True))
            start = 0
            while start < len(keys):
                end, most = start, len(keys) if keys[start][2] == 0 else min(len(keys), start + BLOCK)
                while end < most and keys[end] == keys[start]:
                    end += 1
                part = batch.slice(start, end - start)
                if keys[start][:2] != key:
                    key, parts, shard = keys[start][:2], [], None
                if keys[start][2] == 0:
                    parts.append(part)
                elif parts:
                    shard = shard or Shard(parts, turn)
                    if rows_found := found(shard, Anchors(part, turn), part):
                        yield _batch(rows_found)
                start = end

    both = rows.withColumn("kind", F.lit(0)).unionByName(anchors.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "kind").mapInArrow(meet, FOUND)


def shard_rows(n: int) -> int:
    return max(LEAST_ROWS, min(MOST_ROWS, -(-n // SHARDS)))


def hard_negatives(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, k_positive: int = 5, k_negative: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x) and a score is the integer inner product. An anchor (a row where
    `anchor`, over vec_id, holds) has as positives its k_positive best other rows of the same label. For each, the first k_negative rows of
    other labels whose score is from `low` to `high` percent of the positive's are returned. Ties go to the
    smaller id, null ids last. Rows with a null label or an unusable vector take no part; shorter vectors count
    as padded with zeros. Rows that repeat an id are rows of their own, also as anchors. Scores and
    components beyond a long end at its limits. An empty table gives no rows.
    """
    require_columns(rows, vec_id, vector, label)
    if k_positive < 1 or k_negative < 1 or not 0 <= low <= high:
        raise ValueError("k_positive and k_negative must be at least 1, and 0 <= low <= high")
    base = prepared(rows, vec_id, vector, label, scale)
    turn = rotation(base)
    with scratch_tables(rows.sparkSession):
        total = base.count()
        anchors = base.where(F.coalesce(anchor, F.lit(False)) & F.col("vec_id").isNotNull())
        # rows of one label, in as many shards as they fill
        per = shard_rows(total)
        labels = stored(base.groupBy("label").agg(F.ceil(F.count("*") / per).cast("int").alias("shards")))
        salt = F.pmod(F.xxhash64("row"), F.col("shards")).cast("int")
        own = base.join(labels, "label").withColumns({"s1": F.xxhash64("label"), "s2": salt}).drop("shards")
        sent = anchors.join(labels, "label").withColumn("s2", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("s1", F.xxhash64("label")).drop("shards")
        near = _met(own, sent, turn, lambda shard, some, part: positives_of(shard, some, part, k_positive))
        by = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_row")
        best = near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k_positive)
        lists = best.groupBy("anchor_row").agg(F.collect_list(F.struct(F.col("positive_row").alias("row"), F.col("positive_id").alias("vec_id"), F.col("positive_score").alias("score"))).alias("positives"))
        asking = stored(anchors.join(lists, anchors.row == lists.anchor_row).drop("anchor_row"), keep=True)
    shards = -(-total // per)
    spread = base.withColumns({"s1": F.pmod(F.xxhash64("row"), F.lit(max(1, shards))), "s2": F.lit(0)})
    everywhere = asking.withColumn("s1", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, shards) - 1).cast("long")))).withColumn("s2", F.lit(0))
    far = _met(spread, everywhere, turn, lambda shard, some, part: negatives_of(shard, some, part, k_negative, low, high))
    by = Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_row")
    ranked = far.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k_negative)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
