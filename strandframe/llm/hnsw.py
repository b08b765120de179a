"""Approximate nearest neighbours: a navigable small-world graph per shard in flat arrays, shard results merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, require_columns, small


class FlatGraph:
    """Layered neighbour lists over the rows of `points`, best inner product first.

    `points` all have one norm (see lift()), so the largest inner product is also the shortest distance.
    `nodes[level]` are the rows of a level and `lists[level]` their neighbours as positions in it, -1 for
    none. Level 0 has every row; each level above has a share 1/degree of the level below, and its rows come
    first below it. Rows join in batches that see each other and all rows before them.
    """

    def __init__(self, points: np.ndarray, sizes: list[int], lists: list[np.ndarray]) -> None:
        self.points, self.sizes, self.lists = points, sizes, lists

    @classmethod
    def build(cls, points: np.ndarray, degree: int = 16, width: int = 80, batch: int = 256) -> FlatGraph:
        n, sizes = len(points), []
        while n > 2 * degree or not sizes:
            sizes.append(n)
            n //= degree
        graph = cls(points, sizes[::-1], [])
        for level, size in enumerate(graph.sizes):
            bound = 2 * degree if level == len(graph.sizes) - 1 else degree
            lists = np.full((size, bound), -1, dtype=np.int32)
            graph.lists.append(lists)
            done = 0
            while done < size:
                to = min(size, done + max(1, min(batch, max(done, 2 * degree))))
                graph._insert(level, done, to, width)
                done = to
        return graph

    def _insert(self, level: int, done: int, to: int, width: int) -> None:
        """Link rows done..to: candidates from a search of earlier rows and from the batch itself."""
        new, lists = self.points[done:to], self.lists[level]
        among = new @ new.T
        np.fill_diagonal(among, -np.inf)
        near = min(width, to - done - 1)
        inside = np.argpartition(-among, near - 1, axis=1)[:, :near] if near else np.empty((to - done, 0), dtype=np.int64)
        rows = [inside + done]
        if done:
            rows.append(self._beam(level, new, self._entries(level, new), width, done)[0])
        found = np.concatenate(rows, axis=1)
        scores = np.where(found >= 0, np.einsum("bcd,bd->bc", self.points[found], new), -np.inf)
        if found.shape[1] > width:
            top = np.argpartition(-scores, width - 1, axis=1)[:, :width]
            found, scores = np.take_along_axis(found, top, 1), np.take_along_axis(scores, top, 1)
        chosen = self._select(found, scores, lists.shape[1] // 2)
        lists[done:to, : chosen.shape[1]] = chosen
        source = np.repeat(np.arange(done, to), chosen.shape[1])
        target = chosen.ravel()
        self._link_back(lists, source[target >= 0], target[target >= 0])

    def _select(self, found: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
        """Best first, a candidate closer to an already chosen one than to the row comes after all others."""
        order = np.argsort(-scores, axis=1, kind="stable")
        found, scores = np.take_along_axis(found, order, 1), np.take_along_axis(scores, order, 1)
        usable = np.isfinite(scores)
        near = self.points[found]
        among = near @ near.transpose(0, 2, 1)
        chosen = np.zeros(found.shape, dtype=bool)
        for c in range(found.shape[1]):
            worst = np.where(chosen, among[:, c, :], -np.inf).max(axis=1)
            chosen[:, c] = usable[:, c] & (worst < scores[:, c]) & (chosen.sum(axis=1) < most)
        place = np.where(chosen, 0, np.where(usable, 1, 2)) * found.shape[1] + np.arange(found.shape[1])
        pick = np.argsort(place, axis=1)[:, :most]
        return np.where(np.take_along_axis(usable, pick, 1), np.take_along_axis(found, pick, 1), -1)

    def _link_back(self, lists: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        bound = lists.shape[1]
        free = (lists[nodes] < 0).sum(axis=1)
        fits = counts <= free
        rank = np.arange(source.size) - np.repeat(first, counts)
        easy = np.repeat(fits, counts)
        lists[target[easy], np.repeat(bound - free, counts)[easy] + rank[easy]] = source[easy]
        for node, at, n in zip(nodes[~fits], first[~fits], counts[~fits], strict=True):
            own = lists[node]
            every = np.unique(np.concatenate([own[own >= 0], source[at : at + n]]))[None, :]
            scores = (self.points[every[0]] @ self.points[node])[None, :]
            if every.shape[1] > bound:
                if every.shape[1] > 4 * bound:
                    top = np.argpartition(-scores, 4 * bound, axis=1)[:, : 4 * bound]
                    every, scores = np.take_along_axis(every, top, 1), np.take_along_axis(scores, top, 1)
                every = self._select(every, scores, bound)
            lists[node] = -1
            lists[node, : every.shape[1]] = every[0]

    def _entries(self, level: int, queries: np.ndarray) -> np.ndarray:
        """Where to enter a level: the best rows that the levels above found."""
        entries = np.zeros((len(queries), 1), dtype=np.int64)
        for upper in range(level):
            entries = self._beam(upper, queries, entries, 8, self.sizes[upper])[0][:, :4]
        return np.where(entries < 0, entries[:, :1], entries)

    def _beam(self, level: int, queries: np.ndarray, entries: np.ndarray, width: int, limit: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best rows found for each query, best first (-1 where fewer), all queries in step."""
        lists, n = self.lists[level], len(queries)
        seen = np.zeros((n, limit + 1), dtype=bool)
        seen[:, limit] = True
        ids = np.full((n, width), limit, dtype=np.int64)
        scores = np.full((n, width), -np.inf, dtype=self.points.dtype)
        opened = np.ones((n, width), dtype=bool)
        line = np.arange(n)

        def merge(rows: np.ndarray, fresh: np.ndarray) -> None:
            fresh = np.where(np.take_along_axis(seen[rows], fresh, 1), limit, fresh)
            fresh.sort(axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = limit
            seen[rows[:, None], fresh] = True
            got = np.einsum("bcd,bd->bc", self.points[np.minimum(fresh, limit - 1)], queries[rows])
            got[fresh == limit] = -np.inf
            every, all_ids = np.concatenate([scores[rows], got], 1), np.concatenate([ids[rows], fresh], 1)
            all_open = np.concatenate([opened[rows], fresh == limit], 1)
            top = np.argpartition(-every, width - 1, axis=1)[:, :width]
            scores[rows], ids[rows], opened[rows] = (np.take_along_axis(x, top, 1) for x in (every, all_ids, all_open))

        merge(line, np.minimum(entries, limit))
        while line.size:
            open_scores = np.where(opened[line], -np.inf, scores[line])
            take = min(step, width)
            best = np.argpartition(-open_scores, take - 1, axis=1)[:, :take]
            alive = np.isfinite(np.take_along_axis(open_scores, best, 1))
            going = alive.any(axis=1)
            line, best, alive = line[going], best[going], alive[going]
            if not line.size:
                break
            at = np.take_along_axis(ids[line], best, 1)
            opened[line[:, None], best] = True
            nexts = np.where(alive[:, :, None], lists[np.minimum(at, len(lists) - 1)], -1).reshape(line.size, -1).astype(np.int64)
            merge(line, np.where((nexts < 0) | (nexts >= limit), limit, nexts))
        order = np.argsort(-scores, axis=1, kind="stable")
        ids = np.take_along_axis(ids, order, 1)
        return np.where(ids == limit, -1, ids), np.take_along_axis(scores, order, 1)

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """Rows of the `width` best points found for each query, best first, -1 where fewer."""
        last = len(self.sizes) - 1
        return self._beam(last, queries, self._entries(last, queries), min(width, self.sizes[last]), self.sizes[last])[0]


def lift(vectors: np.ndarray, query: bool = False) -> np.ndarray:
    """Single-precision points with one more component that makes all norms equal; queries get zero there.

    Points are scaled by the largest component of all, queries each by its own, so any finite size is in range.
    """
    largest = np.abs(vectors).max(axis=1 if query else None, keepdims=True)
    scaled = vectors / np.maximum(largest, np.finfo(np.float64).tiny)
    if query:
        last = np.zeros(len(vectors))
    else:
        squares = np.einsum("nd,nd->n", scaled, scaled)
        last = np.sqrt(np.maximum(squares.max() - squares, 0))
    return np.concatenate([scaled, last[:, None]], axis=1).astype(np.float32)


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and every component finite."""
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(good & (F.size(vector) > 0) & F.exists(vector, lambda x: x != 0), F.lit(False))


INDEX = "dim int, band int, shard int, size int, vectors array<double>, level_sizes array<int>, neighbours array<int>, ids array<long>, id_counts array<int>"


def build_index(
    vectors: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = 4096, most_shard_rows: int = 131_072, shards_wanted: int = 32, degree: int = 16
) -> tuple[DataFrame, DataFrame]:
    """(index, shards): a row per dimension and shard with its vectors and flat neighbour arrays, and their (dim, band, shard).

    Equal vectors are one point that carries the k + 1 smallest ids, as no result can hold more of them.
    Points are dealt by the vector's hash to shards of at least about `shard_rows`, which grow with the table
    up to `most_shard_rows`, what a task's memory holds, so that a query asks about `shards_wanted` shards until
    then. Vectors of very different sizes are in shards apart (band), as single precision can't rank them together.
    """
    good = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(embedding))).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    few = Window.partitionBy("v").orderBy("id")
    points = checkpointed(good.withColumn("r", F.dense_rank().over(few)).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    total = points.count()
    shards = max(1, -(-total // min(most_shard_rows, max(shard_rows, -(-total // shards_wanted)))))
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    keyed = points.withColumns({"dim": F.size("v"), "band": F.floor(F.log2(largest) / 32).cast("int"), "shard": F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")})

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.iloc[np.argsort([int(i[0]) for i in frame["ids"]], kind="stable")]
        own = np.stack(frame["v"].to_numpy())
        graph = FlatGraph.build(lift(own), degree)
        return pd.DataFrame(
            {
                "dim": [own.shape[1]],
                "band": [int(frame["band"].iloc[0])],
                "shard": [int(frame["shard"].iloc[0])],
                "size": [len(own)],
                "vectors": [own.ravel()],
                "level_sizes": [np.array(graph.sizes, dtype=np.int32)],
                "neighbours": [np.concatenate([x.ravel() for x in graph.lists])],
                "ids": [np.concatenate(frame["ids"].to_list()).astype(np.int64)],
                "id_counts": [np.array([len(i) for i in frame["ids"]], dtype=np.int32)],
            }
        )

    # a row per shard
    places = keyed.select("dim", "band", "shard").distinct()
    return keyed.groupBy("dim", "band", "shard").applyInPandas(build, INDEX), places


KEY = ["dim", "band", "shard", "copy"]


class LoadedShard:
    """A shard's row of build_index() as arrays to search."""

    def __init__(self, row, degree: int) -> None:
        self.own = np.asarray(row["vectors"], dtype=np.float64).reshape(int(row["size"]), int(row["dim"]))
        sizes, lists, at = [int(n) for n in row["level_sizes"]], [], 0
        flat = np.asarray(row["neighbours"], dtype=np.int32)
        for i, n in enumerate(sizes):
            bound = degree * (2 if i == len(sizes) - 1 else 1)
            lists.append(flat[at : at + n * bound].reshape(n, bound))
            at += n * bound
        self.graph = FlatGraph(lift(self.own), sizes, lists)
        self.starts = np.concatenate([[0], np.cumsum(np.asarray(row["id_counts"], dtype=np.int64))])
        self.ids = np.asarray(row["ids"], dtype=np.int64)

    def answers(self, query_ids: list[int], queries: np.ndarray, k: int, width: int) -> list[tuple[int, int, float]]:
        """The k best of the shard found for each query, but for its own id; the graph works in single precision, scores are of the original vectors."""
        out = []
        for q, (query_id, near) in enumerate(zip(query_ids, self.graph.search(lift(queries, query=True), max(width, k + 1)), strict=True)):
            near = near[near >= 0]
            with np.errstate(over="ignore", invalid="ignore"):
                scores = np.einsum("nd,d->n", self.own[near], queries[q])
            every = [(-s, i) for s, p in zip(scores.tolist(), near.tolist(), strict=True) for i in self.ids[self.starts[p] : self.starts[p + 1]].tolist() if i != query_id]
            out += [(int(query_id), i, -s) for s, i in sorted(every)[:k]]
        return out


def _search(batches: Iterator[pd.DataFrame], k: int, width: int, degree: int, block: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard: its own row first, which is loaded once, then the queries sent to it, as they come."""
    shard = None
    for batch in batches:
        keys = batch[[*KEY, "kind"]].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if not batch["kind"].iloc[start]:
                shard = LoadedShard(batch.iloc[start], degree)
                continue
            for at in range(start, end, block):
                part = batch.iloc[at : min(at + block, end)]
                found = shard.answers(part["query_id"].astype("int64").to_list(), np.stack(part["query"].to_numpy()).astype(np.float64), k, width)
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    shard_rows: int = 4096,
    most_shard_rows: int = 131_072,
    degree: int = 16,
    width: int = 96,
    block: int = 512,
    copies: int = 2,
) -> DataFrame:
    """The `k` rows of `vectors` with the largest inner product found for each query, the query's own id apart.

    Returns query_id, rank (from 1), vec_id and score (in double precision from the original vectors), ties
    to the smaller vec_id. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without id, take no part; only vectors of equal dimension meet. Repeated rows count once; an id with
    several vectors is a candidate with each of them and a query with the smallest. Components of any finite size
    are in range; a product beyond the doubles is infinite. Empty tables give no rows.
    A shard goes to `copies` tasks, once to each, and the queries are dealt between these; a task holds one shard
    and searches `block` queries at a time. A shard's answer is at most k rows each.
    """
    require_columns(vectors, vec_id, embedding)
    index, places = build_index(vectors, k, vec_id, embedding, shard_rows, most_shard_rows, degree=degree)
    asked = queries.where(F.col(vec_id).isNotNull() & usable(F.col(embedding))).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    # a row per shard
    sent = asked.withColumns({"dim": F.size("v"), "copy": F.pmod(F.xxhash64("id"), F.lit(copies)).cast("int"), "kind": F.lit(1)}).join(small(checkpointed(places), 3), "dim")
    sent = sent.select(*KEY, "kind", F.col("id").alias("query_id"), F.col("v").alias("query"))
    loaded = index.withColumns({"copy": F.explode(F.array(*map(F.lit, range(copies)))), "kind": F.lit(0)})
    dealt = loaded.unionByName(sent, allowMissingColumns=True).repartition(*KEY).sortWithinPartitions(*KEY, "kind")
    found = dealt.mapInPandas(lambda batches: _search(batches, k, width, degree, block), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
