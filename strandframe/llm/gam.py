"""Quality classifier: a generalised additive model with pairwise interactions, boosted one feature at a time."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, require_columns

FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "upper", "digit", "space", "mark", "symbol", "pipe", "exclaim", "stop", "newline",
    "non_ascii", "distinct_words", "top_word", "same_neighbour", "symbol_ends", "upper_words", "title_words", "short_words", "long_words",
    "distinct_pairs", "distinct_lines", "line_words", "entropy",
)


def _share_table() -> np.ndarray:
    """Byte -> class: upper, digit, space, mark, symbol, pipe, exclaim, stop, newline, non-ASCII; a row per class."""
    rows = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\n\x0b\x0c", ".,;:!?'\"()-", "#$%&*+/<=>@[\\]^_`{|}~", "|", "!", ".", "\n"]
    out = np.zeros((len(rows) + 1, 256))
    for i, row in enumerate(rows):
        out[i, list(row.encode())] = 1
    out[-1, 128:] = 1
    return out


_SHARES = _share_table()


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; zeros for a null or empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    shares = (_SHARES @ counts / len(raw)).tolist()
    p = counts[counts > 0] / len(raw)
    entropy = float(-(p * np.log2(p)).sum())
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    tally = Counter(words)
    same = sum(map(str.__eq__, words, words[1:]))
    ends = sum(not w[-1].isalnum() and w[-1] not in ".,;:?!" for w in words)
    upper = sum(map(str.isupper, words))
    title = sum(map(str.istitle, words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = text.split("\n")
    return [
        math.log1p(len(text)), math.log1p(len(words)), float(lengths.mean()), float(lengths.std()), *shares,
        len(tally) / n, max(tally.values(), default=0) / n, same / n, ends / n, upper / n, title / n, float((lengths <= 3).mean()), float((lengths >= 10).mean()),
        pairs / n, len(set(lines)) / len(lines), math.log1p(len(words) / len(lines)), entropy,
    ]


def with_features(docs: DataFrame, text: str = "text", column: str = "features") -> DataFrame:
    """Add FEATURES of each whole text as an array<double>."""

    @F.pandas_udf("array<double>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t) for t in texts])

    return docs.withColumn(column, measure(F.col(text)))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, least: float, ridge: float) -> np.ndarray:
    """Values per bin of a shallow tree over ordered bins: greedy cuts into at most `leaves` ranges."""
    g, h = np.concatenate([[0.0], np.cumsum(gradient)]), np.concatenate([[0.0], np.cumsum(weight)])

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, -1
        at = np.arange(a + 1, b)
        left_g, left_h, right_g, right_h = g[at] - g[a], h[at] - h[a], g[b] - g[at], h[b] - h[at]
        gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
        gain[(left_h < least) | (right_h < least)] = 0
        k = int(np.argmax(gain))
        return float(gain[k]), int(at[k])

    ranges = [(0, len(gradient))]
    while len(ranges) < leaves:
        gain, cut, i = max((*best(a, b), i) for i, (a, b) in enumerate(ranges))
        if gain <= 1e-9:
            break
        a, b = ranges[i]
        ranges[i : i + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(gradient))
    for a, b in ranges:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _tree_pair(gradient: np.ndarray, weight: np.ndarray, least: float, ridge: float) -> np.ndarray:
    """Values per cell: the best cut of the first feature, and on each side of it the best cut of the second."""
    best, out = -1.0, np.zeros_like(gradient)
    for cut in range(1, len(gradient)):
        values, gain = np.zeros_like(gradient), 0.0
        for rows in (slice(0, cut), slice(cut, None)):
            g, h = gradient[rows].sum(axis=0), weight[rows].sum(axis=0)
            leaf = _tree(g, h, 2, least, ridge)
            values[rows] = leaf
            gain += float((leaf * g).sum())
        if gain > best:
            best, out = gain, values
    return out


@dataclass
class AdditiveModel:
    """Bin edges and look-up tables: a score is the intercept plus one table entry per feature and chosen pair."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    coarse: int = 8

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def coarse_bins(self, bins: np.ndarray) -> np.ndarray:
        sizes = np.array([len(e) + 1 for e in self.edges])
        return bins * self.coarse // np.maximum(sizes, 1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        out = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            out += table[bins[:, j]]
        cells = self.coarse_bins(bins)
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[cells[:, i], cells[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, max_bins: int = 32, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8, rate: float = 0.1, leaves: int = 3, ridge: float = 1.0) -> AdditiveModel:
    """Cyclic boosting under logistic loss: each round gives every feature in turn one shallow tree.

    Then the pairs whose cells explain most of what is left are boosted the same way. One class or no rows
    gives a constant model.
    """
    n_features = x.shape[1]
    edges = []
    for j in range(n_features):
        cuts = np.unique(np.quantile(x[:, j], np.arange(1, max_bins) / max_bins)) if len(x) else np.empty(0)
        edges.append(cuts)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    model = AdditiveModel(edges, math.log(share / (1 - share)), [np.zeros(len(e) + 1) for e in edges])
    if len(y) < 10 or y.min() == y.max():
        return model
    bins = model.bins(x)
    odds = np.full(len(y), model.intercept)
    least = 2.0

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = residuals()
            step = rate * _tree(np.bincount(bins[:, j], g, len(table)), np.bincount(bins[:, j], h, len(table)), leaves, least, ridge)
            table += step
            odds += step[bins[:, j]]
    cells, size = model.coarse_bins(bins), model.coarse

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(cells[:, i] * size + cells[:, j], values, size * size).reshape(size, size)

    g, h = residuals()
    gains = {p: float((_tree_pair(gg := grid(*p, g), grid(*p, h), least, ridge) * gg).sum()) for p in combinations(range(n_features), 2)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    model.pair_tables = [np.zeros((size, size)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = residuals()
            step = rate * _tree_pair(grid(i, j, g), grid(i, j, h), least, ridge)
            table += step
            odds += step[cells[:, i], cells[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", learn: Column | None = None, max_rows: int = 12_000) -> AdditiveModel:
    """Fit on at most about `max_rows` labelled rows, chosen by a hash of the id among all of them.

    Labels are averaged per doc_id; null ids and labels teach nothing. `learn` may exclude rows by id. Of rows that
    share a doc_id one teaches. At most 2 * max_rows rows reach the driver.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))))
    known = known.groupBy(F.col(doc_id).alias("__id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    share = max(1, -(-known.count() // max_rows))
    order = F.xxhash64("__id")
    chosen = known.where(F.pmod(order, F.lit(share)) == 0).orderBy(order, "__id").limit(2 * max_rows)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(chosen), "__id")
    # one short row per chosen id, however often the id repeats: the one of the smallest text hash
    kept = with_features(rows, "text").select("__id", F.struct(F.xxhash64("text").alias("th"), "features", "y").alias("row")).groupBy("__id").agg(F.min("row").alias("row"))
    measured = kept.select("row.y", "row.features").toPandas()
    x = np.array(measured["features"].to_list(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, measured["y"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from `threshold`) to every row; columns of these names are replaced.

    Only the whole text is looked at; null and empty texts have all features zero and are scored like that.
    Repeated rows are scored one by one.
    """
    require_columns(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))
            yield pd.Series(shared.value.score(x), dtype="float64")

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, judge(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def learning_rows(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for rows whose crc32(doc_id as text) modulo `folds` is not 0; null for a null id."""
    return crc_remainder(doc_id, folds) != 0
