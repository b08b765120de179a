"""Language ID: interpolated Kneser-Ney character models per language, with calibrated rejection."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, crc_remainder, require_columns

ORDER = 4
SPACE = 32
#: Code points scored or counted at once, whole texts apart.
CHUNK = 1_000_000


def _letter_map() -> np.ndarray:
    """Basic-plane code point -> its lower-case letter, or a space for what is no letter."""
    out = np.full(0x10000, SPACE, dtype=np.uint16)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
    return out


#: The letters of the basic plane, and the codes there that are none, which stand for the letters beyond it.
_MAP: list[np.ndarray] = []


def _far_letter(point: int) -> int:
    """The code of a letter beyond the basic plane: its lower-case form's, by its number modulo the free codes.

    There are some 16,000 free codes, so that no two letters of a script share one, whatever other scripts do; of the
    largest extensions of Chinese characters a few do.
    """
    ch = chr(point)
    if not ch.isalpha():
        return SPACE
    low = ch.lower()
    return int(_MAP[1][(ord(low) if len(low) == 1 else point) % _MAP[1].size])


def letters(text: str) -> np.ndarray:
    """The text as the codes of its lower-case letters with single spaces between runs, 16 bits each."""
    if not _MAP:
        own = _letter_map()
        free = np.flatnonzero(own == SPACE)
        _MAP.extend((own, free[free != SPACE]))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    far = points > 0xFFFF
    if far.any():
        kinds, at = np.unique(points[far], return_inverse=True)
        codes = np.array([_far_letter(p) for p in kinds.tolist()], dtype=np.uint16)[at]
        mapped = _MAP[0][np.where(far, 0, points)].copy()
        mapped[far] = codes
    else:
        mapped = _MAP[0][points]
    blank = mapped == SPACE
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    return mapped[keep].astype(np.uint64)


def grams(chars: np.ndarray) -> np.ndarray:
    """One 64-bit code per character: it and the three before it, 16 bits each; a text starts after spaces."""
    padded = np.concatenate([np.full(ORDER - 1, SPACE, dtype=np.uint64), chars])
    n = chars.size
    return (padded[0:n] << np.uint64(48)) | (padded[1 : n + 1] << np.uint64(32)) | (padded[2 : n + 2] << np.uint64(16)) | padded[3 : n + 3]


class HashTable:
    """Codes in order of their hash, found by the hash's leading bits; `rows` holds one float per language."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray) -> None:
        hashes = self.mix(codes)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.rows = hashes[order], np.ascontiguousarray(rows[order].astype(np.float32))
        self.bits = max(1, int(codes.size).bit_length())
        starts = np.searchsorted(self.hashes >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        self.starts = starts.astype(np.int32)
        self.deepest = int(np.diff(starts).max(initial=0))

    @staticmethod
    def mix(codes: np.ndarray) -> np.ndarray:
        """An odd multiplication and xor-shifts: a bijection of 64-bit codes, so equal hashes are equal codes."""
        h = codes * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The row of each code, -1 where it is absent."""
        if not self.hashes.size:
            return np.full(codes.size, -1, dtype=np.int64)
        h = self.mix(codes)
        bucket = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[bucket].astype(np.int64), self.starts[bucket + 1]
        out = np.full(codes.size, -1, dtype=np.int64)
        todo = np.flatnonzero(at < end)
        while todo.size:
            same = self.hashes[at[todo]] == h[todo]
            out[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out


class KneserNey:
    """Order-4 interpolated Kneser-Ney models of several languages in joint hash tables.

    Each table row holds one log probability or log back-off weight per language; unseen characters get a
    uniform share.
    """

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]], discount: float = 0.75) -> None:
        self.langs = langs
        n_lang = len(langs)
        tops = [counts[x][0] for x in langs]
        union = [np.unique(np.concatenate([*tops, np.empty(0, np.uint64)]))]
        for k in range(1, ORDER):
            union.append(np.unique(union[0] & np.uint64((1 << (16 * (ORDER - k))) - 1)))
        contexts = [np.unique(u >> np.uint64(16)) for u in union[: ORDER - 1]]
        chars = union[-1]
        self.floor = -math.log(max(2, chars.size + 1))
        probs = [np.zeros((u.size, n_lang)) for u in union]
        weights = [np.zeros((c.size, n_lang)) for c in contexts]
        for i, lang in enumerate(langs):
            codes, n = counts[lang]
            own = [(codes, n.astype(np.float64))]
            for k in range(1, ORDER):
                low, tally = np.unique(own[-1][0] & np.uint64((1 << (16 * (ORDER - k))) - 1), return_counts=True)
                own.append((low, tally.astype(np.float64)))
            one, tally = own[-1]
            total, kinds = tally.sum(), one.size
            base = np.full(chars.size, 1.0 / (chars.size + 1))
            if total:
                base *= discount * kinds / total
                base[np.searchsorted(chars, one)] += np.maximum(tally - discount, 0) / total
            probs[-1][:, i] = base
            for k in range(ORDER - 2, -1, -1):
                gram, c = own[k]
                context, inverse, kinds = np.unique(gram >> np.uint64(16), return_inverse=True, return_counts=True)
                sums = np.bincount(inverse, weights=c, minlength=context.size)
                weight = np.ones(contexts[k].size)
                weight[np.searchsorted(contexts[k], context)] = discount * kinds / np.maximum(sums, 1e-300)
                weights[k][:, i] = weight
                every = union[k]
                lower = np.searchsorted(union[k + 1], every & np.uint64((1 << (16 * (ORDER - 1 - k))) - 1))
                p = weight[np.searchsorted(contexts[k], every >> np.uint64(16))] * probs[k + 1][lower, i]
                p[np.searchsorted(every, gram)] += np.maximum(c - discount, 0) / sums[inverse]
                probs[k][:, i] = p
        self.tables = [HashTable(u, np.log(np.maximum(p, 1e-300))) for u, p in zip(union, probs, strict=True)]
        self.backoffs = [HashTable(c, np.log(np.maximum(w, 1e-300))) for c, w in zip(contexts, weights, strict=True)]

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each coded character, a column per language."""
        out = np.zeros((codes.size, len(self.langs)), dtype=np.float32)
        todo = np.arange(codes.size)
        for k in range(ORDER):
            part = codes[todo] if k else codes
            at = self.tables[k].find(part & np.uint64((1 << (16 * (ORDER - k))) - 1))
            hit = at >= 0
            out[todo[hit]] += self.tables[k].rows[at[hit]]
            todo, part = todo[~hit], part[~hit]
            if not todo.size:
                return out
            if k < ORDER - 1:
                context = self.backoffs[k].find((part & np.uint64((1 << (16 * (ORDER - k))) - 1)) >> np.uint64(16))
                seen = context >= 0
                out[todo[seen]] += self.backoffs[k].rows[context[seen]]
        out[todo] += np.float32(self.floor)
        return out

    def cross_entropy(self, text: str) -> tuple[int, np.ndarray]:
        """Scored characters and the mean negative log probability for each language, over the whole text."""
        chars = letters(text)
        total = np.zeros(len(self.langs))
        codes = grams(chars)
        for start in range(0, codes.size, CHUNK):
            total -= self.log_probs(codes[start : start + CHUNK]).sum(axis=0, dtype=np.float64)
        return chars.size, total / max(1, chars.size)


@dataclass
class LanguageModel:
    """The trained models and, per language, mean and spread of cross-entropies of labelled texts not counted for them."""

    scorer: KneserNey | None
    center: dict[str, float]
    spread: dict[str, tuple[float, float]]
    limit: float

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); `und`, 0 and rejected for a null text or one without letters."""
        if text is None or self.scorer is None:
            return "und", 0.0, True
        n, entropy = self.scorer.cross_entropy(text)
        if not n or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        best = int(np.argmin(entropy))
        lang = self.scorer.langs[best]
        odds = np.exp(-(entropy - entropy[best]) * min(n, 64))
        return lang, float(1.0 / odds.sum()), self.surprise(lang, n, float(entropy[best])) > self.limit

    def surprise(self, lang: str, n: int, entropy: float) -> float:
        fixed, per_char = self.spread[lang]
        return (entropy - self.center[lang]) / math.sqrt(fixed**2 + per_char**2 / n)


def _count_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Count codes over a task's batches, one sorted array per language, emitted whenever it grows long."""
    held: dict[tuple[str, bool], list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pd.DataFrame]:
        for (lang, kept_out), parts in held.items():
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pd.DataFrame({"lang": lang, "kept_out": kept_out, "code": codes.view(np.int64), "n": n.astype(np.int64)})
        held.clear()

    for batch in batches:
        for lang, kept_out, text in zip(batch["lang"], batch["kept_out"], batch["text"], strict=True):
            codes = grams(letters(text))
            held.setdefault((lang, bool(kept_out)), []).append(codes)
            size += codes.size
            if size > 4 * CHUNK:
                yield from flush()
                size = 0
    yield from flush()


def train(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    learn: "F.Column | None" = None,
    margin: float = 1.5,
    false_rejections: float = 0.002,
) -> LanguageModel:
    """Learn from every row with a text and a label (and `learn` true, if given).

    Codes are counted over all such rows in Spark, and all counted codes are in the models: 8 bytes and 4 for each
    language per different code, which reach the driver and every worker. A quarter of the rows, by crc32 of the
    text, is left out of a first model, which scores all of these for centers, spreads and the rejection limit: `margin` times the surprise that all but a share `false_rejections` of them stay
    below (6 at least), so that no single odd text sets it and at most that share of such texts is rejected. Equal texts of
    one label are one text. Sums, medians and the quantile are taken in Spark, surprises in steps of 1 / STEPS. The final model uses
    all counts.
    """
    require_columns(docs, text, lang, doc_id)
    chosen = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))))
    rows = chosen.select(F.col(lang).cast("string").alias("lang"), (F.crc32(F.col(text).cast("binary")) % 4 == 3).alias("kept_out"), F.col(text).alias("text"))
    counted = (
        rows.mapInPandas(_count_rows, "lang string, kept_out boolean, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("kept_out"), F.col("n")).otherwise(0)).alias("first_n"))
    )
    kept = counted.toPandas()
    langs = sorted(kept["lang"].unique())
    if not langs:
        return LanguageModel(None, {}, {}, 6.0)

    def model(column: str) -> KneserNey:
        counts = {}
        for x in langs:
            own = kept[(kept["lang"] == x) & (kept[column] > 0)]
            codes = own["code"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(codes)
            counts[x] = codes[order], own[column].to_numpy()[order]
        return KneserNey(langs, counts)

    first = docs.sparkSession.sparkContext.broadcast(model("first_n"))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for x, th, th2, t in zip(batch["lang"], batch["th"], batch["th2"], batch["text"], strict=True):
                n, entropy = first.value.cross_entropy(t)
                if n:
                    found.append((x, th, th2, n, float(entropy[first.value.langs.index(x)])))
            yield pd.DataFrame(found, columns=["lang", "th", "th2", "n", "entropy"])

    # only the hash of a text and its figures are kept: equal texts are scored alike
    kept_out = rows.where("kept_out").select("lang", "text")
    ids = kept_out.select("lang", F.xxhash64("text").alias("th"), F.xxhash64("text", F.lit(1)).alias("th2"), "text")
    seen = checkpointed(ids.mapInPandas(scored, "lang string, th long, th2 long, n long, entropy double").dropDuplicates(["lang", "th", "th2"]))
    first.unpersist()

    def figures(df: DataFrame) -> DataFrame:
        """Per language and over all (null): texts, median length, mean entropy by letters, spread of the longer half."""
        both = df.unionByName(df.withColumn("lang", F.lit(None).cast("string")))
        medians = both.groupBy(F.col("lang").alias("own")).agg(F.median("n").alias("median"))
        long = F.when(F.col("n") >= F.col("median"), F.col("entropy"))
        joined = both.join(F.broadcast(medians), F.col("lang").eqNullSafe(F.col("own")))
        return joined.groupBy("lang").agg(F.count("*").alias("texts"), (F.sum(F.col("entropy") * F.col("n")) / F.sum("n")).alias("center"), F.stddev_pop(long).alias("spread"))

    # a row a language
    found = {r["lang"]: r for r in figures(seen).collect()}
    center, spread = {}, {}
    for x in langs:
        own = found[x] if x in found and found[x]["texts"] >= 8 else found.get(None)
        center[x], spread[x] = (3.0, (3.0, 3.0)) if own is None else (own["center"], (max(0.05, own["spread"]), 2.0))
    out = LanguageModel(model("n"), center, spread, 6.0)
    out.limit = max(6.0, margin * _quantile(seen, out, 1 - false_rejections))
    return out


#: Surprises are counted in steps of 1 / STEPS, those beyond MOST_SURPRISE in one.
STEPS, MOST_SURPRISE = 256, 1 << 12


def _quantile(seen: DataFrame, model: LanguageModel, share: float) -> float:
    """The surprise, rounded up to a step, that at least `share` of all scored texts do not exceed; 0 without any."""
    kinds = [(x, model.center[x], *model.spread[x]) for x in model.center]
    marks = F.broadcast(seen.sparkSession.createDataFrame(kinds, "lang string, center double, fixed double, per_char double"))
    surprise = (F.col("entropy") - F.col("center")) / F.sqrt(F.col("fixed") ** 2 + F.col("per_char") ** 2 / F.col("n"))
    step = F.ceil(F.least(F.greatest(surprise, F.lit(0.0)), F.lit(float(MOST_SURPRISE))) * STEPS)
    # a row a step that occurs
    steps = seen.join(marks, "lang").groupBy(step.alias("step")).agg(F.count("*").alias("k")).orderBy("step").collect()
    if not steps:
        return 0.0
    below = np.cumsum([r["k"] for r in steps])
    return steps[int(np.searchsorted(below, share * below[-1] - 1e-9))]["step"] / STEPS


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add lang_pred, score (0 to 1) and rejected to every row; columns of these names are replaced.

    The language has the lowest cross-entropy per character of the whole text. Null texts, texts without a
    letter and a model without languages give `und`, 0 and rejected. A text is also rejected if its
    cross-entropy is far beyond those of labelled texts of its language, given its length. Ties go to the
    first language in order; repeated rows are judged one by one. The score is the languages' softmax with the
    evidence of 64 characters at most, as neighbouring characters are not independent.
    """
    require_columns(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType.fromDDL("lang_pred string, score double, rejected boolean"))
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.judge(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return docs.withColumn("__judged", judge(F.col(text))).select(*kept, "__judged.lang_pred", "__judged.score", "__judged.rejected")


def learning_rows(doc_id: str = "doc_id", folds: int = 4, held_out: int = 2):
    """True for rows whose crc32(doc_id as text) modulo `folds` is not `held_out`; null for a null id."""
    return crc_remainder(doc_id, folds) != held_out
