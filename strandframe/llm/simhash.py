"""SimHash near-dedup: fingerprints, deletion-variant candidate search and connected groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, bucket_groups, checkpointed, connected_components, cut_by_tokens, pair_ends, rarest_tokens, require_columns, scratch_tables, shared_keys, small, stored

#: A bucket of more candidate pairs than this is cut further by the bits that it does not share yet.
BUCKET_PAIRS = 65_536
#: A bucket of more texts that may be similar is cut by their rarest shingles.
BUCKET_TEXTS = 64


#: Near-duplicates by shingle sets meet under PICKS, their smallest shingle hashes.
PICKS = 8
#: Similar sets' fingerprints differ in fewer bits than this, at a similarity of 0.8 in 10 on average.
APART = 22


def hashed_windows(text: str | None, words: int, seed: int, window: int = 65_536) -> Iterator[np.ndarray]:
    """The shingle hashes of a whole text, in windows, so that memory does not follow its length.

    Only A-Z is lower-cased; words are runs without ASCII white space. Fewer words than a shingle make one
    shingle; no words make none.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(tokens) - words + 1) if tokens else 0
    for start in range(0, n, window):
        part = tokens[start : min(start + window, n) + words - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(part)]
        yield np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), dtype=">u8")


def majority(windows: Iterable[np.ndarray]) -> int:
    """The 64-bit SimHash of hashes: a bit is 1 if it is set in over half of them; zero of none."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in windows:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprint(text: str | None, words: int = 3, seed: int = 42, window: int = 65_536) -> int:
    """The 64-bit SimHash of a whole text over its shingles, repeats included."""
    return majority(hashed_windows(text, words, seed, window))


def sketched(text: str | None, words: int, size: int = PICKS, seed: int = 42) -> tuple[int, np.ndarray]:
    """A text's SimHash and the `size` smallest of its different shingle hashes, as signed longs in rising order."""
    least = np.array([], dtype=np.int64)

    def watched() -> Iterator[np.ndarray]:
        nonlocal least
        for hashes in hashed_windows(text, words, seed):
            least = np.unique(np.concatenate([least, hashes.astype(np.uint64).view(np.int64)]))[:size]
            yield hashes

    return majority(watched()), least


def with_fingerprints(docs: DataFrame, text: str = "text", words: int = 3, seed: int = 42, column: str = "fp") -> DataFrame:
    """Add the fingerprint of each whole text as a signed long; null text counts as empty."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words, seed) for t in texts], dtype="int64")

    return docs.withColumn(column, prints(F.col(text)))


def with_sketches(docs: DataFrame, text: str, words: int) -> DataFrame:
    """Add each whole text's fingerprint `fp` and `sketch`, its smallest shingle hashes."""

    @F.pandas_udf("fp long, sketch array<long>")
    def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            made = [sketched(t, words) for t in texts]
            yield pd.DataFrame({"fp": [f for f, _ in made], "sketch": [x for _, x in made]})

    return docs.withColumn("__both", sketches(F.col(text))).select(*docs.columns, "__both.fp", "__both.sketch")


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """All pairs (a < b) of different fingerprints in `prints.fp` that differ in at most `max_bits` bits (1 to 3).

    The 64 bits are cut into two segments, so that one of them differs by at most one bit. Each segment is
    indexed as it is and with each of its one bits wiped; a segment whose bit is already zero is its own
    wiped variant, so an equality join of variants with plain segments meets every such pair. Buckets of
    many candidate pairs are cut the same way by the bits they don't share yet; after three cuts a bucket
    holds a fixed number of fingerprints at most. Nothing is capped.
    """
    if not 1 <= max_bits <= 3:
        raise ValueError("max_bits must be 1, 2 or 3")
    rows = _variants(prints.where(F.col("fp").isNotNull()).select("fp").distinct(), 1)
    found: list[DataFrame] = []
    for level in (1, 2, 3):
        keys, plain = [f"k{i}" for i in range(1, level + 1)], F.col(f"plain{level}")
        stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(plain).alias("plain_n")).where("n > 1 and plain_n > 0")
        # Spark sizes exploded rows as those before the explode and would broadcast them all; what comes of this join is sized the same
        members = checkpointed(rows.join(stats.hint("merge"), keys))
        hot = F.col("n") * F.col("plain_n") > (BUCKET_PAIRS if level < 3 else 1 << 62)
        found.append(_verified(members.where(~hot), keys, level, max_bits))
        if level == 3 or (cut := members.where(hot).drop("n", "plain_n")).isEmpty():
            break
        rows = _variants(cut, level + 1)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(members: DataFrame, keys: list[str], level: int, max_bits: int) -> DataFrame:
    """Pairs of a bucket: one is plain at the last cut, one (either) at each cut before, and few bits differ."""
    before = [f"plain{i}" for i in range(1, level)]
    one = members.where(f"plain{level}").select(*keys, F.col("fp").alias("a"), *[F.col(c).alias(f"a_{c}") for c in before])
    two = members.select(*keys, F.col("fp").alias("b"), *before)
    pairs = one.join(two.hint("merge"), keys).where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    for c in before:
        pairs = pairs.where(F.col(f"a_{c}") | F.col(c))
    return pairs.select("a", "b")


def _variants(rows: DataFrame, level: int) -> DataFrame:
    """A row per half of the bits that are not shared yet: plain, and with each one bit wiped.

    Key k{level} holds the half's first bit above bit 40 and its value below; plain{level} tells which it is.
    """
    width = 64 >> level
    if level == 1:
        starts = F.array(F.lit(0), F.lit(32))
    else:
        rest = F.shiftright(f"k{level - 1}", 40).cast("int").bitwiseXOR(F.lit(width * 2))
        starts = F.array(rest, rest + width)
    halves = rows.withColumn("__start", F.explode(starts)).withColumn("__half", F.expr(f"shiftrightunsigned(fp, __start) & {(1 << width) - 1}L"))
    set_bits = F.expr(f"filter(sequence(0, {width - 1}), b -> getbit(__half, b) = 1)")
    values = F.concat(F.array("__half"), F.transform(set_bits, lambda b: F.col("__half").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    out = halves.withColumn("__value", F.explode(values))
    key = F.shiftleft(F.col("__start").cast("long"), 40).bitwiseOR(F.col("__value"))
    return out.select(*rows.columns, key.alias(f"k{level}"), (F.col("__value") == F.col("__half")).alias(f"plain{level}"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest doc_id reachable over links of at most `max_bits` differing bits. Null and
    empty texts share fingerprint zero, which links like any other. Null doc_ids are never a component_id
    unless the whole group has none. Repeated rows stay; other columns are not read. An empty table gives
    no rows.
    """
    require_columns(docs, doc_id, text)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = checkpointed(with_fingerprints(source).select("doc_id", "fp"))
    with scratch_tables(docs.sparkSession):
        groups = stored(_groups(prints, max_bits), keep=True)
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least_id").alias("component_id"))


def _groups(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root, least_id): each fingerprint's group and the smallest id in it."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("own_id"))
    linked = connected_components(links(prints, max_bits))
    rooted = classes.join(linked, classes.fp == linked.node, "left").select("fp", F.coalesce("component", "fp").alias("root"), "own_id")
    least = rooted.groupBy("root").agg(F.min("own_id").alias("least_id"))
    return rooted.drop("own_id").join(least, "root")


def shingles(text: Column, words: int) -> Column:
    """The distinct hashes of a text's shingles, of the same words as in fingerprint()."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = F.transform(F.filter(F.split(lower, r"[\x20\x09-\x0d]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def of(t: Column) -> Column:
        run = F.transform(F.sequence(F.lit(0), F.size(t) - words), lambda i: F.xxhash64(*[F.get(t, i + k) for k in range(words)]))
        return F.when(F.size(t) >= words, F.array_distinct(run)).when(F.size(t) > 0, F.array(F.xxhash64(t))).otherwise(F.array().cast("array<bigint>"))

    # bound to a variable, so that the words are split once
    return F.get(F.transform(F.array(tokens), of), F.lit(0))


def similar_groups(docs: DataFrame, prints: DataFrame, words: int, similarity: float, most: int = MOST_BROADCAST) -> DataFrame:
    """(node, component): groups of texts, by hash, whose sets of shingles share at least `similarity` of their union.

    `prints` has th, fp and sketch. Candidates share one of the smallest hashes of their shingles, as
    shared_keys() keys them, and differ in at most APART bits of their fingerprints; each is checked by its
    whole sets. All pairs of a bucket are found: large ones are cut by rare shingles, of which such pairs share one.
    """
    texts = stored(prints.groupBy("th").agg(F.min("fp").alias("fp"), F.first("sketch").alias("sketch")).select(F.col("th").alias("h1"), F.lit(0).alias("n"), "fp", "sketch"))
    members = shared_keys(texts, F.col("sketch"), None, similarity, most)
    rows = stored(members.join(texts.select("h1", "fp"), "h1"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        chosen = docs.select(F.xxhash64("text").alias("h1"), "text").join(small(wanted, most=most), "h1", "left_semi").dropDuplicates(["h1"])
        return chosen.select("h1", shingles(F.col("text"), words).alias("set"))

    def verified(pairs: DataFrame) -> DataFrame:
        sets = stored(sets_of(stored(pair_ends(pairs).distinct())))
        both = pairs.join(sets.select(F.col("h1").alias("a"), F.col("set").alias("a_set")), "a").join(sets.select(F.col("h1").alias("b"), F.col("set").alias("b_set")), "b")
        common = F.size(F.array_intersect("a_set", "b_set"))
        return both.where(common >= (F.size("a_set") + F.size("b_set") - common) * similarity - 1e-9).select("a", "b")

    def cut(large: DataFrame) -> tuple[DataFrame, DataFrame]:
        # of such sets all but 1 - similarity of one are in the other
        tokens = sets_of(stored(large.select("h1").distinct())).select("h1", F.size("set").alias("n"), F.explode("set").alias("token"))
        return cut_by_tokens(large, rarest_tokens(stored(tokens), F.floor(F.col("n") * (1 - similarity) + 1e-9).cast("int") + 1))

    return bucket_groups(rows, F.expr(f"bit_count(a_fp ^ b_fp) <= {APART}"), verified, BUCKET_TEXTS, cut)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = 3, words: int = 3, similarity: float | None = None) -> DataFrame:
    """Keep one document of each group of near-duplicates, with all its columns.

    Documents link if their fingerprints differ in at most `max_bits` bits or, with a `similarity`, if their sets
    of shingles share at least that part of their union and similar_groups() brings them together.

    The kept row has the group's smallest doc_id (nulls last; then the smallest text hash); of fully repeated
    rows one stays.
    """
    require_columns(docs, doc_id, text)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # a null text counts as empty
    hashed = F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")
    if similarity is None:
        prints = checkpointed(with_fingerprints(source, words=words).select("doc_id", "fp", hashed))
        with scratch_tables(docs.sparkSession):
            grouped = stored(_groups(prints, max_bits).select("fp", "root"), keep=True)
        rooted = prints.join(grouped, "fp")
    else:
        with scratch_tables(docs.sparkSession):
            sketches = stored(with_sketches(source, "text", words).select("doc_id", "fp", "sketch", hashed))
            prints = stored(sketches.select("doc_id", "th"), keep=True)
            grouped = stored(similar_groups(source.withColumn("text", F.coalesce("text", F.lit(""))), sketches, words, similarity), keep=True)
        rooted = prints.join(grouped, prints.th == grouped.node, "left").withColumn("root", F.coalesce("component", "th"))
    order = F.struct(F.col("doc_id").isNull().alias("is_null"), "doc_id", "th")
    winners = rooted.groupBy("root").agg(F.min(order).alias("w"), F.count("*").alias("n")).select(F.col("w.doc_id").alias("__id"), F.col("w.th").alias("__th"), "n")
    marked = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = marked.join(winners, marked[doc_id].eqNullSafe(winners["__id"]) & (marked["__hash"] == winners["__th"]), "left_semi")
    repeats = prints.groupBy("doc_id", "th").count().where("count > 1")
    if not repeats.isEmpty():
        kept = kept.dropDuplicates([doc_id, "__hash"])
    return kept.drop("__hash")
