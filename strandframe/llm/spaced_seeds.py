"""Benchmark decontamination: spaced-seed hashes joined with the benchmark, verified around each hit."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, ROW_BYTES, checkpointed, require_columns, small

#: As many masks as a window may need; MOST_SPAN is the longest window whose masks are found by enumeration.
MOST_MASKS, MOST_SPAN = 5, 16


@lru_cache(maxsize=None)
def masks_for(n: int, wrong: int) -> tuple[tuple[int, ...], ...]:
    """Masks, as the places they take, one of which fits somewhere in every window of `n` tokens of which `wrong` differ.

    All take equally many places, as many as at most MOST_MASKS masks allow.
    """
    if n > MOST_SPAN:
        # some run between the differing tokens is that long
        return (tuple(range(-(-(n - wrong) // (wrong + 1)))),)
    windows = [sum(1 << i for i in c) for c in combinations(range(n), wrong)]
    for weight in range(n - wrong, 0, -1):
        fits, left, chosen = {}, (1 << len(windows)) - 1, []
        for mask in ((0, *rest) for rest in combinations(range(1, n), weight - 1)):
            bits = sum(1 << i for i in mask)
            fits[mask] = sum(1 << k for k, w in enumerate(windows) if any(not bits << o & w for o in range(n - mask[-1])))
        while left and len(chosen) < MOST_MASKS:
            chosen.append(max(fits, key=lambda m: (fits[m] & left).bit_count()))
            left &= ~fits[chosen[-1]]
        if not left:
            return tuple(chosen)
    raise ValueError("a window needs a token that agrees")


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits; none for a null text."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


Mask = tuple[int, tuple[int, ...]]


def _seeds(rows: DataFrame, hashes: str, masks: list[Mask]) -> DataFrame:
    """A row per position and mask (span, places), with `at`, the mask's `span` and the `seed` of the tokens that it takes.

    All masks are laid on a text in one pass, whatever the lengths of the windows that they are for.
    """
    places = F.size(hashes) - min(m[-1] for _, m in masks)
    placed = rows.withColumn("__n", F.explode(F.when(places > 0, F.sequence(F.lit(0), places * len(masks) - 1))))
    placed = placed.withColumn("at", F.floor(F.col("__n") / len(masks)).cast("int")).withColumn("__m", F.col("__n") % len(masks))

    def by_mask(values: list) -> Column:
        if len(set(values)) == 1:
            return F.lit(values[0])
        out = F.lit(values[-1])
        for m in range(len(masks) - 2, -1, -1):
            out = F.when(F.col("__m") == m, F.lit(values[m])).otherwise(out)
        return out

    placed = placed.where(F.col("at") + by_mask([m[-1] for _, m in masks]) < F.size(hashes))
    most = max(len(m) for _, m in masks)
    # a mask of fewer places takes nulls, which hash to nothing; its number tells it from others
    taken = [F.get(hashes, F.col("at") + by_mask([m[i] if i < len(m) else None for _, m in masks])) for i in range(most)]
    numbers = [100 * span + [m for s, m in masks if s == span].index(mask) for span, mask in masks]
    return placed.withColumn("span", by_mask([span for span, _ in masks])).withColumn("seed", F.xxhash64(by_mask(numbers), *taken)).drop("__n", "__m")


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least_tokens: int = 13,
    similarity: float = 0.8,
    around: int = 32,
    shortest_item: int = 1,
    most: int = MOST_BROADCAST,
) -> DataFrame:
    """(doc_id, item_id, n_hits, matched_tokens, doc_token): documents that hold text of benchmark items.

    Masks hash every position of items and documents, leaving out some tokens; equal hashes are hits. The masks
    have a hit in every overlap that the check accepts. Around
    the hits of one alignment, up to `around` tokens each way, both are compared: the pair counts if some `least_tokens`
    consecutive places (all of a shorter item) agree in at least the share `similarity`. n_hits counts
    verified alignments, matched_tokens the most agreeing places of one, doc_token where the first starts.

    Items of fewer than `least_tokens` tokens have masks of their own length; items of fewer than `shortest_item`
    tokens are left out, as a text may hold a word or two of anything. Items without tokens, null texts and
    empty tables give no rows. Repeated rows of one doc_id or item_id count together; null ids
    match as a value of their own. The benchmark's seeds and the documents with hits are broadcast up to
    `most` bytes and joined by shuffling beyond, with equal results.
    """
    require_columns(docs, doc_id, text)
    require_columns(benchmark, item_id, item_text)
    items = benchmark.select(F.col(item_id).alias("item_id"), F.regexp_extract_all(F.lower(F.coalesce(item_text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("words"))
    items = checkpointed(items.select("item_id", F.xxhash64("words").alias("item_key"), F.transform("words", lambda w: F.xxhash64(w)).alias("item")).where(F.size("item") >= max(1, shortest_item)).distinct())
    # each item is seeded by the window that the check needs; there are `least_tokens` such lengths at most
    spans = sorted(r[0] for r in items.select(F.least(F.lit(least_tokens), F.size("item"))).distinct().collect())
    source = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    hashed = source.select("doc_id", "th", token_hashes(F.col("text")).alias("own"))
    masks = [(span, m) for span in spans or [least_tokens] for m in masks_for(span, span - ceil(span * similarity - 1e-9))]
    seeded = _seeds(items.withColumn("own_span", F.least(F.lit(least_tokens), F.size("item"))), "item", masks).where("span = own_span")
    seeded = checkpointed(seeded.select("seed", "item_id", "item_key", F.col("at").alias("item_at")))
    hits = _seeds(hashed, "own", masks).select("doc_id", "th", "at", "seed").join(small(seeded, 4, most), "seed")
    spots = checkpointed(
        hits.groupBy("doc_id", "th", "item_id", "item_key", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(F.min("item_at").alias("first"), F.max("item_at").alias("last"))
    )
    # the hits' documents are tokenised again for the tokens beside each item
    asked = spots.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_list(F.struct("item_id", "item_key", "diagonal", "first", "last")).alias("spots"))
    asked = F.broadcast(asked) if spots.count() * 7 * ROW_BYTES <= most else asked
    again = source.join(asked, source.doc_id.eqNullSafe(asked["__id"]) & (source.th == asked["__th"])).select("doc_id", token_hashes(F.col("text")).alias("own"), "spots")
    placed = again.select("doc_id", F.explode(F.transform("spots", lambda s: F.struct(*_beside(s, around, least_tokens)))).alias("s")).select("doc_id", "s.*")
    both = placed.join(items, placed.item_key.eqNullSafe(items.item_key) & placed.item_id.eqNullSafe(items.item_id)).select(
        "doc_id", placed.item_id, "start", "part", F.slice("item", F.col("item_start") + 1, F.size("part")).alias("item_part"), F.least(F.lit(least_tokens), F.size("item")).alias("need")
    )
    same = F.zip_with("part", "item_part", lambda a, b: F.when(a == b, 1).otherwise(0))
    aligned = both.withColumn("same", same).where(F.size("same") >= F.col("need"))
    windows = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("need") + 1), lambda i: F.aggregate(F.slice("same", i, F.col("need")), F.lit(0), lambda acc, x: acc + x))
    good = aligned.where(F.exists(windows, lambda n: n >= F.ceil(F.col("need") * similarity)))
    matched = F.aggregate("same", F.lit(0), lambda acc, x: acc + x)
    return good.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_hits"), F.max(matched).cast("long").alias("matched_tokens"), F.min("start").cast("long").alias("doc_token"))


def _beside(spot: Column, around: int, longest: int) -> list[Column]:
    """The document's tokens from `around` before a diagonal's first hit to `around` after its last, inside both texts' fronts."""
    item_start = F.greatest(spot["first"] - around, F.lit(0), -spot["diagonal"])
    start = item_start + spot["diagonal"]
    part = F.slice("own", start + 1, spot["last"] + longest + around - item_start)
    return [spot["item_id"].alias("item_id"), spot["item_key"].alias("item_key"), item_start.alias("item_start"), start.alias("start"), part.alias("part")]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest_item: int = 5, most: int = MOST_BROADCAST, **options) -> DataFrame:
    """Keep the documents without benchmark text, with all their columns.

    Items of fewer than `shortest_item` tokens contaminate nothing: else a benchmark item of one word would empty the
    corpus. All rows of a contaminated doc_id go; rows with a null id are judged together. Ids to drop are broadcast
    up to `most` bytes and joined by shuffling beyond.
    """
    found = find_overlaps(docs, benchmark, doc_id, text, shortest_item=shortest_item, most=most, **options)
    bad = small(checkpointed(found.select(F.col("doc_id").alias("__bad")).distinct()), most=most)
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["__bad"]), "left_anti")
