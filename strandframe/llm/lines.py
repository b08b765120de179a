"""Line dedup: pigeonhole blocks of normalised lines, SimHash, edit-similarity check, one occurrence a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, ROW_BYTES, bucket_groups, cut_by_tokens, pair_ends, rarest_tokens, require_columns, scratch_tables, shared_keys, small, stored

#: A line is keyed by PICKS of its blocks. Pairs may differ in APART of 64 fingerprint bits.
PICKS, APART = 8, 20
#: Words of a block, by the least number of words of a line; two lines on both sides of a limit have blocks of both kinds.
WIDTHS = {2: 0, 3: 6, 4: 20}
#: A block of more lines is crowded. Of more than BUCKET_LINES they are dealt by their rarest words before they are compared with each other.
CROWD, BUCKET_LINES = 32, 2048
#: Longs of bits of a line's words.
MARKS = 8
#: Four counters 16 bits apart in a long for lines of up to NARROW different words, two 32 bits apart for longer ones.
#: The highest bit of each counter stays free, and with it the sign.
SUMS, NARROW = 16, (1 << 14) - 1
LANES_16, LANES_32 = sum(1 << i for i in range(0, 64, 16)), sum(1 << i for i in range(0, 64, 32))


def normalised(line: Column) -> Column:
    """The lower-cased runs of letters and digits of a line, as an array; empty for a line without any."""
    return F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def simhashed(lines: DataFrame, keys: list[str], words: str = "words") -> DataFrame:
    """One row per row of `lines`, with half 0 and its SimHash `fp`: a bit is 1 if it is set in over half the hashes of its different words.

    Bits are counted in 16 sums of several counters each, combined before the shuffle; adding what a majority
    lacks to a power of two then shows each majority in its counter's top bit. A line too long for small
    counters has two rows, half 0 and 1, with a part of its bits each, to be joined by bit_or. Equal rows
    are counted apart from each other, by a number that only this step sees.
    """
    kinds = lines.select(*keys, F.monotonically_increasing_id().alias("__row"), F.array_distinct(words).alias("kinds")).withColumn("d", F.size("kinds"))
    wide = F.col("d") > NARROW
    each = kinds.select(*keys, "__row", "d", F.posexplode(F.when(wide, F.concat("kinds", "kinds")).otherwise(F.col("kinds"))).alias("at", "word"))
    half = F.when(wide & (F.col("at") >= F.col("d")), 1).otherwise(0)
    hashed = each.select(*keys, "__row", "d", half.alias("half"), F.expr("shiftrightunsigned(xxhash64(word), if(at >= d, 16, 0))").alias("x"), F.when(wide, F.lit(LANES_32)).otherwise(F.lit(LANES_16)).alias("lanes"))
    sums = [F.sum(F.shiftrightunsigned("x", i).bitwiseAND(F.col("lanes"))).alias(f"s{i}") for i in range(SUMS)]
    counted = hashed.groupBy("__row", *keys, "d", "half", "lanes").agg(*sums)
    top, lack = F.when(wide, 30).otherwise(14), (F.when(wide, (1 << 30) - 1).otherwise(NARROW) - F.shiftright("d", 1)).cast("long") * F.col("lanes")
    counted = counted.withColumns({"top": top, "lack": lack})
    bits = F.lit(0).cast("long")
    for i in range(SUMS):
        bits = bits.bitwiseOR(F.expr(f"shiftleft(shiftrightunsigned(s{i} + lack, top) & lanes, {i})"))
    return counted.withColumn("bits", bits).select(*keys, "half", F.expr("shiftleft(bits, half * 16)").alias("fp"))


def blocks(codes: Column, n: Column, similarity: float) -> Column:
    """The hashes of PICKS of a line's blocks, the runs of words that begin with those of the smallest codes.

    Lines within e edits of each other have the same words between the edits, so that one of e + 1 stretches is the
    same in both, wherever it lies; lines of `similarity` 0.8 have at most a fifth of the words as edits, and most
    stretches of such lines hold a whole block. Which blocks a line picks depends on their first words alone, so that
    similar lines pick the same.
    """
    shortest, longest = F.ceil(n * similarity - 1e-9), F.floor(n / similarity + 1e-9)
    spots = F.slice(F.sort_array(F.array_distinct(codes)), 1, PICKS)

    def runs(width: int) -> Column:
        # from where each word is first; those cut short by the line's end are none
        cut = F.transform(spots, lambda code: F.slice(codes, F.array_position(codes, code).cast("int"), width))
        return F.transform(F.filter(cut, lambda run: F.size(run) == width), lambda run: F.xxhash64(run))

    none, parts = F.array().cast("array<bigint>"), []
    limits = [*WIDTHS.values(), 1 << 30]
    for width, least, beyond in zip(WIDTHS, limits, limits[1:], strict=False):
        parts.append(F.when((longest >= least) & (shortest < beyond), runs(width)).otherwise(none))
    return F.array_distinct(F.concat(*parts))


def word_bits(lines: DataFrame) -> DataFrame:
    """(h1, b0, b1, ...): MARKS longs for each line (h1, c), with a bit set for each of its words."""
    words = lines.select("h1", F.explode(F.array_distinct("c")).alias("w"))
    return words.groupBy("h1").agg(*[F.bit_or(F.expr(f"if(pmod(w, {MARKS}) = {i}, shiftleft(1L, (w >> 8) & 63), 0L)")).alias(f"b{i}") for i in range(MARKS)])


def _fits(similarity: float) -> Column:
    """What word bits of similar lines pass: an edit takes the last of one word at most away, and with it one bit."""
    only = [" + ".join(f"bit_count({x}_b{i} & ~{y}_b{i})" for i in range(MARKS)) for x, y in ("ab", "ba")]
    return F.expr(" and ".join(f"{bits} <= {_bound(similarity)}" for bits in only))


def code_text(codes: Column, shift: int) -> Column:
    """One character for each 32-bit word code, by 19 of its bits: 2 ** 19 of them, from 10000 to 8FFFF in hexadecimal."""
    hexes = F.transform(codes, lambda c: F.hex(F.shiftrightunsigned(c, shift).bitwiseAND(F.lit((1 << 19) - 1)) + (1 << 16)))
    return F.decode(F.unhex(F.concat(F.lit("000"), F.array_join(hexes, "000"))), "UTF-32")


def texts_of(coded: DataFrame) -> DataFrame:
    """(h1, one, two): the words of lines (h1, c) as two texts of one character a word, of all bits of their codes."""
    return coded.select("h1", code_text(F.col("c"), 0).alias("one"), code_text(F.col("c"), 13).alias("two"))


def _bound(similarity: float) -> str:
    return f"cast(floor(greatest(a_n, b_n) * {1 - similarity:.6f}D + 1e-9D) as int)"


def _alike(similarity: float) -> Column:
    """What pairs must pass before their words are looked at: numbers of words and SimHash bits."""
    return F.expr(f"abs(a_n - b_n) <= {_bound(similarity)} and bit_count(a_fp ^ b_fp) <= {APART}")


def _similar(similarity: float) -> Column:
    """Edit distance by words at most the share 1 - similarity of the longer line.

    Words compare by 32 bits of hash, in two codes. Most similar pairs are close, which a narrow band shows first.
    """
    bound = _bound(similarity)

    def within(code: str) -> str:
        return f"(levenshtein(a_{code}, b_{code}, least({bound}, 8)) >= 0 or ({bound} > 8 and levenshtein(a_{code}, b_{code}, {bound}) >= 0))"

    return F.expr(f"{within('one')} and {within('two')}")


def _verified(pairs: DataFrame, coded: DataFrame, similarity: float, most: int = MOST_BROADCAST) -> DataFrame:
    """The pairs (a, b) whose lines are similar. Only texts of lines in pairs are made and dealt."""
    ends = {x: small(stored(pairs.select(F.col(x).alias("h1")).distinct()), most=most) for x in "ab"}
    # an inner join, as texts would be made below a semi join, of all lines
    wanted = stored(texts_of(coded.join(small(stored(pair_ends(pairs).distinct()), most=most), "h1")))
    for x in "ab":
        own = wanted.join(ends[x], "h1", "left_semi")
        pairs = pairs.join(own.select(F.col("h1").alias(x), F.col("one").alias(f"{x}_one"), F.col("two").alias(f"{x}_two")), x)
    return pairs.where(_similar(similarity)).select("a", "b")


def _runs(rows: DataFrame, texts: DataFrame, similarity: float = 0.8, most: int = MOST_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """(asked, indexed): rows of the same columns keyed by one of their rarest words too, such that similar lines of a bucket share one.

    Lines of n words with partners of up to n / `similarity` words differ from them in at most e words, repeats counted,
    so that they share one of their e + 1 rarest ones, whichever way words are counted.
    """
    # before the texts are made, of those rows alone
    wanted = small(stored(rows.select("h1").distinct()), most=most)
    coded = texts.join(wanted, "h1", "left_semi").select("h1", F.length("one").alias("n"), F.explode(F.split("one", "")).alias("word"))
    counted = coded.groupBy("h1", "n", "word").agg(F.count("*").cast("int").alias("times"))
    tokens = stored(counted.select("h1", "n", F.explode(F.sequence(F.lit(1), "times")).alias("time"), "word").select("h1", "n", F.xxhash64("word", "time").alias("token")))
    edits = F.floor(F.floor(F.col("n") / similarity + 1e-9) * (1 - similarity) + 1e-9).cast("int")
    return cut_by_tokens(rows, rarest_tokens(tokens, edits + 1))


def fuzzy_groups(lines: DataFrame, similarity: float = 0.8, most: int = MOST_BROADCAST) -> DataFrame:
    """(node, component): the connected groups of similar lines (h1, n, c, picks): a hash of a line's words, their number and codes, and its blocks().

    Lines meet by shared blocks, as shared_keys() says. Those that do get a SimHash and are compared as
    bucket_groups() says, crowded blocks cut by rare words. Nothing is capped: all pairs under a block are found.
    """
    # a line of n words has a partner only if a longer one, up to n / similarity words, may differ in a word
    able = lines.where(F.floor(F.floor(F.col("n") / similarity + 1e-9) * F.lit(round(1 - similarity, 6)) + F.lit(1e-9)) > 0).select("h1", "n", "c", "picks")
    members = shared_keys(able, F.col("picks"), None, similarity, most)
    wanted = stored(members.select("h1").distinct())
    coded = stored(able.drop("picks").join(small(wanted, most=most), "h1", "left_semi").dropDuplicates(["h1"]))
    prints = stored(simhashed(coded, ["h1"], "c").groupBy("h1").agg(F.bit_or("fp").alias("fp")))
    rows = stored(members.join(prints, "h1"))

    def coded_of(some: DataFrame) -> DataFrame:
        return coded.join(small(stored(some.select("h1").distinct()), most=most), "h1")

    return bucket_groups(
        rows,
        _alike(similarity),
        lambda pairs: _verified(pairs, coded, similarity, most),
        BUCKET_LINES,
        lambda large: _runs(large, texts_of(coded_of(large)), similarity, most),
        lambda rest: word_bits(coded_of(rest)),
        _fits(similarity),
    )


def line_rows(docs: DataFrame, doc_id: str, text: str, separator: str = "\n") -> DataFrame:
    """(doc_id, th, pos, words): a row per line, empty lines too; th is the text's hash."""
    source = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    # made before the explode, below which no filter on them can move and make them twice
    return source.select("doc_id", "th", F.posexplode(F.transform(F.split("text", separator), normalised)).alias("pos", "words"))


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, most: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, th, drop): the positions of lines to drop per document that loses any.

    Lines of equal words are one class. Classes link if they share a block, as blocks() and shared_keys() pick
    them, their 64-bit SimHashes by words differ in at most 20 bits, and their edit distance by words is at most
    1 - similarity (0.2 at most) of the longer one's words. Each connected group keeps its first occurrence: the
    smallest doc_id (nulls last), text hash and position. Lines whose length allows no edit have only equal
    lines as partners. Lines may have any number of words. Frames of class hashes are broadcast up to `most` bytes.
    """
    if similarity < 0.8:
        raise ValueError("similarity must be 0.8 or more")
    words = line_rows(docs, doc_id, text).where(F.size("words") > 0)
    coded = words.select("doc_id", "th", "pos", F.xxhash64("words").alias("h1"), F.size("words").alias("n"), F.transform("words", lambda w: F.hash(w)).alias("c"))
    # blocks are kept, as they are counted first and met later
    lines = stored(coded.withColumns({"h2": F.xxhash64("c"), "picks": blocks(F.col("c"), F.col("n"), similarity)}))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "pos")
    grouped = fuzzy_groups(lines, similarity, most)
    hint = F.broadcast if grouped.count() * 3 * ROW_BYTES <= most else lambda df: df
    classes = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    rooted = stored(classes.join(hint(grouped), classes.h1 == grouped.node, "left").where("copies > 1 or component is not null"))
    firsts = rooted.where("component is not null").groupBy("component").agg(F.min("first").alias("group_first"))
    several = rooted.join(hint(firsts), "component", "left").select("h1", "h2", F.coalesce("group_first", "first").alias("keep"))
    several = stored(several)
    occurrences = lines.select("doc_id", "th", "pos", "h1", "h2")
    doomed = occurrences.join(several, ["h1", "h2"]).where(~(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("th") == F.col("keep.th")) & (F.col("pos") == F.col("keep.pos"))))
    return doomed.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None, counts: bool = False, similarity: float = 0.8, most: int = MOST_BROADCAST
) -> DataFrame:
    """Every row of `docs`, its text without the lines that dropped_lines() names.

    Rows stay, even if all their lines go. Lines without a letter or digit stay too. Null texts stay null and
    empty ones empty. Rows that repeat id and text are one document here and lose the same lines. `n_chars`
    names a column to fill with the new length; `counts` adds n_lines and n_dropped. Documents that lose
    lines are broadcast up to `most` bytes of positions and joined by shuffling beyond.
    """
    require_columns(docs, doc_id, text)
    with scratch_tables(docs.sparkSession):
        drops = stored(dropped_lines(docs, doc_id, text, similarity, most), keep=True)
    drops = drops.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("drop").alias("__drop"))
    size = drops.agg(F.count("*") * 4 * ROW_BYTES + F.coalesce(F.sum(F.size("__drop")), F.lit(0)) * 4).first()[0]
    if size <= most:
        drops = F.broadcast(drops)
    marked = docs.withColumn("__hash", F.xxhash64(text))
    both = marked.join(drops, marked[doc_id].eqNullSafe(drops["__id"]) & (marked["__hash"] == drops["__th"]), "left").withColumn("__lines", F.split(text, "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__drop")
    new = F.when(F.col("__drop").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n"))
    out = both.withColumn("__new", new)
    columns = [F.col("__new").alias(c) if c == text else F.length("__new").cast(docs.schema[c].dataType).alias(c) if c == n_chars else F.col(c) for c in docs.columns]
    extra = [F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped")] if counts else []
    return out.select(*columns, *extra)
