"""Secret scans: pattern spans, and random-looking strings by a test battery with length-aware false-discovery control."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, require_columns

# The base patterns, the shortest value or match of each, and the order of kinds.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_VALUE = 12

#: Per encoding what its strings look like, its alphabet, its character classes with their sizes,
#: and for words or numbers written in it the index of coincidence and how often neighbours change class.
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", ((r"[0-9]", 10), (r"[a-f]", 6)), 0.10, 0.2),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ((r"[A-Z]", 26), (r"[2-7]", 6)), 0.066, 0.1),
    ("base62", r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", ((r"[A-Z]", 26), (r"[a-z]", 26), (r"[0-9]", 10)), 0.066, 0.25),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", ((r"[A-Z]", 26), (r"[a-z]", 26), (r"[0-9]", 10), (r"[+/]", 2)), 0.066, 0.25),
)
#: Serial correlation, as a size, of what is no random string: counters, runs and repeated words.
ORDINARY_SERIAL = 0.5
BINS_PER_DECADE, LAST_BIN = 20, 400
#: Positions are added up within blocks of so many matches, then over blocks.
BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matches(text: Column, pattern: str, group: int) -> tuple[Column, Column, Column]:
    """(what lies between matches, the matches, their groups) of a text; the first has one element more."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.split(text, pattern, -1), whole, whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def masked(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """The text with spaces in place of all characters of its matches that `keep` keeps."""
    between, whole, values = _matches(text, pattern, group)
    blank = F.zip_with(whole, values, lambda w, v: F.when(keep(v), F.repeat(F.lit(" "), F.length(w))).otherwise(w) if keep else F.repeat(F.lit(" "), F.length(w)))
    pieces = F.zip_with(between, blank, lambda b, w: F.concat(b, F.coalesce(w, F.lit(""))))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.array_join(pieces, "")).otherwise(text)


def match_spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """array<struct<start,end,value>>: all leftmost non-overlapping matches, in code points, end exclusive.

    What lies between matches and the matches themselves alternate, so their lengths add up to positions, in
    blocks of matches and then over blocks. `value` is the match's `group`; `keep` may drop matches by it afterwards.
    """
    between, whole, values = _matches(text, pattern, group)
    parts = F.zip_with(F.zip_with(F.slice(between, F.lit(1), F.size(whole)), whole, lambda b, w: F.struct(F.length(b).alias("gap"), F.length(w).alias("len"))), values, lambda p, v: F.struct(p["gap"].alias("gap"), p["len"].alias("len"), v.alias("value")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def walk(block: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(F.lit(0).alias("at"), none.alias("spans")),
            lambda acc, p: F.struct(
                (acc["at"] + p["gap"] + p["len"]).alias("at"),
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + p["len"]).alias("end"), p["value"].alias("value")))).alias("spans"),
            ),
        )

    def joined_blocks(blocks: Column) -> Column:
        starts = F.aggregate(
            blocks, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts")), lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))
        )["starts"]
        return F.flatten(F.zip_with(blocks, starts, lambda b, at: F.transform(b["spans"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["value"].alias("value")))))

    def spans(all_parts: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_parts) - 1) / BLOCK).cast("int")), lambda i: walk(F.slice(all_parts, i * BLOCK + 1, F.lit(BLOCK))))
        return _let(blocks, joined_blocks)

    found = _let(parts, spans)
    found = F.filter(found, lambda s: keep(s["value"])) if keep else found
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution (Abramowitz and Stegun 26.2.17; error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def chi_square_tail(x: Column, df: int) -> Column:
    """P(chi-squared > x), by Wilson and Hilferty's cube root."""
    k = 2.0 / (9.0 * df)
    return normal_tail((F.pow(F.greatest(x, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - k)) / k**0.5)


def _tested(value: Column) -> Column:
    """struct<encoding, band, bin, uniform> of a candidate: its tests under the encoding that its characters suggest."""
    names = [e[0] for e in ENCODINGS]
    guess = F.lit(names[-1])
    for name, looks, *_ in reversed(ENCODINGS[:-1]):
        guess = F.when(F.regexp_like(value, F.lit(looks)), name).otherwise(guess)
    return _let(F.struct(guess.alias("encoding"), F.regexp_replace(value, "=+$", "").alias("body")), _battery)


def _battery(candidate: Column) -> Column:
    encoding, body = candidate["encoding"], candidate["body"]

    def pick(values: list) -> Column:
        """The encoding's own of these values."""
        out = F.lit(values[-1])
        for e, v in reversed(list(zip(ENCODINGS[:-1], values[:-1], strict=True))):
            out = F.when(encoding == e[0], v).otherwise(out)
        return out

    body = F.when(encoding == "hex", F.lower(body)).when(encoding == "base64", F.translate(body, "-_", "+/")).otherwise(body)
    sizes = [float(len(e[2])) for e in ENCODINGS]
    size, alphabet = pick(sizes), pick([e[2] for e in ENCODINGS])
    # one struct after the other, so that each is worked out once
    codes = F.transform(F.split(body, ""), lambda c: (F.call_function("position", c, alphabet) - 1).cast("double"))
    first = F.struct(body.alias("body"), F.length(body).cast("double").alias("n"), codes.alias("codes"), size.alias("size"))
    return _let(first, lambda s: _let(_statistics(s, pick), lambda t: _judged(encoding, t, pick)))


def _statistics(s: Column, pick: Callable[[list], Column]) -> Column:
    body, n, codes, size = s["body"], s["n"], s["codes"], s["size"]
    counts = F.transform(F.array_distinct(codes), lambda c: n - F.size(F.array_remove(codes, c)))
    squares = F.aggregate(counts, F.lit(0.0), lambda acc, k: acc + k * k)

    def apart(classes: tuple) -> Column:
        x = F.lit(0.0)
        for pattern, share in classes:
            expected = n * (share / sum(k for _, k in classes))
            x = x + F.pow(F.regexp_count(body, F.lit(pattern)).cast("double") - expected, F.lit(2.0)) / expected
        return x

    kinds = F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "A" * 26 + "a" * 26 + "0" * 10 + "++")
    changes = n - F.regexp_count(kinds, F.lit("A+|a+|0+|[+]+")).cast("double")
    half, mean, spread = size / 2, (size - 1) / 2, (size * size - 1) / 12
    steps = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    low = F.size(F.filter(codes, lambda c: c < half)).cast("double")
    runs = 1 + F.aggregate(steps, F.lit(0.0), lambda acc, p: acc + F.when((p["a"] < half) != (p["b"] < half), 1.0).otherwise(0.0))
    serial = F.aggregate(steps, F.lit(0.0), lambda acc, p: acc + (p["a"] - mean) * (p["b"] - mean)) / spread / (n - 1)
    return F.struct(
        n.alias("n"), size.alias("size"), (squares * size / n - n).alias("x"), pick([apart(e[3]) for e in ENCODINGS]).alias("x_class"), (n - 1 - changes).alias("changes"), low.alias("low"), runs.alias("runs"), serial.alias("serial")
    )


def _judged(encoding: Column, t: Column, pick: Callable[[list], Column]) -> Column:
    n, size, x = t["n"], t["size"], t["x"]
    # how well it agrees with uniform text: four tests, Bonferroni
    p_alphabet = 2 * normal_tail(F.abs((x - (size - 1)) / F.sqrt(2 * (size - 1) * (1 - 1 / n))))
    p_class = pick([chi_square_tail(t["x_class"], len(e[3]) - 1) for e in ENCODINGS])
    expected_runs = 2 * t["low"] * (n - t["low"]) / n + 1
    variance = (expected_runs - 1) * (expected_runs - 2) / (n - 1)
    p_runs = F.when(variance > 0, 2 * normal_tail(F.abs((t["runs"] - expected_runs) / F.sqrt(F.greatest(variance, F.lit(1e-9)))))).otherwise(0.0)
    p_serial = 2 * normal_tail(F.abs(t["serial"]) * F.sqrt(n - 1))
    uniform = F.least(F.lit(1.0), 4 * F.least(p_alphabet, p_class, p_runs, p_serial))
    # how rarely words or numbers look like this: their characters repeat (a non-central statistic whose distance
    # grows with the length), their neighbours stay in one class, and they are correlated; Fisher's sum of the three
    apart = n * (size * pick([e[4] for e in ENCODINGS]) - 1)
    w_alphabet = normal_tail(-(x - (size - 1 + apart)) / F.sqrt(2 * (size - 1 + 2 * apart)))
    rate = pick([e[5] for e in ENCODINGS])
    w_runs = normal_tail((t["changes"] - (n - 1) * rate) / F.sqrt((n - 1) * rate * (1 - rate)))
    w_serial = normal_tail((ORDINARY_SERIAL - F.abs(t["serial"])) * F.sqrt(n - 1))
    fisher = -2 * sum((F.log(F.greatest(w, F.lit(1e-30))) for w in (w_alphabet, w_runs, w_serial)), F.lit(0.0))
    bin_ = F.least(F.lit(LAST_BIN), F.floor(-F.log10(F.greatest(chi_square_tail(fisher, 6), F.lit(1e-30))) * BINS_PER_DECADE)).cast("int")
    return F.struct(encoding.alias("encoding"), F.floor(F.log2(n) * 2).cast("int").alias("band"), bin_.alias("bin"), uniform.alias("uniform"))


def discovery_limits(candidates: DataFrame, rate: float) -> dict[tuple[str, int], int]:
    """Per encoding and length band the least bin whose strings are discoveries at the false-discovery rate.

    Benjamini and Hochberg's step-up rule on binned p-values, by each bin's upper edge. The table that it
    reads has a row per encoding, band and bin, whatever the number of documents.
    """
    counted = candidates.groupBy("encoding", "band", "bin").agg(F.count("*").alias("n")).collect()
    strata: dict[tuple[str, int], dict[int, int]] = {}
    for r in counted:
        strata.setdefault((r["encoding"], r["band"]), {})[r["bin"]] = r["n"]
    limits = {}
    for key, bins in strata.items():
        total, rank = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            rank += bins[b]
            if 10 ** (-b / BINS_PER_DECADE) * total / rank <= rate:
                limits[key] = b
    return limits


def find_secrets(docs: DataFrame, text: str = "text", rate: float = 0.01, least_uniform: float = 0.001) -> DataFrame:
    """Replace `text` by `secrets`, an array<struct<kind,start,end>> by start and kind; other columns stay.

    Base kinds are the patterns above. Kind random: runs of 20 key characters or more in what base spans
    leave over, that the battery (alphabet and class chi-squared, runs, serial correlation; Bonferroni) can't tell
    from uniform text at `least_uniform`, and that words of that length would look like (in repeats, class changes and
    serial correlation, joined by Fisher's rule) at the false-discovery `rate` only, per encoding and band of lengths.
    Null texts count as empty and have no secrets; repeated rows are scanned one by one; spans of one start are in
    the order of KINDS. No row moves between tasks; only counts per encoding, length band and bin are gathered.
    """
    require_columns(docs, text)
    others = [c for c in docs.columns if c not in (text, "secrets")]
    whole = F.coalesce(F.col(text), F.lit(""))

    def named(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))

    base = F.concat(
        named(match_spans(whole, ASSIGN, lambda v: F.length(v) >= ASSIGN_VALUE, 2), "assign"), named(match_spans(whole, ACCESS), "access"), named(match_spans(whole, HEX), "hex")
    )
    long = lambda v: F.length(v) >= ASSIGN_VALUE
    # a base span's rest that is long enough for a candidate matches its pattern again, so one mask after the other hides all
    left = masked(masked(masked(whole, ASSIGN, long, 2), ACCESS), HEX)
    scanned = docs.withColumn("__base", base).withColumn("__runs", match_spans(left, CANDIDATE))
    tested = F.transform("__runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), _tested(r["value"]).alias("test")))
    rows = checkpointed(scanned.select(*others, "__base", tested.alias("__tested")))
    limits = discovery_limits(rows.select(F.explode("__tested.test").alias("t")).select("t.encoding", "t.band", "t.bin"), rate)
    table = F.create_map(*[F.lit(x) for (encoding, band), least in sorted(limits.items()) for x in (f"{encoding}:{band}", least)]) if limits else F.expr("cast(map() as map<string,int>)")
    random = F.filter(
        "__tested",
        lambda t: (t["test"]["uniform"] >= least_uniform)
        & F.coalesce(t["test"]["bin"] >= F.try_element_at(table, F.concat(t["test"]["encoding"], F.lit(":"), t["test"]["band"].cast("string"))), F.lit(False)),
    )
    spans = F.array_sort(F.concat("__base", F.transform(random, lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")))))
    names = F.array(*[F.lit(k) for k in KINDS])
    secrets = F.transform(spans, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select(*others, secrets.alias("secrets"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of each base kind, the SHA-256 of the joined base spans, and all spans joined."""
    found = find_secrets(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    base = F.filter("secrets", lambda s: s["kind"] != "random")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
