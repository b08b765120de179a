"""Genotype-shaped spans in text: found by name and place, counted, or blanked; the text itself is never returned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a rendered genotype looks like.
ALLELE, CHROM, RSID = "[ACGTID0]", r"(?:\d{1,2}|[XYM]|MT|PAR)", r"(?:rs|i)\d+"
SEPARATOR = r"(?:[ \t]*[|│┆║┊][ \t]*|[ \t]+|(?:\\t)+|(?:\\s)+)"
PATTERNS = {
    "ancestry_row": rf"(?md)^\s*{RSID}[ \t]+{CHROM}[ \t]+\d+[ \t]+{ALLELE}[ \t]+{ALLELE}\s*$",
    "merged_row": rf"(?md)^\s*{RSID}[ \t]+{CHROM}[ \t]+\d+[ \t]+(?:{ALLELE}{{1,2}}|--)\s*$",
    "escaped_row": rf"{RSID}{SEPARATOR}{CHROM}{SEPARATOR}\d+{SEPARATOR}{ALLELE}(?:{SEPARATOR}{ALLELE})?",
    "inline_genotype": rf"\b{RSID}\b\s*[:=]\s*['\"]?{ALLELE}\s*[/|]?\s*{ALLELE}\b",
    "keyed_fields": rf"(?s)\brsid\s*[=:]\s*['\"]?{RSID}['\"]?.{{0,300}}?\b(?:a|allele)1\s*[=:]\s*['\"]?{ALLELE}['\"]?",
}


def leak_counts(rows: DataFrame, text: str, key: str) -> DataFrame:
    """Per row how often each pattern occurs; a null text holds none."""
    return rows.select(key, *[F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).cast("long").alias(f"n_{name}") for name, p in PATTERNS.items()])


def _named(pattern: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(pattern).alias("pattern"), s["end"].alias("end"))


def find(text: str) -> Column:
    """array<struct<pattern,start,end>> by start and pattern, in code points, end exclusive; empty for a null text."""
    whole, found = F.coalesce(F.col(text), F.lit("")), []
    for name, pattern in PATTERNS.items():
        hits, between = F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), F.split(whole, pattern, -1)
        lengths = F.zip_with(F.slice(between, F.lit(1), F.size(hits)), hits, lambda b, h: F.struct(F.length(b).alias("gap"), F.length(h).alias("len")))
        spans = F.aggregate(
            lengths,
            F.expr("struct(0 as at, cast(array() as array<struct<start:int,end:int>>) as spans)"),
            lambda acc, p: F.struct((acc["at"] + p["gap"] + p["len"]).alias("at"), F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + p["len"]).alias("end")))).alias("spans")),
        )["spans"]
        spans = F.transform(spans, _named(name))
        # most texts hold none
        found.append(F.when(F.regexp_like(whole, F.lit(pattern)), spans).otherwise(F.expr("cast(array() as array<struct<start:int,pattern:string,end:int>>)")))
    return F.transform(F.array_sort(F.concat(*found)), lambda s: F.struct(s["pattern"].alias("pattern"), s["start"].alias("start"), s["end"].alias("end")))


def redact(text: Column, mark: str = "[removed]") -> Column:
    for pattern in PATTERNS.values():
        text = F.regexp_replace(text, pattern, mark)
    return text
