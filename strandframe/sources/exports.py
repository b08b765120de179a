"""Readers of consumer exports in two layouts, chosen by what the file's first lines say."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import split_genotype
from ..schema import LETTER_CODES, NUMERIC_CODES

PREFIX_LINES = 40
# The columns of the numeric layout and the fewest comment lines before them.
NUMERIC_COLUMNS, LEAST_COMMENTS = ("rsid", "chromosome", "position", "allele1", "allele2"), 5


class IngestError(ValueError):
    """A file that can't be read as an export; the message never holds its rows."""


@dataclass(frozen=True)
class Layout:
    """`claims` decides from the prefix; `read` gives rsid, chrom, pos, a1 and a2 as strings."""

    name: str
    codes: dict[str, str]
    claims: Callable[[list[str]], bool]
    read: Callable[[SparkSession, str], DataFrame]


def read_prefix(spark: SparkSession, path: str) -> list[str]:
    return [r[0].rstrip("\r\n") for r in spark.read.text(path).limit(PREFIX_LINES).collect()]


def _fields(spark: SparkSession, path: str, n: int, skip: str | None) -> DataFrame:
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    if skip:
        lines = lines.where(~F.lower("value").startswith(skip))
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    return lines.select(parts.alias("f"), F.size(parts).alias("n_fields")).withColumn("wrong_count", F.col("n_fields") != n)


def read_numeric(spark: SparkSession, path: str) -> DataFrame:
    rows = _fields(spark, path, 5, "rsid\t")
    names = ("rsid", "chrom", "pos", "a1", "a2")
    return rows.select(*[F.when(F.get("f", i) != "", F.get("f", i)).alias(c) for i, c in enumerate(names)], "wrong_count")


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    rows = _fields(spark, path, 4, None)
    named = rows.select(*[F.when(F.get("f", i) != "", F.get("f", i)).alias(c) for i, c in enumerate(("rsid", "chrom", "pos", "genotype"))], "wrong_count")
    return split_genotype(named).drop("genotype")


LAYOUTS = (
    Layout("numeric", NUMERIC_CODES, lambda lines: any(x.startswith("#") and "ancestrydna" in x.lower() for x in lines), read_numeric),
    Layout("merged", LETTER_CODES, lambda lines: any(re.match(r"^#\s*rsid\s+chromosome\s+position\s+genotype\s*$", x, re.I) for x in lines), read_merged),
)


def detect(lines: list[str]) -> Layout:
    """The one layout that claims a prefix; none or several are refused."""
    claims = [x for x in LAYOUTS if x.claims(lines)]
    if len(claims) != 1:
        raise IngestError("no layout claims the file" if not claims else "several layouts claim the file")
    return claims[0]


def declared_build(lines: list[str]) -> int | None:
    found = [int(m[1]) for x in lines if x.startswith("#") and (m := re.search(r"\bbuild\s+(\d+)", x, re.I))]
    return found[0] if found else None


def check_columns(lines: list[str], layout: Layout) -> None:
    """Refuse a prefix of the numeric layout without its row of column names, with other columns, or with too few lines before it."""
    if layout.name != "numeric":
        return
    head = next((x for x in lines if x.strip() and not x.startswith("#")), "")
    names = tuple(x.strip().lower() for x in head.split("\t"))
    if names[0] != NUMERIC_COLUMNS[0]:
        raise IngestError("the file has no row of column names")
    if names != NUMERIC_COLUMNS:
        raise IngestError(f"the columns are not {', '.join(NUMERIC_COLUMNS)}")
    if sum(x.startswith("#") for x in lines[: lines.index(head)]) < LEAST_COMMENTS:
        raise IngestError(f"fewer than {LEAST_COMMENTS} comment lines before the columns: the file's head was cut off")


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, Layout]:
    """Raw rows and layout of an export; other builds than 37 and rows of a wrong field count are refused."""
    lines = read_prefix(spark, path)
    if not lines:
        raise IngestError("the file is empty")
    layout = detect(lines)
    check_columns(lines, layout)
    if declared_build(lines) != 37:
        raise IngestError(f"build {declared_build(lines)} is not supported")
    raw = layout.read(spark, path)
    wrong = raw.where("wrong_count").count()
    if wrong:
        raise IngestError(f"{wrong} rows have a wrong number of fields")
    return raw.drop("wrong_count"), layout
