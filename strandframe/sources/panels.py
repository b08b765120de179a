"""Files of reference panels: score tables, variant and sample lists, anchor lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import with_lines
from ..schema import CHROMS

#: Fixed value: the columns of a score table that hold a component.
COMPONENT = r"^(?:PC|SCORE)(\d+)_(?:AVG|SUM)$"


class PanelError(ValueError):
    """A panel file that can't be read; the message holds names and numbers of its columns only."""


def read_scores(spark: SparkSession, path: str, n_components: int | None = None) -> tuple[DataFrame, int]:
    """((sample_id, component, score), least ALLELE_CT of all samples) of a tab-separated score table.

    Columns are found by name in the header: IID, ALLELE_CT and the components, in the order of their numbers and then
    numbered from 1. Refused are tables without samples, rows of another number of fields than the header, a missing
    column, another number of components than `n_components`, and numbers that can't be read.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    head = lines.where(F.col("value").startswith("#")).first()
    if head is None:
        raise PanelError("the score table has no header")
    names = [c.lstrip("#") for c in head[0].rstrip("\r").split("\t")]
    found = sorted((int(m[1]), i) for i, c in enumerate(names) if (m := re.match(COMPONENT, c)))
    for needed in ("IID", "ALLELE_CT"):
        if needed not in names:
            raise PanelError(f"the score table has no {needed} column; it has {', '.join(names)}")
    if not found or (n_components is not None and len(found) != n_components):
        raise PanelError(f"the score table has {len(found)} components" + (f", the reference {n_components}" if n_components is not None else ""))
    fields = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(fields.alias("f"))
    number = lambda i: F.expr(f"try_cast(f[{i}] as double)")
    unread = F.exists(F.array(*[number(i) for _, i in found]), lambda x: x.isNull())
    ragged = F.size("f") != len(names)
    stats = rows.agg(F.count("*").alias("n"), F.count_if(ragged).alias("ragged"), F.count_if(~ragged & unread).alias("unread"), F.min(F.when(~ragged, number(names.index("ALLELE_CT")))).alias("least")).first()
    if not stats["n"]:
        raise PanelError("the score table has no samples")
    if stats["ragged"]:
        raise PanelError(f"{stats['ragged']} rows have another number of fields than the header")
    if stats["unread"] or stats["least"] is None:
        raise PanelError("the score table has scores or counts that are no numbers")
    return scores(rows.select(F.col("f")[names.index("IID")].alias("IID"), *[number(i).alias(names[i]) for _, i in found]), "IID"), int(stats["least"])


def scores(wide: DataFrame, sample: str) -> DataFrame:
    """(sample_id, component, score) of a table with a column a component, numbered from 1 in the order of their numbers."""
    numbers = {c: m[1] for c in wide.columns if (m := re.match(COMPONENT, c))}
    found = sorted(numbers, key=lambda c: int(numbers[c]))
    long = wide.unpivot([sample], found, "name", "score")
    place = F.create_map(*[x for i, c in enumerate(found) for x in (F.lit(c), F.lit(i + 1))])
    return long.select(F.col(sample).alias("sample_id"), F.element_at(place, F.col("name")).alias("component"), F.col("score").cast("double").alias("score"))


def count_entries(spark: SparkSession, path: str) -> int:
    """The lines of a variant or sample list that are neither blank nor a header."""
    return spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#")).count()


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """(line, chrom, pos_grch37, variant_id, ref, alt) of a variant list, with its line in the file; fields beyond are left alone."""
    rows = with_lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    return rows.select("line", F.get(f, 0).alias("chrom"), F.expr("try_cast(get(split(value, '\t'), 1) as bigint)").alias("pos_grch37"), F.get(f, 2).alias("variant_id"), F.get(f, 3).alias("ref"), F.get(f, 4).alias("alt"))


def write_variants(sites: DataFrame, path: str) -> None:
    """Write (chrom, pos_grch37, variant_id, ref, alt) as lines in biological order; the files follow each other, the header in one before them."""
    place = F.array_position(F.array(*map(F.lit, CHROMS)), F.col("chrom"))
    keys = [place, F.col("pos_grch37"), F.col("variant_id")]
    row = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("chrom", "pos_grch37", "variant_id", "ref", "alt")])
    sites.repartitionByRange(*keys).sortWithinPartitions(*keys).select(row.alias("value")).write.mode("error").text(f"{path}/body")
    header = sites.sparkSession.createDataFrame([("#CHROM\tPOS\tID\tREF\tALT",)], "value string")
    header.coalesce(1).write.mode("error").text(f"{path}/header")


def read_anchors(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(rsid, chrom, pos_grch37, pos_grch38, gene) of an anchor file (JSON with schema_version 1, source and anchors).

    Refused, naming the first fault: another version, no source, no anchors or another number than `expected`, and
    anchors with an odd or repeated rsid, a position below 1 or the same one in both builds.
    """
    form = "schema_version int, source string, anchors array<struct<rsid: string, chrom: string, pos_grch37: bigint, pos_grch38: bigint, gene: string>>"
    file = spark.read.schema(form).option("multiLine", True).json(path)
    head = file.select("schema_version", F.length(F.trim("source")).alias("source"), F.size("anchors").alias("n")).first()
    if head is None or head["schema_version"] != 1:
        raise PanelError(f"anchor file version {head and head['schema_version']} is not supported")
    if not head["source"]:
        raise PanelError("the anchor file names no source")
    if (head["n"] or 0) < 1 or (expected is not None and head["n"] != expected):
        raise PanelError(f"the anchor file has {head['n']} anchors" + (f", not {expected}" if expected is not None else ""))
    anchors = file.select(F.explode("anchors").alias("a")).select("a.*")
    odd = ~F.coalesce(F.col("rsid").rlike(r"^rs[1-9]\d*$"), F.lit(False))
    low = ~F.coalesce((F.col("pos_grch37") > 0) & (F.col("pos_grch38") > 0), F.lit(False))
    faults = anchors.agg(F.count_if(odd).alias("odd rsids"), (F.count("rsid") - F.count_distinct("rsid")).alias("repeated rsids"), F.count_if(low).alias("positions below 1"), F.count_if(F.col("pos_grch37") == F.col("pos_grch38")).alias("equal positions"), F.count_if(F.col("chrom").isNull()).alias("missing chromosomes")).first()
    for name, n in faults.asDict().items():
        if n:
            raise PanelError(f"the anchor file has {n} {name}")
    return anchors
