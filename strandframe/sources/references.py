"""Readers of reference files: variant VCF, merge records, and tabular placements, always with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import require_ascending, with_lines
from ..schema import AUTOSOMES, literal_map


# The columns that a placement summary must have.
PLACEMENT_COLUMNS = ("#AlleleID", "Type", "GeneSymbol", "RS# (dbSNP)", "Assembly", "Chromosome", "Start", "Stop", "ReferenceAlleleVCF", "AlternateAlleleVCF")


def _accessions() -> dict[str, str]:
    """RefSeq accession number of each primary chromosome, without version."""
    return {f"NC_{i:06d}": c for i, c in enumerate((*AUTOSOMES, "X", "Y"), 1)} | {"NC_012920": "MT"}


def read_variant_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(rsid, chrom, pos_grch37, ref, alts) of a dbSNP-style VCF's leading fields; other contigs and ids are skipped."""
    parts = F.split("value", "\t", 6)
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(*[F.get(parts, i).alias(c) for i, c in enumerate(("contig", "pos", "rsid", "ref", "alt"))])
    chrom = F.try_element_at(literal_map(_accessions()), F.regexp_extract("contig", r"^(NC_\d{6})", 1))
    pos = F.expr("try_cast(pos as bigint)")
    kept = rows.select("rsid", chrom.alias("chrom"), pos.alias("pos_grch37"), "ref", F.split("alt", ",").alias("alts"), "alt")
    return kept.where(F.col("chrom").isNotNull() & F.col("rsid").rlike(r"^rs[1-9]\d*$") & (F.col("pos_grch37") > 0) & (F.col("pos_grch37") < 2**32) & (F.col("alt") != ".")).drop("alt")


def read_merge_records(spark: SparkSession, path: str) -> DataFrame:
    """(retired_rsid, targets) of JSON lines with refsnp_id and merged_snapshot_data.merged_into."""
    raw = spark.read.schema("refsnp_id string, merged_snapshot_data struct<merged_into: array<string>>").json(path)
    targets = F.transform(F.coalesce("merged_snapshot_data.merged_into", F.array().cast("array<string>")), lambda x: F.concat(F.lit("rs"), x))
    return raw.select(F.concat(F.lit("rs"), "refsnp_id").alias("retired_rsid"), targets.alias("targets"))


def checked_merge_records(spark: SparkSession, path: str) -> DataFrame:
    """(retired_rsid, targets) of read_merge_records(), refused unless ids are positive, rise from line to line and none is merged into itself.

    The message names the first line that is out of order or holds no record; files follow each other by name.
    """
    form = "refsnp_id string, merged_snapshot_data struct<merged_into: array<string>>"
    lines = with_lines(spark, path).where(F.trim("value") != "").select("file", "line", F.from_json("value", form).alias("r"))
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    rows = lines.select("file", "line", number("r.refsnp_id").alias("id"), F.transform(F.coalesce("r.merged_snapshot_data.merged_into", F.array().cast("array<string>")), lambda x: F.try_to_number(x, F.lit("999999999999"))).alias("into"))
    odd = ~F.coalesce(F.col("id") > 0, F.lit(False)) | F.exists("into", lambda x: ~F.coalesce(x > 0, F.lit(False)))
    itself = F.array_contains("into", F.col("id").cast("decimal(12,0)"))
    bad = rows.select("file", "line", F.when(odd, "no record").when(itself, "a self-merge").alias("fault")).where("fault is not null").orderBy("file", "line").first()
    if bad:
        raise ValueError(f"{bad['file'].rpartition('/')[2]}, line {bad['line']}: {bad['fault']}")
    require_ascending(rows, "id")
    return rows.select(F.concat(F.lit("rs"), F.col("id").cast("string")).alias("retired_rsid"), F.transform("into", lambda x: F.concat(F.lit("rs"), x.cast("string"))).alias("targets"))


def read_placements(spark: SparkSession, path: str) -> DataFrame:
    """(allele_id, rsid, assembly, chrom, pos, gene) of single-base changes in a tab-separated summary."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    if missing := [c for c in PLACEMENT_COLUMNS if c not in raw.columns]:
        raise ValueError(f"the summary lacks the columns {', '.join(missing)}")
    snv = raw.where((F.col("Type") == "single nucleotide variant") & F.col("ReferenceAlleleVCF").rlike("^[ACGT]$") & F.col("AlternateAlleleVCF").rlike("^[ACGT]$") & (F.col("Start") == F.col("Stop")))
    named = snv.select(F.col("#AlleleID").alias("allele_id"), F.concat(F.lit("rs"), F.col("`RS# (dbSNP)`")).alias("rsid"), F.col("Assembly").alias("assembly"), F.col("Chromosome").alias("chrom"), F.expr("try_cast(Start as bigint)").alias("pos"), F.col("GeneSymbol").alias("gene"))
    return named.where(F.col("rsid").rlike(r"^rs[1-9]\d*$") & (F.col("pos") > 0) & F.col("assembly").isin("GRCh37", "GRCh38"))
