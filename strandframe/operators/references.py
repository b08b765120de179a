"""Tables derived from reference files: merge splits, build anchors, variant cross-checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import chrom_order
from .keys import LOCUS


def split_merges(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved) of records with retired_rsid and targets: one target resolves, none is withdrawn, several are ambiguous."""
    n = F.size("targets")
    resolved = records.where(n == 1).select("retired_rsid", F.element_at("targets", 1).alias("current_rsid"))
    unresolved = records.where(n != 1).select("retired_rsid", F.when(n < 1, "withdrawn").otherwise("ambiguous").alias("status"), "targets")
    return resolved, unresolved


def pair_anchors(placements: DataFrame) -> DataFrame:
    """Anchors from (allele_id, rsid, assembly, chrom, pos, gene): one placement in each build, on one chromosome, of one rsid.

    Rsids with several placements, and placements that are equal in both builds, go. Genes are sorted and
    joined by |, without -.
    """
    in_37, in_38 = F.col("assembly") == "GRCh37", F.col("assembly") == "GRCh38"
    place = F.struct("chrom", "pos")
    grouped = placements.groupBy("allele_id").agg(
        F.min(F.when(in_37, place)).alias("p37"), F.max(F.when(in_37, place)).alias("q37"), F.min(F.when(in_38, place)).alias("p38"), F.max(F.when(in_38, place)).alias("q38"),
        F.min("rsid").alias("rsid"), F.max("rsid").alias("last_rsid"), F.array_sort(F.collect_set(F.when(F.col("gene") != "-", F.col("gene")))).alias("genes"),
    )
    single = grouped.where("p37 = q37 and p38 = q38 and rsid = last_rsid and p37.chrom = p38.chrom")
    rows = single.select("rsid", F.col("p37.chrom").alias("chrom"), F.col("p37.pos").alias("pos_grch37"), F.col("p38.pos").alias("pos_grch38"), F.when(F.size("genes") > 0, F.array_join("genes", "|")).otherwise("-").alias("gene"))
    where = F.struct("chrom", "pos_grch37", "pos_grch38")
    unique = rows.groupBy("rsid").agg(F.min(where).alias("lo"), F.max(where).alias("hi"), F.min("gene").alias("gene")).where("lo = hi and lo.pos_grch37 <> lo.pos_grch38")
    return unique.select("rsid", "lo.chrom", "lo.pos_grch37", "lo.pos_grch38", "gene")


def round_robin(anchors: DataFrame, count: int, least: int | None = None) -> DataFrame:
    """`count` anchors: the first of each chromosome in order of rsid number, then the second of each, and so on.

    Fewer than `least` anchors, `count` unless given, are refused: a build check over fewer would say less than it seems to.
    """
    if (found := anchors.count()) < (count if least is None else least):
        raise ValueError(f"{found} anchors, fewer than {count if least is None else least}")
    number = F.substring("rsid", 3, 20).cast("long")
    ranked = anchors.withColumn("turn", F.row_number().over(Window.partitionBy("chrom").orderBy(number))).withColumn("chrom_order", chrom_order())
    # a chromosome can't give more than `count`
    return ranked.where(F.col("turn") <= count).orderBy("turn", "chrom_order").limit(count).select("rsid", "chrom", "turn", "chrom_order")


def cross_check(authored: DataFrame, reference: DataFrame) -> DataFrame:
    """State of each authored variant (card_id, rsid, locus, low and high allele) against reference rows (rsid, locus, ref, alt).

    In order: unresolved, coordinate-mismatch, rsid-mismatch, allele-mismatch, ok. Two equi-joins, none by a
    disjunction.
    """
    by_rsid = reference.groupBy("rsid").agg(F.count("*").alias("n"))
    known_rsid = authored.join(by_rsid, "rsid", "left_semi").select("card_id").withColumn("rsid_known", F.lit(True))
    fits = F.col("low_allele").isin(F.col("ref"), F.col("alt")) & F.col("high_allele").isin(F.col("ref"), F.col("alt"))
    at = authored.join(reference.withColumnRenamed("rsid", "r_rsid"), LOCUS).groupBy("card_id").agg(F.bool_or(F.col("r_rsid") == F.col("rsid")).alias("rsid_here"), F.bool_or((F.col("r_rsid") == F.col("rsid")) & fits).alias("fits"))
    j = authored.join(known_rsid.distinct(), "card_id", "left").join(at, "card_id", "left")
    state = (
        F.when(F.col("rsid_here").isNull() & F.col("rsid_known").isNull(), "unresolved")
        .when(F.col("rsid_here").isNull(), "coordinate-mismatch")
        .when(~F.col("rsid_here"), "rsid-mismatch")
        .when(~F.col("fits"), "allele-mismatch")
        .otherwise("ok")
    )
    return j.select("card_id", state.alias("state"))
