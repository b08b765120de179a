"""Quality control: call rates, heterozygosity, sex, ploidy, duplicates, build and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import is_indel, rate
from ..schema import AUTOSOMES, CHROMS, chrom_order, dimension

# Thresholds of quality control.
X_MALE, X_FEMALE, Y_MALE, Y_FEMALE = 0.05, 0.15, 0.30, 0.15
LEAST_X_LOCI, LEAST_CHROM_LOCI, LEAST_CALL_RATE = 100, 100, 0.98
HET_BAND, LEAST_ANCHORS = (0.15, 0.40), 2


def _called() -> Column:
    return F.col("call_status") != "no_call"


def _snp() -> Column:
    return ~is_indel(F.col("allele1"), F.col("allele2")) & _called()


def _het() -> Column:
    return F.coalesce(F.col("allele1") != F.col("allele2"), F.lit(False))


def call_rate_rollup(table: DataFrame) -> DataFrame:
    """Rows, calls and rate per chromosome and in all (chrom null), in one pass."""
    return table.rollup("chrom").agg(F.count("*").alias("n_rows"), F.count_if(_called()).alias("n_called")).select("chrom", "n_rows", "n_called", rate(F.col("n_called"), F.col("n_rows")).alias("call_rate"))


def call_rates(table: DataFrame) -> DataFrame:
    """Per chromosome, with its place in biological order."""
    counted = table.groupBy("chrom").agg(F.count("*").alias("n_rows"), F.count_if(_called()).alias("n_called"))
    return counted.select(chrom_order().alias("chrom_order"), "chrom", "n_rows", "n_called", (F.col("n_rows") - F.col("n_called")).alias("n_no_call"), rate(F.col("n_called"), F.col("n_rows")).alias("call_rate"))


def sample_counts(table: DataFrame) -> DataFrame:
    """All counts that the decisions need, as one row from one pass."""
    auto, x, y = F.col("chrom").isin(*AUTOSOMES), F.col("chrom") == "X", F.col("chrom") == "Y"
    return table.agg(
        F.count("*").alias("n_rows"),
        F.count_if(_called()).alias("n_called"),
        F.count_if(auto & _snp()).alias("autosomal_loci"),
        F.count_if(auto & _snp() & _het()).alias("autosomal_het"),
        F.count_if(x & _snp()).alias("x_loci"),
        F.count_if(x & _snp() & _het()).alias("x_het"),
        F.count_if(y).alias("y_rows"),
        F.count_if(y & _called()).alias("y_called"),
        F.count_if(is_indel(F.col("allele1"), F.col("allele2"))).alias("n_indels"),
    )


def heterozygosity(table: DataFrame) -> DataFrame:
    c = sample_counts(table)
    return c.select("autosomal_loci", "autosomal_het", rate(F.col("autosomal_het"), F.col("autosomal_loci")).alias("autosomal_rate"), "x_loci", "x_het", rate(F.col("x_het"), F.col("x_loci")).alias("x_rate"))


def infer_sex(counts: DataFrame) -> DataFrame:
    """Add x_rate, y_rate and sex (male, female or ambiguous) to sample_counts()."""
    x, y = F.col("x_rate"), F.col("y_rate")
    alone = F.when(x <= X_MALE, "male").when(x >= X_FEMALE, "female").otherwise("ambiguous")
    both = F.when((x <= X_MALE) & (y >= Y_MALE), "male").when((x >= X_FEMALE) & (y <= Y_FEMALE), "female").otherwise("ambiguous")
    rated = counts.withColumns({"x_rate": rate(F.col("x_het"), F.col("x_loci")), "y_rate": rate(F.col("y_called"), F.col("y_rows"))})
    return rated.withColumn("sex", F.when(F.col("x_loci") < LEAST_X_LOCI, "ambiguous").when(F.col("y_rows") == 0, alone).otherwise(both))


def resolve_ploidy(table: DataFrame, sex: DataFrame) -> DataFrame:
    """call_status by the sample's sex (a one-row frame): hemizygous on single-copy chromosomes, het_haploid if both alleles differ there."""
    single = F.when(F.col("sex") == "male", F.col("chrom").isin("X", "Y", "MT")).otherwise(F.col("chrom") == "MT")
    status = F.when(~_called(), "no_call").when(single & _het(), "het_haploid").when(single, "hemizygous").otherwise("called")
    # one row by construction
    return table.crossJoin(F.broadcast(sex.select("sex").limit(1))).withColumn("call_status", status)


def duplicate_summary(table: DataFrame) -> DataFrame:
    """Rows beyond the first of each rsid and of each locus; nulls are values."""
    return table.agg(
        (F.count("*") - F.count_distinct(F.struct("rsid"))).alias("extra_rsid_rows"), (F.count("*") - F.count_distinct(F.struct("chrom", "pos_grch37"))).alias("extra_locus_rows")
    )


def build_check(table: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors found by rsid, and how many lie at their position in either build; the older build is tested first."""
    hits = anchors.join(table.select("rsid", "pos_grch37"), "rsid").groupBy("rsid").agg(F.bool_or(F.col("pos_grch37") == F.col("anchor_37")).alias("at_37"), F.bool_or(F.col("pos_grch37") == F.col("anchor_38")).alias("at_38"))
    joined = anchors.select("rsid").distinct().join(hits, "rsid", "left")
    counted = joined.agg(
        F.count("*").alias("n_anchors"), F.count("at_37").alias("n_found"), F.count_if("at_37").alias("n_37"), F.count_if(F.col("at_38") & ~F.col("at_37")).alias("n_38")
    )
    a, b = F.col("n_37"), F.col("n_38")
    return counted.withColumn("verdict", F.when((a >= LEAST_ANCHORS) & (a > b), "confirmed_37").when((b >= LEAST_ANCHORS) & (b > a), "suspected_38").otherwise("indeterminate"))


def absent_chromosomes(table: DataFrame) -> DataFrame:
    labels = dimension(table.sparkSession, "chrom", CHROMS)
    return labels.join(table.select("chrom").distinct(), "chrom", "left_anti").select("chrom")


def qc_warnings(table: DataFrame, anchors: DataFrame, chroms: tuple[str, ...] = CHROMS) -> DataFrame:
    """Warnings with their precedence; a warning never removes a row.

    `chroms` are those that the export's layout can name. One pass counts per chromosome; an uncalled Y of a
    female sample is no low call rate. Heterozygous calls at single-copy loci count without indels.
    """
    per_chrom = table.groupBy("chrom").agg(F.count("*").alias("n_rows"), F.count_if(_called()).alias("n_called"), F.count_if(_snp()).alias("n_snp"), F.count_if(_snp() & _het()).alias("n_het"))

    def total(column: str, *chosen: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("chrom").isin(*chosen), F.col(column)) if chosen else F.col(column)), F.lit(0))

    counts = per_chrom.agg(
        total("n_rows").alias("n_rows"),
        total("n_called").alias("n_called"),
        total("n_snp", *AUTOSOMES).alias("autosomal_loci"),
        total("n_het", *AUTOSOMES).alias("autosomal_het"),
        total("n_snp", "X").alias("x_loci"),
        total("n_het", "X").alias("x_het"),
        total("n_rows", "Y").alias("y_rows"),
        total("n_called", "Y").alias("y_called"),
        # a row per chromosome
        F.collect_list(F.struct("chrom", "n_rows", "n_called", "n_het")).alias("chroms"),
    )
    # three frames of one row each
    row = infer_sex(counts).crossJoin(duplicate_summary(table)).crossJoin(build_check(table, anchors).select("verdict"))
    het, female = rate(F.col("autosomal_het"), F.col("autosomal_loci")), F.col("sex") == "female"
    low = F.filter("chroms", lambda c: (c["n_rows"] >= LEAST_CHROM_LOCI) & (rate(c["n_called"], c["n_rows"]) < LEAST_CALL_RATE) & ~((c["chrom"] == "Y") & female))
    single = F.filter("chroms", lambda c: (c["n_het"] > 0) & ((c["chrom"] == "MT") | ((F.col("sex") == "male") & c["chrom"].isin("X", "Y"))))
    rules = [
        (1, "suspected_38", F.col("verdict") == "suspected_38"),
        (2, "ambiguous_sex", F.col("sex") == "ambiguous"),
        (3, "low_call_rate", rate(F.col("n_called"), F.col("n_rows")) < LEAST_CALL_RATE),
        (4, "low_chrom_call_rate", F.size(low) > 0),
        (5, "heterozygosity", (F.col("autosomal_loci") > 0) & ~het.between(*HET_BAND)),
        (6, "het_haploid", F.size(single) > 0),
        (7, "female_y", female & (F.col("y_rate") > Y_FEMALE)),
        (8, "duplicate_positions", F.col("extra_locus_rows") > 0),
        (9, "absent_chromosomes", F.size(F.array_except(F.array(*[F.lit(c) for c in chroms]), F.col("chroms.chrom"))) > 0),
    ]
    found = row.select(F.explode(F.array(*[F.struct(F.lit(p).alias("precedence"), F.lit(n).alias("warning"), r.alias("raised")) for p, n, r in rules])).alias("w"))
    return found.where("w.raised").select("w.precedence", "w.warning")


def qc_report(table: DataFrame, anchors: DataFrame) -> DataFrame:
    """All measures of a sample as one row, with the names of its warnings in their order."""
    warned = qc_warnings(table, anchors).agg(F.transform(F.array_sort(F.collect_list(F.struct("precedence", "warning"))), lambda w: w["warning"]).alias("warnings"))
    counts = infer_sex(sample_counts(table))
    measured = counts.select(
        "n_rows", "n_called", rate(F.col("n_called"), F.col("n_rows")).alias("call_rate"), rate(F.col("autosomal_het"), F.col("autosomal_loci")).alias("autosomal_rate"), "x_rate", "y_rate", "sex", "n_indels"
    )
    # four frames of one row each
    return measured.crossJoin(duplicate_summary(table)).crossJoin(build_check(table, anchors).select("n_found", "verdict")).crossJoin(warned)
