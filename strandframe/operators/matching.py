"""Cards against a sample: duplicate probes, strand orientation, match statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import complement, is_indel, is_palindromic, strand_canonical
from ..functions.once import computed_once
from ..schema import dimension
from .keys import LOCUS

# Match statuses in the order in which they are reported.
MATCH_STATUSES = (
    "matched", "marker_absent", "duplicate_conflict", "no_call", "indel_excluded", "het_haploid", "allele_mismatch", "strand_ambiguous", "not_determinable",
)


def resolve_probes(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per locus from all its probes.

    Called probes are compared by strand-canonical genotype, literally if that is A/T or C/G. One distinct
    value: the first called row by `order` stands for all; several: conflict with the number of called rows.
    No called row: the first row. Partial aggregates only, so a locus of many probes needs no list.
    """
    called = F.col("genotype").isNotNull()
    literal = is_palindromic(F.substring("genotype", 1, 1), F.substring("genotype", 2, 1))
    compared = F.when(called, F.when(literal, F.col("genotype")).otherwise(strand_canonical(F.col("genotype"))))
    row = F.struct(*order, "rsid", "allele1", "allele2", "genotype", "call_status")
    grouped = computed_once(rows, {"__c": compared}).groupBy(*LOCUS).agg(
        F.count("*").alias("n_probes"), F.count_if(called).alias("n_called"), F.min("__c").alias("lo"), F.max("__c").alias("hi"), F.min(F.when(called, row)).alias("first_called"), F.min(row).alias("first_row")
    )
    first = F.coalesce("first_called", "first_row")
    return grouped.select(*LOCUS, "n_probes", "n_called", F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("conflict"), *[first[c].alias(c) for c in ("rsid", "allele1", "allele2", "genotype", "call_status")])


def match_cards(cards: DataFrame, probes: DataFrame, observed: bool = False) -> DataFrame:
    """Exactly one row per card: status, strand and outcome, and with `observed` what was read; the first rule that fits decides.

    `cards` has card_id, kind, chrom, pos_grch37, low and high allele, and the outcomes of the genotypes low
    low, low high and high high.
    """
    j = cards.join(probes.withColumnRenamed("rsid", "observed_rsid"), LOCUS, "left")
    low, high = F.col("low_allele"), F.col("high_allele")
    palindromic = is_palindromic(low, high)
    inside = ((F.col("allele1") == low) | (F.col("allele1") == high)) & ((F.col("allele2") == low) | (F.col("allele2") == high))
    flipped = complement(F.col("genotype"))
    f1, f2 = F.substring(flipped, 1, 1), F.substring(flipped, 2, 1)
    flipped_inside = ((f1 == low) | (f1 == high)) & ((f2 == low) | (f2 == high))
    strand = F.when(palindromic & inside, "ambiguous").when(palindromic, "mismatch").when(inside, "as_written").when(flipped_inside, "complemented").otherwise("mismatch")
    read = F.when(F.col("strand") == "complemented", flipped).otherwise(F.col("genotype"))

    def outcome(g):
        return F.when(g == F.concat(low, low), F.col("low_outcome")).when(g == F.concat(low, high), F.col("mid_outcome")).when(g == F.concat(high, high), F.col("high_outcome"))

    other = outcome(flipped)
    status = (
        F.when(F.col("kind") == "impossibility", "not_determinable")
        .when(F.col("n_probes").isNull(), "marker_absent")
        .when(F.col("conflict"), "duplicate_conflict")
        .when(F.col("genotype").isNull(), "no_call")
        .when(is_indel(F.col("allele1"), F.col("allele2")), "indel_excluded")
        .when(F.col("call_status") == "het_haploid", "het_haploid")
        .when(F.col("strand") == "mismatch", "allele_mismatch")
        .when((F.col("strand") == "ambiguous") & (F.col("other") != F.col("outcome")), "strand_ambiguous")
        .otherwise("matched")
    )
    found = j.withColumn("strand", F.when(F.col("genotype").isNotNull(), strand)).withColumn("outcome", outcome(read)).withColumn("other", other).withColumn("status", status)
    return found.select("card_id", "kind", "status", "strand", F.when(F.col("status") == "matched", F.col("outcome")).alias("outcome"), F.col("n_called").alias("n_called_probes"), *(["genotype", "observed_rsid"] if observed else []))


def status_counts(matches: DataFrame) -> DataFrame:
    """How many cards have each status, zeros kept."""
    labels = dimension(matches.sparkSession, "status", MATCH_STATUSES)
    return labels.join(matches.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("rank", "status", F.coalesce("n", F.lit(0)).alias("n_cards"))


def genotype_pairs(cards: DataFrame) -> DataFrame:
    """All genotypes that a card's alleles can form, sorted within each."""
    alleles = F.array_sort(F.array("low_allele", "high_allele"))
    one = cards.select("card_id", F.posexplode(alleles).alias("i", "a"), alleles.alias("all"))
    return one.select("card_id", "a", F.explode(F.expr("slice(all, i + 1, size(all))")).alias("b")).select("card_id", F.concat("a", "b").alias("genotype")).distinct()
