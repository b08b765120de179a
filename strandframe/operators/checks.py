"""Consistency checks of packs, panels and reference tables, as frames of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import rate
from ..schema import chrom_order
from .keys import LOCUS
from .matching import genotype_pairs

BASES = ("A", "C", "G", "T")


def artifact_overlap(merges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(retired_rsid): what both merge tables hold, though none may."""
    return merges.select("retired_rsid").intersect(unresolved.select("retired_rsid"))


def id_problems(sites: DataFrame, column: str = "variant_id") -> DataFrame:
    """One row: ids that are null, empty or a dot, and rows beyond the first of each other id."""
    blank = F.col(column).isNull() | F.col(column).cast("string").isin("", ".")
    return sites.agg(F.count_if(blank).alias("n_blank"), (F.count_if(~blank) - F.count_distinct(F.when(~blank, F.col(column)))).alias("n_repeated"))


def sorted_genotype(key: Column) -> Column:
    """A genotype as written in a pack: trimmed, in upper case, its letters in order."""
    return F.array_join(F.array_sort(F.split(F.upper(F.trim(key)), "")), "")


def genotype_gaps(declared: DataFrame, cards: DataFrame) -> DataFrame:
    """(card_id, genotype, problem) of genotype maps (card_id, genotype): not_constructible from the card's alleles, mapped_twice, or no_outcome."""
    keys = declared.select("card_id", sorted_genotype(F.col("genotype")).alias("genotype")).groupBy("card_id", "genotype").agg(F.count("*").alias("n"))
    both = keys.join(genotype_pairs(cards).withColumn("possible", F.lit(True)), ["card_id", "genotype"], "full")
    problem = F.when(F.col("possible").isNull(), "not_constructible").when(F.col("n").isNull(), "no_outcome").when(F.col("n") > 1, "mapped_twice")
    return both.select("card_id", "genotype", problem.alias("problem")).where("problem is not null")


def outcome_gaps(referenced: DataFrame, defined: DataFrame) -> DataFrame:
    """(card_id, outcome, problem): outcomes that genotypes map to but nobody defines, and the other way round."""
    one, two = (f.select("card_id", "outcome").distinct().withColumn(name, F.lit(True)) for f, name in ((referenced, "used"), (defined, "known")))
    return one.join(two, ["card_id", "outcome"], "full").where("used is null or known is null").select("card_id", "outcome", F.when(F.col("known").isNull(), "undefined").otherwise("unused").alias("problem"))


def orphan_observations(observations: DataFrame, cards: DataFrame) -> DataFrame:
    """Observations of cards that the pack does not have."""
    return observations.join(cards, "card_id", "left_anti")


def frequency_problems(frequencies: DataFrame) -> DataFrame:
    """Per card (card_id, allele, frequency) with a fault: other alleles than bases, frequencies not from 0 to 1, repeated alleles, a total above 1."""
    fits = F.coalesce(F.col("frequency").between(0, 1), F.lit(False))
    counted = frequencies.groupBy("card_id").agg(
        F.count_if(~F.coalesce(F.col("allele").isin(*BASES), F.lit(False))).alias("n_bad_alleles"),
        F.count_if(~fits).alias("n_bad_frequencies"),
        (F.count("*") - F.count_distinct(F.struct("allele"))).alias("n_repeated"),
        (F.sum("frequency") > 1 + 1e-12).alias("above_one"),
    )
    return counted.where("n_bad_alleles > 0 or n_bad_frequencies > 0 or n_repeated > 0 or above_one")


def marker_digest(table: DataFrame) -> DataFrame:
    """(chrom, n_markers, digest): SHA-256 of the sorted distinct `chrom:position` lines of each chromosome, the same for any order of rows.

    A chromosome's positions meet in one array: as many as an array has markers there.
    """
    positions = table.select(*LOCUS).groupBy("chrom").agg(F.array_sort(F.collect_set("pos_grch37")).alias("places"))
    lines = F.concat(F.array_join(F.transform("places", lambda p: F.concat(F.col("chrom"), F.lit(":"), p.cast("string"))), "\n"), F.lit("\n"))
    return positions.select("chrom", F.size("places").cast("long").alias("n_markers"), F.sha2(lines, 256).alias("digest"))


def worst_chromosomes(table: DataFrame, floor: float, least_rows: int, most: int = 6) -> DataFrame:
    """The first `most` chromosomes, in biological order, of enough rows and a call rate below the floor."""
    counted = table.groupBy("chrom").agg(F.count("*").alias("n_rows"), F.count_if(F.col("call_status") != "no_call").alias("n_called"))
    rated = counted.select(chrom_order().alias("chrom_order"), "chrom", rate(F.col("n_called"), F.col("n_rows")).alias("call_rate"), "n_rows")
    return rated.where((F.col("n_rows") >= least_rows) & (F.col("call_rate") < floor)).orderBy("chrom_order").limit(most)
