"""Column functions on alleles and genotypes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import INDELS


def complement(genotype: Column) -> Column:
    """Both bases read from the other strand, sorted again."""
    other = F.translate(genotype, "ACGT", "TGCA")
    first, second = F.substring(other, 1, 1), F.substring(other, 2, 1)
    return F.concat(F.least(first, second), F.greatest(first, second))


def strand_canonical(genotype: Column) -> Column:
    """The smaller of a genotype and its complement; as it is if it has other letters than bases."""
    return F.when(genotype.rlike("^[ACGT]+$"), F.least(genotype, complement(genotype))).otherwise(genotype)


def is_palindromic(first: Column, second: Column) -> Column:
    """True for the allele pairs A/T and C/G, which look alike from both strands."""
    return F.coalesce(F.concat(F.least(first, second), F.greatest(first, second)).isin("AT", "CG"), F.lit(False))


def is_indel(first: Column, second: Column) -> Column:
    """True if an allele is an insertion or deletion code; false for nulls."""
    return F.coalesce(first.isin(*INDELS), F.lit(False)) | F.coalesce(second.isin(*INDELS), F.lit(False))


def rate(part: Column, whole: Column) -> Column:
    """part / whole to six places, zero for an empty whole."""
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(F.lit(0.0))
