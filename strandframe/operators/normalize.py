"""From raw vendor rows (five strings) to the normalized genotype table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import computed_once
from ..schema import ALLELES, LENGTHS, NO_CALL, literal_map

RAW = ("rsid", "chrom", "pos", "a1", "a2")
#: Checks in the order in which they are reported.
CHECKS = ("empty_field", "unknown_chrom", "bad_position", "zero_position", "beyond_end", "bad_allele", "half_call")


def split_genotype(raw: DataFrame, genotype: str = "genotype") -> DataFrame:
    """a1 and a2 from a merged genotype: -- is no call, one letter stands for both; `malformed` marks other lengths."""
    g = F.upper(F.trim(genotype))
    n = F.length(g)
    return raw.withColumns(
        {
            "a1": F.when(g == "--", NO_CALL).when(n.isin(1, 2), F.substring(g, 1, 1)),
            "a2": F.when(g == "--", NO_CALL).when(n == 2, F.substring(g, 2, 1)).when(n == 1, g),
            "malformed": F.coalesce(~n.isin(1, 2), F.lit(True)),
        }
    )


def cleaned(raw: DataFrame, codes: dict[str, str]) -> DataFrame:
    """Trimmed and typed columns beside the raw ones, each computed once: c_rsid, c_chrom, c_pos, c_a1, c_a2, and c_empty for a missing field."""
    pos = F.trim("pos")
    return computed_once(
        raw,
        {
            "c_rsid": F.trim("rsid"),
            "c_chrom": F.try_element_at(literal_map(codes), F.trim("chrom")),
            "c_pos": F.when(pos.rlike("^[0-9]+$"), F.expr("try_cast(trim(pos) as bigint)")),
            "c_a1": F.upper(F.trim("a1")),
            "c_a2": F.upper(F.trim("a2")),
            "c_empty": F.col("rsid").isNull() | F.col("chrom").isNull() | F.col("pos").isNull() | F.col("a1").isNull() | F.col("a2").isNull(),
        },
    )


def first_failure() -> Column:
    """The first check that a cleaned row fails; null for a sound row."""
    letters = [*ALLELES, NO_CALL]
    failing = {
        "empty_field": F.col("c_empty"),
        "unknown_chrom": F.col("c_chrom").isNull(),
        "bad_position": F.coalesce(F.col("c_pos") >= 2**32, F.lit(True)),
        "zero_position": F.col("c_pos") == 0,
        "beyond_end": F.col("c_pos") > F.try_element_at(literal_map(LENGTHS), F.col("c_chrom")),
        "bad_allele": ~(F.col("c_a1").isin(letters) & F.col("c_a2").isin(letters)),
        "half_call": (F.col("c_a1") == NO_CALL) != (F.col("c_a2") == NO_CALL),
    }
    return F.coalesce(*[F.when(failing[name], name) for name in CHECKS])


def error_summary(raw: DataFrame, codes: dict[str, str], order: list[str]) -> DataFrame:
    """A row per check in order: how many rows fail it first, and the first one's rsid by `order`; one aggregate pass."""
    flagged = cleaned(raw, codes).withColumn("check", first_failure()).where("check is not null")
    counted = flagged.groupBy("check").agg(F.count("*").alias("n_rows"), F.min(F.struct(*order, "rsid")).alias("lowest"))
    names = raw.sparkSession.createDataFrame(list(enumerate(CHECKS)), "precedence int, check string")
    return names.join(counted, "check", "left").select("precedence", "check", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.col("lowest.rsid").alias("first_rsid"))


def normalize(raw: DataFrame, codes: dict[str, str], carry: tuple[str, ...] = ()) -> DataFrame:
    """The normalized table of rows that pass all checks; carry names extra columns to keep.

    Alleles are sorted; a no-call has null alleles and genotype, so every later predicate fails closed on it.
    """
    called = F.col("c_a1") != NO_CALL
    low, high = F.least("c_a1", "c_a2"), F.greatest("c_a1", "c_a2")
    return cleaned(raw, codes).where(first_failure().isNull()).select(
        F.col("c_rsid").alias("rsid"),
        F.col("c_chrom").alias("chrom"),
        F.col("c_pos").alias("pos_grch37"),
        F.when(called, low).alias("allele1"),
        F.when(called, high).alias("allele2"),
        F.when(called, F.concat(low, high)).alias("genotype"),
        F.when(called, "called").otherwise("no_call").alias("call_status"),
        *carry,
    )
