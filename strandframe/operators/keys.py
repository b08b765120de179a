"""Look-ups by locus and by rsid, and the closure of rsid merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed

LOCUS = ["chrom", "pos_grch37"]


def lookup_loci(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows at the wanted loci; repeated keys repeat rows, repeated rows stay."""
    return table.join(keys.select(*LOCUS), LOCUS)


def resolve_merges(merges: DataFrame, unresolved: DataFrame, wanted: DataFrame, max_steps: int = 64) -> DataFrame:
    """(rsid, current, status) of each wanted rsid: current with its last rsid, the unresolved status, or cycle.

    A frontier of the wanted rsids follows one merge a step by an equi-join, so work depends on the wanted
    ones and the longest chain, not on all merges.
    """
    # dealt by the retired rsid once; each step then moves only the frontier
    edges = checkpointed(merges.select("retired_rsid", "current_rsid").distinct().repartition("retired_rsid"))
    live = wanted.select("rsid").distinct().select("rsid", F.col("rsid").alias("at"), F.array("rsid").alias("path"))
    done = None
    for _ in range(max_steps):
        stepped = checkpointed(live.join(edges, live["at"] == edges["retired_rsid"], "left"))
        ended = stepped.where("current_rsid is null").select("rsid", "at", F.lit("current").alias("status"))
        looped = stepped.where(F.expr("array_contains(path, current_rsid)")).select("rsid", F.lit(None).cast("string").alias("at"), F.lit("cycle").alias("status"))
        part = ended.unionByName(looped)
        done = part if done is None else done.unionByName(part)
        live = stepped.where(F.expr("current_rsid is not null and not array_contains(path, current_rsid)")).select("rsid", F.col("current_rsid").alias("at"), F.concat("path", F.array("current_rsid")).alias("path"))
        if live.isEmpty():
            break
    else:
        raise ValueError("a merge chain is longer than the limit")
    stuck = unresolved.select(F.col("retired_rsid").alias("at"), F.col("status").alias("stuck")).distinct()
    joined = done.join(stuck, "at", "left")
    return joined.select("rsid", F.when(F.col("stuck").isNull() & (F.col("status") == "current"), F.col("at")).alias("current"), F.coalesce("stuck", "status").alias("status"))


def add_current_rsid(table: DataFrame, resolved: DataFrame) -> DataFrame:
    """current_rsid of every row: the resolved one, null if it can't be resolved, itself if unknown."""
    r = resolved.select("rsid", "current", "status")
    return table.join(r, "rsid", "left").withColumn("current_rsid", F.when(F.col("status") == "current", F.col("current")).when(F.col("status").isNotNull(), F.lit(None).cast("string")).otherwise(F.col("rsid"))).drop("current", "status")


def lookup_rsids(table: DataFrame, wanted: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows whose current rsid is the current one of a wanted rsid.

    A wanted rsid without a current one, be it in a cycle or unresolved, fails the query: it can't be answered.
    Rows of the table with such an rsid only match nothing. Null wanted rsids ask for nothing.
    """
    asked = add_current_rsid(wanted.select("rsid").where("rsid is not null"), resolved)
    aim = asked.select(F.coalesce("current_rsid", F.raise_error(F.concat(F.lit("no single current rsid for "), F.col("rsid"))).cast("string")).alias("current_rsid")).distinct()
    return add_current_rsid(table, resolved).join(aim, "current_rsid", "left_semi")


def variants_by_rsid_or_locus(variants: DataFrame, rsids: DataFrame, loci: DataFrame) -> DataFrame:
    """Variants with a wanted rsid or at a wanted locus, once each: two equi semi-joins, no disjunction."""
    by_rsid = variants.join(rsids.select("rsid").distinct(), "rsid", "left_semi")
    by_locus = variants.join(loci.select(*LOCUS).distinct(), LOCUS, "left_semi")
    return by_rsid.unionByName(by_locus).distinct()
