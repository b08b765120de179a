"""All queries of the genotype engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles, privacy
from ..operators import ancestry, checks, confidence, grid, keys, matching, normalize, packs, qc, references
from ..schema import NUMERIC_CODES, chrom_order
from ..sources import derived
from .twins import SQL

Query = Callable[[SparkSession, str], DataFrame]
SECTIONS = tuple(f"section {i}" for i in range(13))
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in SQL.items() if name in _QUERIES}


def _table(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    return normalize.normalize(derived.raw_export(spark, sf_dir), NUMERIC_CODES, tuple(derived.SOURCE_ORDER) if ordered else ())


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, True)
    ploid = qc.resolve_ploidy(rows, qc.infer_sex(qc.sample_counts(rows)))
    return matching.resolve_probes(ploid, derived.SOURCE_ORDER)


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_cards(derived.cards(spark, sf_dir), _probes(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence.with_confidence(derived.cards(spark, sf_dir).where("kind = 'interpretation'"))


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _matches(spark, sf_dir).select("card_id", "status", "outcome")
    scored = _scored(spark, sf_dir).select("card_id", "score", "final_tier")
    cards = derived.cards(spark, sf_dir).select("card_id", "kind", "title", "section")
    ok = F.col("status") == "matched"
    return packs.paired(cards, found, scored).select(
        "card_id", "kind", "title", "section", "status", "outcome", F.when(ok, F.col("score")).alias("score"), F.when(ok, F.col("final_tier")).alias("tier"), ok.alias("interpreted")
    )


@query
def normalize_genotypes(spark, sf_dir):
    return _table(spark, sf_dir)


@query
def normalize_damaged(spark, sf_dir):
    return normalize.normalize(derived.damaged_export(spark, sf_dir), NUMERIC_CODES)


@query
def normalize_error_summary(spark, sf_dir):
    return normalize.error_summary(derived.damaged_export(spark, sf_dir), NUMERIC_CODES, derived.SOURCE_ORDER)


@query
def merged_genotype_split(spark, sf_dir):
    split = normalize.split_genotype(derived.merged_export(spark, sf_dir))
    return split.groupBy("a1", "a2", "malformed").agg(F.count("*").alias("n_rows"))


@query
def call_rate_overall(spark, sf_dir):
    return qc.call_rate_rollup(_table(spark, sf_dir)).where("chrom is null").drop("chrom")


@query
def call_rate_by_chrom(spark, sf_dir):
    return qc.call_rates(_table(spark, sf_dir))


@query
def call_rate_rollup(spark, sf_dir):
    return qc.call_rate_rollup(_table(spark, sf_dir))


@query
def heterozygosity(spark, sf_dir):
    return qc.heterozygosity(_table(spark, sf_dir))


@query
def infer_sex(spark, sf_dir):
    return qc.infer_sex(qc.sample_counts(_table(spark, sf_dir))).select("x_loci", "x_rate", "y_rows", "y_rate", "sex")


@query
def resolve_ploidy(spark, sf_dir):
    rows = _table(spark, sf_dir)
    return qc.resolve_ploidy(rows, qc.infer_sex(qc.sample_counts(rows))).groupBy("chrom", "call_status").agg(F.count("*").alias("n_rows"))


@query
def het_haploid_count(spark, sf_dir):
    rows = _table(spark, sf_dir)
    return qc.resolve_ploidy(rows, qc.infer_sex(qc.sample_counts(rows))).agg(F.count_if(F.col("call_status") == "het_haploid").alias("n_het_haploid"))


@query
def indel_summary(spark, sf_dir):
    return qc.sample_counts(_table(spark, sf_dir)).select("n_indels")


@query
def indel_policy_matchable(spark, sf_dir):
    rows = _table(spark, sf_dir)
    listed = derived.cards(spark, sf_dir).select("rsid").distinct().withColumn("listed", F.lit(True))
    indel = alleles.is_indel(F.col("allele1"), F.col("allele2"))
    return rows.join(listed, "rsid", "left").where(~indel | F.col("listed")).groupBy("chrom").agg(F.count("*").alias("n_matchable"))


@query
def duplicate_summary(spark, sf_dir):
    return qc.duplicate_summary(_table(spark, sf_dir))


@query
def build_check(spark, sf_dir):
    return qc.build_check(_table(spark, sf_dir), derived.anchors(spark, sf_dir))


@query
def absent_chromosomes(spark, sf_dir):
    return qc.absent_chromosomes(_table(spark, sf_dir).where("chrom not in ('7', 'PAR', 'Y')"))


@query
def qc_warnings(spark, sf_dir):
    return qc.qc_warnings(_table(spark, sf_dir), derived.anchors(spark, sf_dir))


@query
def locus_lookup_inner(spark, sf_dir):
    return keys.lookup_loci(_table(spark, sf_dir), derived.cards(spark, sf_dir)).select("chrom", "pos_grch37", "rsid", "genotype", "call_status")


@query
def rsid_lookup_semi(spark, sf_dir):
    merges, stuck = derived.merges(spark, sf_dir), derived.unresolved(spark, sf_dir)
    rows = derived.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat('rs', cast(o_custkey as string)) rsid")
    retired = merges.select(F.col("retired_rsid").alias("rsid"))
    resolved = keys.resolve_merges(merges, stuck, rows.select("rsid").unionByName(retired))
    # asking for one without a current rsid would be refused
    wanted = resolved.where("status = 'current'").join(retired, "rsid", "left_semi")
    return keys.lookup_rsids(rows, wanted, resolved).select("o_orderkey", "rsid", "current_rsid")


@query
def current_rsid(spark, sf_dir):
    merges, stuck = derived.merges(spark, sf_dir), derived.unresolved(spark, sf_dir)
    rows = derived.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat('rs', cast(o_custkey as string)) rsid")
    return keys.add_current_rsid(rows, keys.resolve_merges(merges, stuck, rows))


@query
def rsid_resolution_status(spark, sf_dir):
    merges = derived.merges(spark, sf_dir)
    return keys.resolve_merges(merges, derived.unresolved(spark, sf_dir), merges.select(F.col("retired_rsid").alias("rsid")))


@query
def merge_split_resolved(spark, sf_dir):
    return references.split_merges(derived.merge_records(spark, sf_dir))[0]


@query
def merge_split_unresolved(spark, sf_dir):
    rest = references.split_merges(derived.merge_records(spark, sf_dir))[1]
    return rest.select("retired_rsid", "status", F.array_join("targets", ",").alias("targets"))


@query
def variant_cross_check(spark, sf_dir):
    reference = derived.table(spark, sf_dir, "part").selectExpr("p_partkey p").join(derived.cards(spark, sf_dir), F.col("p") == F.col("card_id"))
    reference = reference.where("p % 7 <> 0").selectExpr(
        "case when p % 5 = 1 then 'rs1' else rsid end rsid", "chrom", "pos_grch37 + case when p % 4 = 1 then 20000 else 0 end pos_grch37", "low_allele ref", "case when p % 3 = 1 then low_allele else high_allele end alt"
    )
    return references.cross_check(derived.cards(spark, sf_dir), reference)


@query
def variant_lookup_rsid_or_locus(spark, sf_dir):
    variants = _table(spark, sf_dir).select("rsid", "chrom", "pos_grch37")
    cards = derived.cards(spark, sf_dir)
    return keys.variants_by_rsid_or_locus(variants, cards.where("card_id % 2 = 0"), cards.where("card_id % 2 = 1"))


@query
def duplicate_probe_resolution(spark, sf_dir):
    return _probes(spark, sf_dir)


@query
def card_match(spark, sf_dir):
    return _matches(spark, sf_dir)


@query
def match_status_counts(spark, sf_dir):
    return matching.status_counts(_matches(spark, sf_dir))


@query
def strand_orientation(spark, sf_dir):
    g = F.col("genotype")
    rows = _table(spark, sf_dir).where("genotype rlike '^[ACGT]+$'")
    return rows.groupBy("genotype", alleles.complement(g).alias("other_strand"), alleles.strand_canonical(g).alias("canonical")).agg(F.count("*").alias("n_rows"))


@query
def genotype_enumeration(spark, sf_dir):
    return matching.genotype_pairs(derived.cards(spark, sf_dir))


@query
def confidence_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("card_id", "score", "tier", "final_tier")


@query
def confidence_tier_counts(spark, sf_dir):
    return confidence.tier_counts(_scored(spark, sf_dir))


@query
def rarest_called_allele(spark, sf_dir):
    cards = derived.cards(spark, sf_dir)
    called = cards.join(_probes(spark, sf_dir).where("genotype is not null").drop("rsid"), keys.LOCUS).select("card_id", "allele1", "allele2")
    known = cards.where("frequency is not null")
    frequencies = known.select("card_id", F.col("low_allele").alias("allele"), "frequency").unionByName(known.select("card_id", F.col("high_allele").alias("allele"), (F.lit(1.0) - F.col("frequency")).alias("frequency")))
    return confidence.rarest_allele(called, frequencies).select("card_id", "allele", F.round("frequency", 6).alias("frequency"), "n_missing")


@query
def assembled_cards(spark, sf_dir):
    return _assembled(spark, sf_dir)


@query
def card_grid_by_section(spark, sf_dir):
    return grid.grid_groups(_assembled(spark, sf_dir), grid.GridQuery("section", interpreted_only=True), SECTIONS)


@query
def card_grid_by_tier(spark, sf_dir):
    return grid.grid_groups(_assembled(spark, sf_dir), grid.GridQuery("tier", sections=SECTIONS[:5]), SECTIONS)


@query
def card_grid_sorted(spark, sf_dir):
    return grid.grid_cards(_assembled(spark, sf_dir), grid.GridQuery(sort="title", tiers=("moderate", "limited")), SECTIONS).select("card_id", "title", "section", "tier")


@query
def anchor_pairing(spark, sf_dir):
    return references.pair_anchors(derived.placements(spark, sf_dir))


@query
def anchor_round_robin(spark, sf_dir):
    return references.round_robin(references.pair_anchors(derived.placements(spark, sf_dir)), 200, least=1)


@query
def panel_site_qc(spark, sf_dir):
    return ancestry.panel_site_qc(derived.panel(spark, sf_dir))


@query
def duplicate_site_removal(spark, sf_dir):
    sites = derived.panel(spark, sf_dir).select("variant_id", "chrom", "pos_grch37").distinct()
    return ancestry.drop_duplicate_sites(sites, ["chrom", "pos_grch37"])


@query
def panel_range_exclusion(spark, sf_dir):
    sites = derived.panel(spark, sf_dir).select("variant_id", "chrom", "pos_grch37").distinct()
    ranges = derived.table(spark, sf_dir, "nation").selectExpr("cast(1 + n_nationkey % 22 as string) chrom", "cast(n_nationkey * 600 as bigint) from_pos", "cast(n_nationkey * 600 + 2500 as bigint) to_pos")
    return ancestry.exclude_ranges(sites, ranges)


@query
def panel_array_intersection(spark, sf_dir):
    sites = derived.panel(spark, sf_dir).select("variant_id", "chrom", "pos_grch37").distinct()
    return ancestry.panel_array_intersection(sites, _table(spark, sf_dir))


@query
def panel_harmonization(spark, sf_dir):
    sites = derived.panel(spark, sf_dir).select("variant_id", "chrom", "pos_grch37", "ref", "alt").distinct()
    return ancestry.harmonize(sites, _probes(spark, sf_dir))


@query
def projection_scores(spark, sf_dir):
    return ancestry.project(derived.panel(spark, sf_dir), derived.panel_weights(spark, sf_dir))


@query
def projection_coverage(spark, sf_dir):
    return ancestry.projection_coverage(derived.panel(spark, sf_dir), derived.panel_weights(spark, sf_dir))


@query
def linked_sites(spark, sf_dir):
    return ancestry.linked_pairs(derived.panel(spark, sf_dir), window=6000, r2=0.02)


@query
def ld_prune(spark, sf_dir):
    return ancestry.ld_prune(derived.panel(spark, sf_dir), window=6000, r2=0.02)


@query
def reference_pca(spark, sf_dir):
    return ancestry.reference_components(derived.panel(spark, sf_dir), k=10, least_samples=40, least_markers=0)


@query
def privacy_scan(spark, sf_dir):
    return privacy.leak_counts(derived.table(spark, sf_dir, "documents"), "text", "doc_id")


@query
def merge_artifact_overlap(spark, sf_dir):
    both = derived.merges(spark, sf_dir).where("cast(substr(retired_rsid, 3) as bigint) % 7 = 0").select("retired_rsid", F.lit("ambiguous").alias("status"))
    return checks.artifact_overlap(derived.merges(spark, sf_dir), derived.unresolved(spark, sf_dir).unionByName(both))


@query
def site_id_problems(spark, sf_dir):
    sites = derived.table(spark, sf_dir, "supplier").selectExpr("case when s_suppkey % 11 = 0 then '.' when s_suppkey % 13 = 0 then '' when s_suppkey % 17 = 0 then null else concat('rs', cast(s_suppkey div 2 as string)) end variant_id")
    return checks.id_problems(sites)


@query
def genotype_map_gaps(spark, sf_dir):
    cards = derived.cards(spark, sf_dir)
    return checks.genotype_gaps(derived.declared_genotypes(matching.genotype_pairs(cards)), cards)


@query
def outcome_gaps(spark, sf_dir):
    cards = derived.cards(spark, sf_dir)
    used = cards.select("card_id", F.explode(F.array("low_outcome", "mid_outcome", "high_outcome")).alias("outcome"))
    known = cards.select("card_id", F.explode(F.expr("if(card_id % 9 = 0, array('lower', 'higher', 'none'), array('lower', 'between', 'higher'))")).alias("outcome"))
    return checks.outcome_gaps(used, known)


@query
def orphan_observations(spark, sf_dir):
    seen = derived.table(spark, sf_dir, "lineitem").selectExpr("l_partkey + l_linenumber * 10 card_id").distinct()
    return checks.orphan_observations(seen, derived.cards(spark, sf_dir))


@query
def frequency_problems(spark, sf_dir):
    return checks.frequency_problems(derived.damaged_frequencies(derived.cards(spark, sf_dir)))


@query
def marker_digest(spark, sf_dir):
    return checks.marker_digest(_table(spark, sf_dir))


@query
def worst_chromosomes(spark, sf_dir):
    return checks.worst_chromosomes(_table(spark, sf_dir), 0.99, 20)


@query
def privacy_shapes(spark, sf_dir):
    return privacy.leak_counts(derived.genotype_notes(spark, sf_dir), "note", "shape").groupBy("shape").agg(*[F.sum(f"n_{n}").alias(f"n_{n}") for n in privacy.PATTERNS])


@query
def privacy_spans(spark, sf_dir):
    notes = derived.genotype_notes(spark, sf_dir)
    found = notes.select("shape", F.explode(privacy.find("note")).alias("hit"))
    return found.groupBy("shape", "hit.pattern").agg(F.count("*").alias("n_hits"), F.sum("hit.start").alias("sum_start"), F.sum("hit.end").alias("sum_end"))


@query
def array_markers(spark, sf_dir):
    markers = _table(spark, sf_dir).select("chrom", "pos_grch37", chrom_order().alias("chrom_order")).where("chrom_order < 22").distinct()
    return markers.orderBy("chrom_order", "pos_grch37")


from . import inputs as input_plans  # noqa: E402, F401 - registers further queries
from . import packs as pack_plans  # noqa: E402, F401
