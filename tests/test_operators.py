"""Operators on small tables, and the parts that SQL can't express."""

import pytest
from pyspark.sql import functions as F

from strandframe.functions import privacy
from strandframe.operators import ancestry, confidence, grid, keys, matching, normalize
from strandframe.plans import registry
from strandframe.schema import LETTER_CODES, NUMERIC_CODES
from strandframe.sources import bundles, exports, references
from strandframe.streaming import ingest


COLUMNS = "rsid\tchromosome\tposition\tallele1\tallele2"


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_numeric_export(spark, tmp_path):
    lines = ["#AncestryDNA raw data", "#build 37.1", "#", "#", "#", "rsid\tchromosome\tposition\tallele1\tallele2", "rs1\t23\t100\tG\tA", "rs2\t1\t5\t0\t0"]
    raw, layout = exports.read_export(spark, write(tmp_path / "a.txt", lines))
    rows = {r["rsid"]: r for r in normalize.normalize(raw, layout.codes).collect()}
    assert (rows["rs1"]["chrom"], rows["rs1"]["genotype"], rows["rs1"]["call_status"]) == ("X", "AG", "called")
    assert rows["rs2"]["genotype"] is None and rows["rs2"]["call_status"] == "no_call"


def test_merged_export(spark, tmp_path):
    lines = ["# rsid\tchromosome\tposition\tgenotype", "# build 37", "rs1\tMT\t7\tA", "rs2\tX\t9\t--", "rs3\t2\t9\tTC"]
    raw, layout = exports.read_export(spark, write(tmp_path / "b.txt", lines))
    assert layout.codes is LETTER_CODES
    assert {r["rsid"]: r["genotype"] for r in normalize.normalize(raw, layout.codes).collect()} == {"rs1": "AA", "rs2": None, "rs3": "CT"}


@pytest.mark.parametrize(
    "lines", [["#AncestryDNA", "#build 38", "rs1\t1\t1\tA\tA"], ["nothing"], ["#AncestryDNA", "#build 37", *["#"] * 3, COLUMNS, "rs1\t1\t1\tA"], ["#AncestryDNA", *["#build 37"] * 4, "rs1\t1\t1\tA\tA"], ["#AncestryDNA", "#build 37", COLUMNS, "rs1\t1\t1\tA\tA"], ["#AncestryDNA", *["#build 37"] * 4, COLUMNS.replace("allele2", "b"), "rs1\t1\t1\tA\tA"], ["#AncestryDNA", "# rsid chromosome position genotype", "#build 37"]]
)
def test_refused_exports(spark, tmp_path, lines):
    with pytest.raises(exports.IngestError):
        exports.read_export(spark, write(tmp_path / "c.txt", lines))


def test_error_precedence(spark):
    raw = spark.createDataFrame([("rs1", "99", "0", "N", "A", 1), (None, "99", "0", "N", "A", 2), ("rs3", "1", "0", "N", "A", 3), ("rs4", "26", "16570", "A", "A", 4), ("rs5", "1", "5", "0", "A", 5)], "rsid string, chrom string, pos string, a1 string, a2 string, line int")
    found = {r["check"]: (r["n_rows"], r["first_rsid"]) for r in normalize.error_summary(raw, NUMERIC_CODES, ["line"]).collect()}
    assert found["empty_field"] == (1, None) and found["unknown_chrom"] == (1, "rs1") and found["zero_position"] == (1, "rs3")
    assert found["beyond_end"] == (1, "rs4") and found["half_call"] == (1, "rs5") and found["bad_allele"] == (0, None)


def test_merge_cycle_and_ambiguity(spark):
    merges = spark.createDataFrame([("rs1", "rs2"), ("rs2", "rs3"), ("rs8", "rs9"), ("rs9", "rs8")], "retired_rsid string, current_rsid string")
    stuck = spark.createDataFrame([("rs3", "ambiguous")], "retired_rsid string, status string")
    wanted = spark.createDataFrame([("rs1",), ("rs8",), ("rs7",)], "rsid string")
    assert {r["rsid"]: (r["current"], r["status"]) for r in keys.resolve_merges(merges, stuck, wanted).collect()} == {"rs1": (None, "ambiguous"), "rs8": (None, "cycle"), "rs7": ("rs7", "current")}


def test_probes_conflict_only_when_strands_disagree(spark):
    rows = [("1", 5, "rs1", "A", "G", "AG", "called", 1), ("1", 5, "rs2", "C", "T", "CT", "called", 2), ("1", 6, "rs3", "A", "A", "AA", "called", 3), ("1", 6, "rs4", "A", "C", "AC", "called", 4), ("1", 7, "rs5", None, None, None, "no_call", 5)]
    table = spark.createDataFrame(rows, "chrom string, pos_grch37 long, rsid string, allele1 string, allele2 string, genotype string, call_status string, line int")
    found = {r["pos_grch37"]: r for r in matching.resolve_probes(table, ["line"]).collect()}
    assert not found[5]["conflict"] and found[5]["rsid"] == "rs1" and found[6]["conflict"] and found[6]["n_called"] == 2 and found[7]["genotype"] is None


def test_rare_frequency_is_likely_artifact(spark):
    row = spark.createDataFrame([("expert_curated", "meta_analysis", "odds_ratio", 4.0, None, None, 1e-6, None, 0.9)], "evidence string, replication string, effect_kind string, effect_value double, ci_low double, ci_high double, frequency double, quality double, ancestry_match double")
    assert confidence.with_confidence(row).first()["final_tier"] == "likely-artifact"


def test_query_parsing():
    query = grid.parse_query([("group", "tier"), ("group", "section"), ("tier", "strong"), ("tier", "bogus"), ("x", "1")], ("a", "b"))
    assert query.group == "section" and query.tiers == ("strong",) and query.ignored == ("tier=bogus", "x=1")


def test_pruning_is_greedy_by_position(spark, sf_dir):
    from strandframe.sources import derived

    panel = derived.panel(spark, sf_dir).withColumn("chrom", F.lit("1"))
    sites = sorted((r["pos_grch37"], r["variant_id"]) for r in panel.select("variant_id", "pos_grch37").distinct().collect())
    links = {(r["keep_id"], r["drop_id"]) for r in ancestry.linked_pairs(panel, 16000, 0.0).collect()}
    kept: list[int] = []
    for _, v in sites:
        if not any((k, v) in links for k in kept):
            kept.append(v)
    assert links and {r[0] for r in ancestry.ld_prune(panel, 16000, 0.0).collect()} == set(kept)


def test_components_are_eigenvectors(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = [(v, s, int(rng.integers(0, 2) + (s % 2) * (v % 2))) for v in range(60) for s in range(20)]
    frame = spark.createDataFrame(data, "variant_id int, sample_id int, dosage int")
    g = np.zeros((60, 20))
    for v, s, d in data:
        g[v, s] = d
    p = g.mean(axis=1, keepdims=True) / 2
    z = ((g - 2 * p) / np.sqrt(2 * p * (1 - p)))[(p[:, 0] > 0) & (p[:, 0] < 1)]
    want = np.linalg.svd(z)[0][:, 0]
    got = {r["variant_id"]: r["weight"] for r in ancestry.reference_components(frame, 1, 0, 0).collect()}
    assert abs(abs(np.dot([got[k] for k in sorted(got)], want)) - 1) < 1e-6


def test_small_panels_and_poor_coverage_are_refused(spark):
    frame = spark.createDataFrame([(v, s, (v + s) % 3) for v in range(4) for s in range(6)], "variant_id int, sample_id int, dosage int")
    for limits in ({"least_samples": 50}, {"least_markers": 1000}):
        with pytest.raises(ValueError, match="fewer than"):
            ancestry.reference_components(frame, 1, **limits)
    weights = spark.createDataFrame([(v, 0.5, 1, 1.0) for v in range(10)], "variant_id int, frequency double, component int, weight double")
    with pytest.raises(ValueError, match="less than"):
        ancestry.covered_projection(frame, weights)
    assert ancestry.covered_projection(frame, weights, 0.4).count() == 6


def test_impossible_effects_and_unresolved_rsids_are_refused(spark):
    columns = "evidence string, replication string, effect_kind string, effect_value double, ci_low double, ci_high double, frequency double, quality double, ancestry_match double"
    good = ("functional", "independent", "odds_ratio", 2.0, None, None, 0.1, None, None)
    assert confidence.with_confidence(spark.createDataFrame([good], columns)).first()["score"] > 0
    for place, bad in ((0, "rumour"), (3, -1.0), (3, float("nan")), (2, "share"), (6, 1.5)):
        row = tuple(bad if i == place else x for i, x in enumerate(good))
        with pytest.raises(Exception):  # noqa: B017
            confidence.with_confidence(spark.createDataFrame([row], columns)).collect()
    table = spark.createDataFrame([("rs1",), ("rs3",)], "rsid string")
    resolved = spark.createDataFrame([("rs1", "rs3", "current"), ("rs2", None, "ambiguous")], "rsid string, current string, status string")
    assert {r["rsid"] for r in keys.lookup_rsids(table, spark.createDataFrame([("rs1",)], "rsid string"), resolved).collect()} == {"rs1", "rs3"}
    with pytest.raises(Exception, match="no single current rsid for rs2"):
        keys.lookup_rsids(table, spark.createDataFrame([("rs2",)], "rsid string"), resolved).collect()


def test_genotype_spans_in_notes(spark):
    text = "é rs12\n rs7\t1\t55\tA\tG\n"
    found = spark.createDataFrame([(text,), (None,)], "note string").select(privacy.find("note").alias("f")).collect()
    # white space around a row belongs to the match
    assert {(h["pattern"], h["start"]) for h in found[0]["f"]} == {("ancestry_row", 7), ("escaped_row", 8)} and found[1]["f"] == []


def test_reference_readers(spark, tmp_path):
    vcf = write(tmp_path / "v.vcf", ["##x", "NC_000001.10\t10\trs5\tA\tC,G\t.\t.", "NT_1\t10\trs6\tA\tC\t.", "NC_012920.1\t7\trs7\tA\t.\t."])
    assert [tuple(r) for r in references.read_variant_vcf(spark, vcf).collect()] == [("rs5", "1", 10, "A", ["C", "G"])]
    merged = write(tmp_path / "m.json", ['{"refsnp_id":"1","merged_snapshot_data":{"merged_into":["2"]}}', '{"refsnp_id":"3","merged_snapshot_data":{"merged_into":[]}}'])
    assert sorted((r[0], list(r[1])) for r in references.read_merge_records(spark, merged).collect()) == [("rs1", ["rs2"]), ("rs3", [])]


def test_bundles(spark, tmp_path):
    frame = spark.createDataFrame([(1, "x")], "card_id int, status string")
    path = bundles.write_bundle(frame, frame, str(tmp_path), "run1", "2024-01-01T00:00:00Z")
    cards, _ = bundles.read_bundle(spark, path)
    assert cards.collect() == frame.collect()
    assert [tuple(r) for r in bundles.list_runs(spark, str(tmp_path)).collect()] == [("run1", "2024-01-01T00:00:00Z", 2, "readable")]
    with pytest.raises(Exception, match="already exists"):
        bundles.write_bundle(frame, frame, str(tmp_path), "run1", "later")


def test_incremental_ingest(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for name in ("rs1", "rs2"):
        spark.createDataFrame([(name, "1", "5", "A", "G")], ingest.RAW_SCHEMA).write.mode("append").parquet(source)
        ingest.append_new_exports(spark, source, target, state, NUMERIC_CODES).awaitTermination(120)
    assert {r["rsid"] for r in spark.read.parquet(target).collect()} == {"rs1", "rs2"}


def test_entry_without_training_operators(spark):
    import __spark_entry__ as entry

    assert {"call_rate_by_chrom", "card_match"} <= set(entry.queries()) and entry.entry(spark).count() == 26


@pytest.mark.parametrize("name", ["normalize_genotypes", "normalize_damaged", "strand_orientation"])
def test_generated_methods_stay_compiled(spark, sf_dir, name):
    # an adaptive plan shows its stages only as they run
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenStringSeq(plan)
    largest = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    assert largest and max(largest) < 8000  # the JVM interprets longer ones
