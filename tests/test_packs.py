"""Templates against Python's own formatter, and what packs refuse."""

import string

import pytest
from pyspark.sql import functions as F

from strandframe.functions import templates
from strandframe.operators import packs
from strandframe.sources import derived

TEXTS = [None, "", "  ", "plain", "{a}", "{a}{b}", "{{a}}", "{{{a}}}", "x{a}y{{z}}{b}", "{", "}", "{a", "a}", "{a}}", "{{a}", "{}", "{a:>3}", "{a!r}", "{c}", "{ a}", "é{a}🙂", "}}{{", "{a}\n{b}", "$1 \\ {a}"]


def plain(text, values):
    try:
        parsed = list(string.Formatter().parse(text))
    except ValueError:
        return None
    if any(n is not None and (s or c or n not in values) for _, n, s, c in parsed):
        return None
    return text.format_map(values)


def test_templates_render_as_plain_formatting(spark):
    values = {"a": "1 $0 {b}", "b": "β"}
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    filled = templates.render(F.col("t"), packs.template_values(a=F.lit(values["a"]), b=F.lit(values["b"]), n=F.lit(None)))
    got = {r["i"]: (r["x"], [c["code"] for c in r["p"]]) for r in rows.select("i", filled.alias("x"), templates.problems(F.col("t"), F.array(F.lit("a"), F.lit("b"))).alias("p")).collect()}
    for i, t in enumerate(TEXTS):
        want = None if t is None else plain(t, values)
        assert got[i][0] == want, t
        assert bool(got[i][1]) == (want is None or not t.strip()), t
    codes = {TEXTS[i]: set(c) for i, (_, c) in got.items()}
    assert codes[None] == {"template-missing"} and codes["  "] == {"template-empty"} and codes["{a"] == {"template-malformed"} and codes["{}"] == {"placeholder-positional"}
    assert codes["{a:>3}"] == {"placeholder-format"} and codes["{c}"] == {"placeholder-unknown"}


def test_every_rule_of_the_lint(spark, sf_dir):
    pack = derived.pack(spark, sf_dir)
    found = {r["code"] for r in packs.lint(pack).select("code").distinct().collect()}
    assert found >= {"citation-missing", "outcome-unresolved", "template-empty", "template-malformed", "placeholder-positional", "placeholder-format", "placeholder-unknown", "template-missing", "variant-index-unavailable"}
    none = packs.lint(pack.withColumn("genotypes", F.lit(None).cast("map<string,string>")), pack.select("card_id", F.lit("ok").alias("state")))
    assert none.where("code = 'match-missing'").count() == pack.where("kind = 'interpretation'").count() and none.where("code like 'variant-%'").isEmpty()


def test_a_lost_card_fails_the_query(spark):
    cards = spark.createDataFrame([(1, "interpretation"), (2, "interpretation"), (3, "impossibility")], "card_id int, kind string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "card_id int")
    matches = ids(1, 2, 3).withColumn("status", F.lit("matched"))
    assert packs.paired(cards, matches, ids(1, 2)).count() == 3
    for bad_matches, bad_seen, word in ((ids(1, 3), ids(1, 2), "missing_match"), (ids(1, 2, 3, 3), ids(1, 2), "repeated_match"), (ids(1, 2, 3), ids(1), "missing_observation"), (ids(1, 2, 3), ids(1, 2, 9), "unknown_observation"), (ids(1, 2, 3), ids(1, 2, 3), "observed_impossibility"), (ids(1, 2, 3, 4), ids(1, 2), "unknown_match")):
        with pytest.raises(Exception, match=word):
            packs.paired(cards, bad_matches.withColumn("status", F.lit("matched")), bad_seen).collect()


def test_strand_and_stranger_frequencies(spark):
    schema = "card_id int, status string, strand string, genotype string, low_allele string, high_allele string, frequencies array<struct<allele: string, frequency: double>>"
    rows = [
        (1, "matched", "ambiguous", "AA", "A", "T", [("A", 0.9), ("T", 0.1)]),
        (2, "matched", "as_written", "AA", "A", "T", [("A", 0.9), ("T", 0.1)]),
        (3, "matched", "complemented", "CC", "A", "G", [("G", 0.3)]),
        (4, "matched", "ambiguous", "AA", "A", "T", [("A", 0.9)]),
        (5, "no_call", None, None, "A", "T", [("A", 0.9)]),
        (6, "matched", "as_written", "AG", "A", "G", []),
    ]
    got = {r["card_id"]: (r["rarest"] and r["rarest"]["allele"], r["unpriced"]) for r in packs.strand_frequency(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("T", []), 2: ("A", []), 3: ("G", []), 4: (None, ["T"]), 5: (None, None), 6: (None, None)}
    with pytest.raises(Exception, match="declare"):
        packs.strand_frequency(spark.createDataFrame([(1, "matched", "as_written", "AA", "A", "G", [("C", 0.1)])], schema)).collect()


def test_payloads_refuse_what_they_cannot_hold(spark):
    stored = spark.createDataFrame([(1, '{"format_version": 9}')], "card_id int, payload string")
    with pytest.raises(Exception, match="version 9"):
        packs.read_payload(stored).collect()
    with pytest.raises(Exception):
        packs.read_payload(spark.createDataFrame([(1, '{"format_version": 1, "citations": "x"}')], "card_id int, payload string")).collect()
    columns = {"section": "s", "kind": "interpretation", "title": "t", "gene": None, "status": "matched", "shown_summary": "a", "shown_detail": "b", "rsid": "rs1", "chrom": "1", "low_allele": "A", "high_allele": "G", "genotype": "AG", "observed_rsid": "rs1", "strand": "as_written", "outcome": "lower", "final_tier": "strong", "call_source": "direct"}
    frame = spark.range(1).select(F.lit(1).alias("card_id"), F.lit(5).cast("long").alias("pos_grch37"), *[F.lit(v).cast("string").alias(k) for k, v in columns.items()])
    frame = frame.withColumns({"quality": F.lit(None).cast("double"), "ancestry_match": F.lit(0.5), "frequencies": F.expr("array(named_struct('allele', 'A', 'frequency', 0.1D))"), "rarest": F.expr("named_struct('frequency', 0.1D, 'allele', 'A')"), "citations": F.array(F.lit("c")), "caveats": F.array().cast("array<string>")})
    back = packs.read_payload(packs.payload(frame.withColumn("score", F.lit(0.75)))).first()
    assert back["confidence"]["score"] == 0.75 and back["gene"] is None and back["variant"]["alleles"] == ["A", "G"] and back["observation"]["imputation_quality"] is None
    with pytest.raises(Exception, match="score"):
        packs.payload(frame.withColumn("score", F.lit(float("nan")))).collect()
