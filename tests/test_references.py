"""Refusals of reference files and anchors, unknown groups of cards, citations."""

import json

import pytest

from strandframe.operators import citations, grid
from strandframe.operators import references as tables
from strandframe.sources import references


def merge_lines(*pairs):
    return [json.dumps({"refsnp_id": str(i), "merged_snapshot_data": {"merged_into": [str(t) for t in targets]}}) for i, targets in pairs]


def test_merge_records_are_checked(spark, tmp_path):
    def write(*lines):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text("\n".join(lines) + "\n")
        return str(path)

    good = merge_lines((1, [2]), (5, []), (9, [3, 4]), (10, [1]))
    got = references.checked_merge_records(spark, write(*good)).collect()
    assert {r["retired_rsid"]: r["targets"] for r in got} == {"rs1": ["rs2"], "rs5": [], "rs9": ["rs3", "rs4"], "rs10": ["rs1"]}
    for lines, word in (
        (merge_lines((1, [2]), (1, [3])), "line 2: repeated"), (merge_lines((1, [2]), (7, [3]), (6, [3])), "line 3: descending"), (merge_lines((3, [3])), "line 1: a self-merge"),
        (merge_lines((0, [3])), "no record"), (merge_lines((2, [-3])), "no record"), (["{"], "no record"), ([*good, "[]"], "line 5: no record"),
    ):
        with pytest.raises(ValueError, match=word):
            references.checked_merge_records(spark, write(*lines))


def test_placements_need_their_columns(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("\t".join(c for c in references.PLACEMENT_COLUMNS if c != "Stop") + "\n")
    with pytest.raises(ValueError, match="Stop"):
        references.read_placements(spark, str(tmp_path / "a.tsv"))


def test_too_few_anchors_are_refused(spark):
    anchors = spark.createDataFrame([("rs1", "1"), ("rs2", "2"), ("rs10", "1")], "rsid string, chrom string")
    assert [r["rsid"] for r in tables.round_robin(anchors, 3).collect()] == ["rs1", "rs2", "rs10"]
    with pytest.raises(ValueError, match="3 anchors, fewer than 4"):
        tables.round_robin(anchors, 4)


def test_unknown_sections_and_tiers_are_shown(spark):
    cards = spark.createDataFrame([(1, "known", "strong", True), (2, "new", "odd", True), (3, "later", None, False)], "card_id int, section string, tier string, interpreted boolean")
    rows = grid.grid_groups(cards, grid.GridQuery("section"), ("known", "empty")).orderBy("rank").collect()
    assert [tuple(r) for r in rows] == [(0, "known", 1, 1, 1), (1, "empty", 0, 0, 0), (2, "later", 1, 0, 1), (3, "new", 1, 1, 1)]
    tiers = grid.grid_groups(cards, grid.GridQuery("tier"), ()).orderBy("rank").collect()
    assert [r["label"] for r in tiers][-2:] == ["untiered", "odd"] and sum(r["total"] for r in tiers) == 3


def test_citations(spark):
    rows = [("doi", "https://doi.org/10.1000/a(b)", "t", None), ("PMCID", "pmc12", "t", None), ("pmid", "012", "t", None), ("accession", "rs1", "t", " "), ("accession", "rs123", "t", "dbSNP"), ("url", "javascript:x", "t", None), ("url", "https://a b", "t", None), ("url", "https://a/b", "t", "x"), (None, "1", "t", None), ("pmid", "1", "  ", None), ("book", "1", "t", None)]
    frame = spark.createDataFrame(rows, "type string, id string, title string, database string")
    got = citations.normal_citations(frame).withColumn("page", citations.citation_page(frame["type"], frame["id"], frame["database"])).collect()
    assert [r["problem"] for r in got] == [None, None, "malformed_id", "missing_database", None, "malformed_id", "malformed_id", "unexpected_database", "missing_field", "missing_field", "unknown_type"]
    assert got[0]["n_id"] == "10.1000/a(b)" and got[1]["n_id"] == "PMC12" and got[4]["page"] == "https://www.ncbi.nlm.nih.gov/snp/rs123" and got[5]["page"] is None and got[6]["page"] is None
