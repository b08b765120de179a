"""Input order, panel files and ordered writing."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import order
from strandframe.sources import panels


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers_over_blocks(spark, tmp_path, small_blocks):
    rng = random.Random(1)
    files = {f"f{i}.txt": [f"{i}-{k}-" + "x" * rng.randrange(60) for k in range(n)] for i, n in enumerate((1, 40, 300))}
    for name, rows in files.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    frame = order.with_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = {(r["file"].rpartition("/")[2], r["line"]): r["value"] for r in frame.collect()}
    assert got == {(name, k + 1): x for name, rows in files.items() for k, x in enumerate(rows)}


def plain_breaks(files):
    out, last = [], None
    for name, values in sorted(files.items()):
        for line, v in enumerate(values, 1):
            if v is None:
                out.append((name, line, v, last, "missing"))
            elif last is not None and v <= last:
                out.append((name, line, v, last, "repeated" if v == last else "descending"))
            last = last if v is None else v
    return out


@pytest.mark.parametrize("run", [1, 3, 1000])
def test_order_breaks(spark, run):
    rng = random.Random(run)
    files = {f"f{i:02d}": [None if rng.random() < 0.1 else i * 30 + k + rng.choice((0, 0, 0, -1, -7)) for k in range(rng.choice((1, 2, 9, 30)))] for i in range(12)}
    files["f05"] = [None, None]
    rows = [(f, k, v) for f, values in files.items() for k, v in enumerate(values, 1)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "file string, line long, id long")
    got = sorted((tuple(r) for r in order.order_breaks(frame, "id", run).collect()), key=lambda r: r[:2])
    want = [(f, k, v, p, kind) for f, k, v, p, kind in plain_breaks(files)]
    assert got == want and want
    with pytest.raises(ValueError, match=f"{want[0][0]}, line {want[0][1]}"):
        order.require_ascending(frame, "id")
    assert order.require_ascending(frame.where("id is not null").groupBy().agg(F.max("id").alias("id")).select(F.lit("f").alias("file"), F.lit(1).alias("line"), "id"), "id").count() == 1


def test_sorted_sink(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("a"), F.col("id").alias("b"))
    order.write_sorted(rows, str(tmp_path / "t"), ["a", "b"], 6)
    assert tuple(order.sorted_proof(spark, str(tmp_path / "t"), ["a", "b"]).first()) == (5000, 6, 0)
    rows.repartition(4, "b").write.parquet(str(tmp_path / "u"))
    assert order.sorted_proof(spark, str(tmp_path / "u"), ["a", "b"]).first()["n_breaks"] > 100
    assert len({f.read_bytes() for f in (tmp_path / "t").glob("part-*")}) == 6


def test_variant_lists(spark, tmp_path, small_blocks):
    rng = random.Random(3)
    sites = [(c, rng.randrange(1, 99), f"rs{i}", "A", None if i % 9 == 0 else "G") for i in range(200) for c in (rng.choice(["1", "2", "10", "X", "MT"]),)]
    panels.write_variants(spark.createDataFrame(sites, "chrom string, pos_grch37 long, variant_id string, ref string, alt string"), str(tmp_path / "v"))
    assert panels.count_entries(spark, str(tmp_path / "v/body")) == 200 and panels.count_entries(spark, str(tmp_path / "v/header")) == 0
    text = "".join(p.read_text() for p in sorted((tmp_path / "v/header").glob("part-*"))) + "\n \n" + "".join(p.read_text() for p in sorted((tmp_path / "v/body").glob("part-*")))
    (tmp_path / "all.pvar").write_text(text)
    places = ["1", "2", "10", "X", "MT"]
    want = sorted(sites, key=lambda s: (places.index(s[0]), s[1], s[2]))
    got = panels.read_variants(spark, str(tmp_path / "all.pvar")).orderBy("line").collect()
    assert [(r["chrom"], r["pos_grch37"], r["variant_id"], r["ref"], r["alt"]) for r in got] == [(*s[:4], s[4] or ".") for s in want]
    assert [r["line"] for r in got] == list(range(4, 204)) and panels.count_entries(spark, str(tmp_path / "all.pvar")) == 200


HEAD = "#IID\tALLELE_CT\tSCORE10_AVG\tPC2_AVG\tPC2_X\tSCORE1_SUM"


def test_score_tables(spark, tmp_path):
    def write(*lines):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.sscore"
        path.write_text("\n".join(lines) + "\n")
        return str(path)

    found, least = panels.read_scores(spark, write(HEAD, "a\t90\t10\t2\t0\t1e-3", "", "b\t80.5\t-1\t-2\t0\t-3"), 3)
    assert least == 80 and {(r["sample_id"], r["component"]): r["score"] for r in found.collect()} == {("a", 1): 0.001, ("a", 2): 2.0, ("a", 3): 10.0, ("b", 1): -3.0, ("b", 2): -2.0, ("b", 3): -1.0}
    for bad, word in (
        ((HEAD, "a\t90\t10\t2\t0"), "fields"), ((HEAD,), "no samples"), (("#IID\tSCORE1_AVG", "a\t1"), "ALLELE_CT"), (("#FID\tALLELE_CT\tPC1_AVG", "a\t1\t2"), "IID"),
        ((HEAD, "a\tx\t1\t1\t1\t1"), "numbers"), ((HEAD, "a\t5\tx\t1\t1\t1"), "numbers"), (("#IID\tALLELE_CT\tPC1", "a\t1\t1"), "components"),
    ):
        with pytest.raises(panels.PanelError, match=word):
            panels.read_scores(spark, write(*bad))
    with pytest.raises(panels.PanelError, match="3 components"):
        panels.read_scores(spark, write(HEAD, "a\t90\t10\t2\t0\t1"), 10)


def test_anchor_files(spark, tmp_path):
    good = {"schema_version": 1, "source": "x", "anchors": [{"rsid": "rs1", "chrom": "1", "pos_grch37": 5, "pos_grch38": 6, "gene": "G"}, {"rsid": "rs2", "chrom": "2", "pos_grch37": 5, "pos_grch38": 7, "gene": "-"}]}

    def write(**change):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(good | change, indent=1))
        return str(path)

    assert panels.read_anchors(spark, write(), 2).count() == 2
    first, second = good["anchors"]
    for change, word in (
        ({"schema_version": 2}, "version"), ({"source": " "}, "source"), ({"anchors": []}, "anchors"), ({"anchors": [first, first]}, "repeated"), ({"anchors": [first | {"rsid": "rs01"}]}, "odd"),
        ({"anchors": [first | {"pos_grch37": 0}]}, "below"), ({"anchors": [second | {"pos_grch38": 5}]}, "equal"), ({"anchors": [first | {"rsid": None}]}, "odd"),
    ):
        with pytest.raises(panels.PanelError, match=word):
            panels.read_anchors(spark, write(**change))
    with pytest.raises(panels.PanelError, match="not 3"):
        panels.read_anchors(spark, write(), 3)
