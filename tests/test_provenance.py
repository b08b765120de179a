"""Digests, records and bundles: equal inputs are reused, changed ones refused."""

import json

import pytest
from pyspark.sql import functions as F

from strandframe.sources import bundles, provenance


def test_table_digest(spark):
    rows = [(i % 7, f"x{i % 3}", None if i % 5 == 0 else i / 3) for i in range(300)]
    frame = spark.createDataFrame(rows, "a int, b string, c double")
    one = provenance.table_digest(frame).first()
    assert one == provenance.table_digest(spark.createDataFrame(rows[::-1], "a int, b string, c double").repartition(5).select("c", "a", "b")).first() and one["n_rows"] == 300
    changed = [rows[1:], [*rows, rows[0]], [(9, *rows[0][1:]), *rows[1:]], [(rows[0][0], None, rows[0][2]), *rows[1:]]]
    others = {provenance.table_digest(spark.createDataFrame(r, "a int, b string, c double")).first()["digest"] for r in changed}
    others |= {provenance.table_digest(f).first()["digest"] for f in (frame.withColumnRenamed("a", "d"), frame.withColumn("a", F.col("a").cast("long")), frame.limit(0))}
    assert len(others) == 7 and one["digest"] not in others


def test_recorded_tables(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(50)

    ask = lambda inputs, version=1, params=None: provenance.remembered(spark, str(tmp_path / "cache"), "double", version, inputs, params or {"k": 2}, make)
    assert ask({"a": "1"}).count() == 50 and ask({"a": "1"}).count() == 50 and len(made) == 1
    ask({"a": "2"}), ask({"a": "1"}, 2), ask({"a": "1"}, 1, {"k": 3})
    assert len(made) == 4
    path = str(tmp_path / "one")
    provenance.write_recorded(spark.range(10), path, "s", 1, {"a": "1"}, {})
    assert provenance.read_recorded(spark, path, "s", 1, {"a": "1"}, {}).count() == 10
    for wrong, word in ((("t", 1, {"a": "1"}, {}), "step"), (("s", 2, {"a": "1"}, {}), "version"), (("s", 1, {"a": "9"}, {}), "inputs"), (("s", 1, {"a": "1"}, {"k": 1}), "params")):
        with pytest.raises(provenance.ProvenanceError, match=word):
            provenance.read_recorded(spark, path, *wrong)
    spark.range(1).write.mode("append").parquet(f"{path}/data")
    with pytest.raises(provenance.ProvenanceError, match="changed"):
        provenance.read_recorded(spark, path, "s", 1, {"a": "1"}, {})
    spark.range(3).write.parquet(str(tmp_path / "two/data"))
    with pytest.raises(provenance.ProvenanceError, match="no record"):
        provenance.read_recorded(spark, str(tmp_path / "two"), "s", 1, {}, {})


def test_bundles_are_checked(spark, tmp_path):
    frame, root = spark.createDataFrame([(1, "x")], "card_id int, status string"), tmp_path / "runs"
    assert bundles.list_runs(spark, str(root)).count() == 0
    path = bundles.write_bundle(frame, frame, str(root), "r1", "2024-01-02")
    assert bundles.read_bundle(spark, path)[0].collect() == frame.collect()
    frame.write.parquet(str(root / ".incoming-r3/cards"))
    (root / ".hidden").mkdir()
    (root / "r4").mkdir()
    for run, manifest in (("r5", "{"), ("r6", json.dumps({"run_id": "r6", "created_at": "2024-01-09", "format_version": 9})), ("r7", json.dumps({"run_id": "other", "created_at": "x", "format_version": 1}))):
        (root / run / "manifest").mkdir(parents=True)
        (root / run / "manifest/part-0.txt").write_text(manifest)
    assert [(r["run_id"], r["state"]) for r in bundles.list_runs(spark, str(root)).collect()] == [("r7", "damaged"), ("r6", "future-version"), ("r1", "readable"), ("r5", "damaged"), ("r4", "damaged"), ("r3", "incoming")]
    for run in ("r5", "r6"):
        with pytest.raises(bundles.BundleError):
            bundles.read_bundle(spark, str(root / run))
    old = json.dumps({"run_id": "r8", "created_at": "2020", "format_version": 1, "more": 1})
    (root / "r8/manifest").mkdir(parents=True)
    (root / "r8/manifest/part-0.txt").write_text(old)
    with pytest.raises(bundles.BundleError, match="more"):
        bundles.read_bundle(spark, str(root / "r8"))
    frame.write.mode("append").parquet(f"{path}/cards")
    with pytest.raises(bundles.BundleError, match="cards"):
        bundles.read_bundle(spark, path)
    assert bundles.read_bundle(spark, path, verify=False)[0].count() == 2
