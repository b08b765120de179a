"""Exact dedup, Merkle manifest and hard negatives against plain versions."""

import hashlib
import os
import random
import zlib
from urllib.parse import urlparse

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import exact, merkle, negatives, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind string, root int, winner int, row int"


def rows_of(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["", None, "a", "a\nb", "é\n\n", "x" * 200_000, *[f"t{i}\n{i}" for i in range(40)]]
    rows = [(rng.randrange(n), rng.choice(texts), rng.choice(["en", None]), rng.choice([None, "", "hot", "hot", "hot", "é", "z"]), rng.choice([1, None, -4]), "k", 1, 2, 3) for _ in range(n)]
    return [*rows, (None, "a", None, None, None, "k", 1, 2, 3), (None, "only", "en", "alone", 4, "k", 1, 2, 3), *rows[:7]]


def brute_manifest(rows: list[tuple]) -> list[tuple]:
    def digest(x):
        return hashlib.sha256(x.encode()).hexdigest()

    def leaf(r, text):
        fields = [None if v is None else str(v) for v in (r[0], r[3], r[2], r[4], text)]
        return digest("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in fields))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names]
    top, out = levels([t[-1][0] for t in trees]), []
    for k, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            bad = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded, proof = leaf(r, r[1].replace("\n", "")) if bad else own, []
            for tree, at in ((trees[k], i), (top, k)):
                for level in tree[:-1]:
                    lo = at - at % 3
                    run = level[lo : lo + 3]
                    proof += [x for j, x in enumerate(run) if j != at - lo]
                    folded = digest("".join(folded if j == at - lo else x for j, x in enumerate(run)))
                    at //= 3
            out.append((r[0], own, trees[k][-1][0], top[-1][0], digest("".join(proof)), folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize("n", [0, 1, 9, 3000])
def test_manifest(spark, n, monkeypatch):
    if n == 3000:  # several reshuffles and tiers
        monkeypatch.setattr(merkle, "FIRST_LEVEL", 2)
        monkeypatch.setattr(merkle, "MORE_LEVELS", 1)
        monkeypatch.setattr(merkle, "TIER", 2)
    rows = rows_of(n, n) if n > 1 else [(5, "one\ntwo", "en", None, 7, "k", 1, 2, 3)][:n]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in merkle.tamper_report(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_manifest(rows)))


def test_manifest_of_other_arity(spark):
    rows = spark.createDataFrame([(i, f"g{i % 3}", f"v{i}") for i in range(100)], "id long, g string, v string")
    got = merkle.manifest(rows, ["id", "v"], "g", "id", arity=5).collect()
    for r in got:
        assert merkle.folded(bytes(r["leaf"]), bytes(r["siblings"]), bytes(r["shape"])) == bytes(r["root"])
        assert merkle.folded(hashlib.sha256(b"other").digest(), bytes(r["siblings"]), bytes(r["shape"])) != bytes(r["root"])
    with pytest.raises(ValueError):
        merkle.manifest(rows, ["id"], "g", "id", arity=1)


def test_tables_of_a_manifest_outlive_its_scratch_tables(spark, monkeypatch):
    build, forests = merkle.build, []
    monkeypatch.setattr(merkle, "build", lambda *a: forests.append(build(*a)) or forests[-1])
    rows = spark.createDataFrame([(i, f"g{i % 3}", f"v{i}") for i in range(40)], "id long, g string, v string")
    report = merkle.manifest(rows, ["id", "v"], "g", "id")
    files = [f for forest in forests for t in (forest.leaves, forest.links, forest.roots) for f in t.inputFiles()]
    assert len(forests) == 2 and [f for f in files if not os.path.exists(urlparse(f).path)] == []
    assert report.count() == 40


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_duplicates(spark, keep, monkeypatch):
    monkeypatch.setattr(exact, "ROUNDS", 1)
    rows = rows_of(3, 2000)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(9)
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    got = exact.exact_duplicates(docs, keep=keep).collect()
    assert len(got) == len(rows)
    pick = max if keep == "largest" else min
    seen = {}
    for r in got:
        seen.setdefault(r["text_sha256"], []).append(r)
    assert len(seen) == len(groups)
    for text, ids in groups.items():
        own = seen[hashlib.sha256(text.encode()).hexdigest()]
        best = pick([i for i in ids if i is not None], default=None)
        assert {(r["keep_id"], r["group_size"]) for r in own} == {(best, len(ids))}
        assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in own) and [r["doc_id"] for r in own if r["kept"]] == [best]
    kept = exact.drop_exact_duplicates(docs, keep=keep)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact.exact_duplicates(docs.limit(0)).count() == 0
    lowered = exact.exact_duplicates(spark.createDataFrame([(1, "A"), (2, "a")], "doc_id long, text string"), normal=F.lower)
    assert [r["group_size"] for r in lowered.collect()] == [2, 2]


def brute_negatives(rows, low=80, high=100, k=5):
    ok = [(i, v, label) for i, v, label in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = [[int(np.floor(256 * x)) for x in v] for _, v, _ in ok]
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for a, (aid, _, al) in enumerate(ok):
        if aid is None or aid % 100:
            continue
        scored = [(clamp(sum(x * y for x, y in zip(ints[a], ints[b]))), ok[b][0], b) for b in range(len(ok)) if b != a]
        pos = sorted((s for s in scored if ok[s[2]][2] == al), key=order)[:k]
        for ps, pid, _ in pos:
            neg = sorted((s for s in scored if ok[s[2]][2] != al and low * ps <= 100 * s[0] <= high * ps), key=order)[:k]
            out += [(aid, pid, n + 1, nid, ps, ns) for n, (ns, nid, _) in enumerate(neg)]
    return sorted(map(str, out))


@pytest.mark.parametrize("scale", [1.0, 1e-3, 3e7])
def test_hard_negatives(spark, scale, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_ROWS", 100)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 12)) * scale
    rows = [(i, [float(x) for x in centres[i % 4] + rng.normal(size=12) * scale * 0.4], int(rng.integers(0, 3))) for i in range(1500)]
    rows += [(5000 + i, rows[100][1], i % 3) for i in range(300)]  # one vector many times
    rows += [(6000, None, 1), (6100, [], 1), (6200, [None] * 12, 1), (6300, [float("nan")] * 12, 1), (6400, [float("inf")] * 12, 1), (6500, [0.0] * 12, 2), (6600, [1.0, 2.0], 1), (6700, rows[3][1], None), (None, rows[100][1], 2), rows[200], rows[201]]
    table = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], "vec_id long, embedding array<double>, label int, row int, x int, s1 string").repartition(4)
    got = [tuple(r) for r in negatives.hard_negatives(table, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(map(str, got)) == brute_negatives(rows)
    assert negatives.hard_negatives(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_exact_dedup"])
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(str(tuple(r)) for r in got.select(*want.columns).collect()) == sorted(map(str, want.fetchall()))


def test_manifest_query(spark, sf_dir):
    docs = [tuple(r) + ("k", 1, 2, 3) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = [tuple(r) for r in queries.op11_merkle_manifest(spark, sf_dir).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_manifest(docs)))
