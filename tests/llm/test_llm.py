"""Each operator against a plain version of itself, and on awkward rows."""

import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandframe.llm import common, gam, hnsw, langid, packing, prefix_tokens, queries, simhash, spaced_seeds, url_trie

AWKWARD = [(1, None), (2, ""), (None, "one two"), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, " \n\t\n "), (6, "x" * 50_000), (7, "é ß 日本 🙂 " * 20), (8, "word " * 40_000)]


@pytest.fixture(scope="module")
def awkward(spark):
    # extra columns with names that operators use themselves
    return spark.createDataFrame([(i, t, "en", "x", 1, 2) for i, t in AWKWARD], "doc_id long, text string, lang string, score string, pos int, n int")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_components(spark):
    rng, parent = random.Random(1), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7), (None, 3)]
    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({x for e in edges if e[0] is not None and e[0] != e[1] for x in e}) and all(find(r["node"]) == r["component"] for r in got)


def test_url_filter(spark):
    rules = [url_trie.UrlRule(*r) for r in (*queries.URL_RULES, ("block", "net", ""), ("allow", "a.net", "/x/y/"), ("block", "a.net", "/x"), ("allow", "a.net", "/x"))]
    urls = [None, "", "no scheme", "http://", "HTTP://Example.COM/en/7?q", "https://m.example.com/en/8#x", "http://com/en/", "http://badcom/en/", "http://b.a.net/x/y/z", "http://a.net/x/y", "http://a.net/xx", "http://net", "http://org/es/://x", "http://É.org/es/", "http://x.org/es/a/../b"] * 2
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string")

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
        return host, path, best and best.text, best.verdict if best else "allow"

    for limit in (10**6, 0):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_trie.filter_urls(pages, rules, max_broadcast_chars=limit).collect()}
        assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert url_trie.filter_urls(pages.limit(0), rules).count() == 0


def test_url_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = con.sql(queries.OP1_SQL)
    got = queries.op1_url_filter(spark, sf_dir)
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(2500, 24))
    base[100:400] = base[7]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(5000, None), (5020, []), (5040, [0.0] * 24), (5060, [float("nan")] * 24), (5080, [None] * 24), (5100, [1.0, 2.0]), (5101, [2.0, 1.0]), (None, [1.0] * 24), rows[20]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hnsw.nearest(frame, frame.where("vec_id % 20 = 0"), 20, shard_rows=700).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == [*range(0, 2500, 20), 5100] and [x[1] for x in found[5100]] == [5101]
    hits = total = 0
    for q in range(0, 2500, 20):
        scores = base @ base[q]
        want = [i for i in sorted(range(2500), key=lambda i: (-round(scores[i], 9), i)) if i != q][:20]
        own = sorted(found[q])
        assert [x[0] for x in own] == list(range(1, 21)) and all(abs(x[2] - scores[x[1]]) < 1e-9 for x in own)
        hits += len({x[1] for x in own} & set(want))
        total += 20
    assert hits / total >= 0.9
    assert hnsw.nearest(frame.limit(0), frame.limit(0), 20).count() == 0


def test_neighbours_of_any_size(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8, 4))
    base[[0, 3, 5]] *= [[1e150], [1e120], [1e-200]]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = hnsw.nearest(frame, frame.where("vec_id = 0"), 5).orderBy("rank").collect()
    scores = base @ base[0]
    assert [r["vec_id"] for r in got] == [i for i in sorted(range(8), key=lambda i: (-scores[i], i)) if i][:5] and [r["score"] for r in got] == pytest.approx([scores[r["vec_id"]] for r in got])


def test_recall_on_the_table(spark):
    where = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{where}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, base = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    got = {}
    for r in queries.op2_nearest_neighbours(spark, where).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = [i for i in ids if i % 20 == 0]
    hits = 0
    for q in asked:
        scores = base @ base[ids == q][0]
        order = np.lexsort((ids, -scores))
        hits += len(got[q] & set(ids[order][ids[order] != q][:20].tolist()))
    assert sorted(got) == sorted(asked) and hits / (20 * len(asked)) >= 0.9


def plain_print(words):
    h = np.array([simhash.xxhash.xxh64_intdigest(w.encode(), 42) for w in words], dtype=">u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(h)).tobytes(), "big", signed=True)


def test_hamming_links(spark, monkeypatch):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for b in list(prints)[:60]:
        for _ in range(3):
            prints.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 5))))
    dense = rng.getrandbits(64)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints | {dense ^ rng.getrandbits(11) for _ in range(300)})
    want = {(a, b) for i, b in enumerate(signed) for a in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for limit in (65_536, 200):
        monkeypatch.setattr(simhash, "BUCKET_PAIRS", limit)
        assert {(r["a"], r["b"]) for r in simhash.links(frame).collect()} == want


def test_hamming_links_broadcast_no_variants(spark, monkeypatch):
    checkpointed, frames = simhash.checkpointed, []
    monkeypatch.setattr(simhash, "checkpointed", lambda df: frames.append(df) or checkpointed(df))
    monkeypatch.setattr(simhash, "BUCKET_PAIRS", 20)
    pairs = simhash.links(spark.range(300).select(F.col("id").alias("fp")))
    assert pairs.count() > 300 and len(frames) == 3
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in [*frames, pairs]]
    assert [p for p in plans if "SortMergeJoin" not in p or "Broadcast" in p] == []


def test_quality(spark, awkward):
    big = "/root/testdata/sf0.1"
    got = queries.op5_quality_classifier(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert ((good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2) > 0.85
    assert (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()
    model = gam.train(awkward, spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id long, quality int"))
    assert gam.score(awkward, model).count() == len(AWKWARD) and gam.score(awkward.limit(0), model).count() == 0


def test_decontamination(spark, docs, awkward, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bench = {r["item_id"]: words(r["text"]) for r in items.collect()}
    rng, planted = random.Random(3), []
    for i, (item, w) in enumerate(bench.items()):
        v = list(w)
        for k in range(3, len(v), 11):
            v[k] = "changed"
        planted.append((10_000 + i, "some words before " + ", ".join(v) + " and after"))
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string")).unionByName(awkward.select((F.col("doc_id") + 50_000).alias("doc_id"), "text"))
    want = set()
    for r in frame.collect():
        w = words(r["text"])
        at = {}
        for k, x in enumerate(w):
            at.setdefault(x, []).append(k)
        for item, v in bench.items():
            need, seen = min(13, len(v)), set()
            for j, x in enumerate(v):
                seen |= {k - j for k in at.get(x, ())}
            for d in seen:
                same = [0 <= d + j < len(w) and w[d + j] == x for j, x in enumerate(v)]
                if any(sum(same[s : s + need]) >= -(-need * 8 // 10) for s in range(len(v) - need + 1)):
                    want.add((r["doc_id"], item))
    for limit in (400_000, 0):
        got = {(r["doc_id"], r["item_id"]) for r in spaced_seeds.find_overlaps(frame, items, most=limit).collect()}
        assert got == want and {d for d, _ in got} >= {d for d, _ in planted}
    left = spaced_seeds.drop_contaminated(frame, items)
    word = spark.createDataFrame([(1, "the"), (2, "w1 w2 w3 w4")], "item_id long, text string")
    some = spark.createDataFrame([(1, "all the others"), (2, "x w1 w2 w3 w4 y")], "doc_id long, text string")
    assert spaced_seeds.drop_contaminated(some, word).count() == 2 and spaced_seeds.drop_contaminated(some, word, shortest_item=2).count() == 1
    assert {tuple(r)[:2] for r in spaced_seeds.find_overlaps(some, word).collect()} == {(1, 1), (2, 2)}
    assert {r["doc_id"] for r in left.select("doc_id").distinct().collect()} == {r["doc_id"] for r in frame.select("doc_id").distinct().collect()} - {d for d, _ in want}
    short = spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, "")], "item_id long, text string")
    hit = spark.createDataFrame([(5, "we say alpha BETA, gamma here"), (6, "alpha beta")], "doc_id long, text string")
    assert [tuple(r)[:2] for r in spaced_seeds.find_overlaps(hit, short).collect()] == [(5, 1)]
    assert spaced_seeds.find_overlaps(hit.limit(0), short).count() == 0 and spaced_seeds.find_overlaps(hit, short.limit(0)).count() == 0


def test_decontamination_finds_every_substitution(spark):
    from itertools import combinations

    items, rows, want = [], [], set()
    for n in range(5, 21):
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        need = min(13, n)
        for wrong in (1, 2, 3):
            for places in combinations(range(n), wrong):
                rows.append((len(rows), " ".join(["before", *("x" if k in places else w for k, w in enumerate(words)), "after"])))
                if any(sum(k not in places for k in range(s, s + need)) >= -(-need * 8 // 10) for s in range(n - need + 1)):
                    want.add((rows[-1][0], n))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = spaced_seeds.find_overlaps(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_packing(spark, docs, awkward):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(90_000, "a<|endoftext|>b"), (None, "no id"), (2**53 + 1, "beside a null")], "doc_id long, text string").coalesce(1)
    frame = docs.select("doc_id", "text").unionByName(awkward.select((F.col("doc_id") + 70_000).alias("doc_id"), "text")).unionByName(extra)
    rows = packing.pack(frame, path).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    used = 0
    for own in by_sequence.values():
        end = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 2048
        used += end if end & (end - 1) == 0 else 2048
    assert sum(r["length"] for r in rows) >= 0.95 * used
    assert len(by_doc[None]) >= 2 and by_doc[2**53 + 1]
    for d in frame.where("doc_id <> 70004").collect():
        ids = np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        start = 0
        for r in sorted(by_doc[d["doc_id"]], key=lambda r: r["start"]):
            assert r["start"] == start and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[start : start + r["length"]].tobytes())
            start += r["length"]
        assert start == len(ids)
    assert packing.pack(frame.limit(0), path).count() == 0
    named = packing.pack(frame.where("doc_id < 3").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"), path)
    assert {r["doc_id"] for r in named.collect()} == {"d0", "d1", "d2"}
    with pytest.raises(ValueError):
        packing.ByteLevelTokenizer(queries.tokenizer_path("word_bpe_49k.json"))


def test_places_cover_each_piece_once():
    rng = random.Random(3)
    for total in (1, 7, 300, 5000):
        histogram = {}
        for _ in range(total):
            x = rng.choice((2048, 1024, rng.randint(1, 2048), rng.randint(1, 300)))
            histogram[x] = histogram.get(x, 0) + 1
        table = packing.places(histogram, 2048, 32)
        sequences, cut, whole = {}, 0, 0
        for x, n in histogram.items():
            own = table[table["length"] == x]
            for rank in range(n):
                mine = own[(own["from_rank"] <= rank) & (own["to_rank"] > rank)].sort_values("cut_start")
                assert mine["cut_start"].tolist() == [0, *mine["cut_length"].cumsum().tolist()[:-1]] and mine["cut_length"].sum() == x
                cut, whole = cut + (len(mine) > 1), whole + (len(mine) == 1)
                for r in mine.itertuples():
                    k = rank - r.shift
                    sequences.setdefault(r.first_sequence + k // r.per_window, []).append((r.first_offset + k % r.per_window * r.cut_length, r.cut_length))
        for pieces in sequences.values():
            pieces.sort()
            assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:i]) for i in range(len(pieces))] and sum(p[1] for p in pieces) <= 2048


def test_simhash(spark, docs, awkward):
    frame = docs.select("doc_id", "text").unionByName(awkward.select((F.col("doc_id") + 70_000).alias("doc_id"), "text"))
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        return plain_print(grams) & ((1 << 64) - 1) if grams else 0

    prints = [plain(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(frame).collect()), key=str) == want
    kept = simhash.drop_near_duplicates(frame.withColumn("fp", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "fp"] and kept.count() == len({find(i) for i in range(len(rows))})
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_near_dedup_by_five_words(spark):
    import corpus_pipeline

    rng, texts = random.Random(8), [None, "", " ", "One two", "one\ttwo", "one two three"]
    passage = [f"p{i}" for i in range(14)]
    for n in (30, 100, 300, 1000):
        for _ in range(6):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            base[5:19] = passage
            for edits in (0, 1, max(1, n // 100), max(1, n // 60), n // 40 + 1, n // 20):
                w = list(base)
                for _ in range(edits):
                    w[rng.randrange(n)] = f"w{rng.randrange(5000)}"
                texts.append(" ".join(w))

    def plain(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [plain(t) for t in texts]

    def kept():
        parent = list(range(len(texts)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if (a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9):
                    parent[max(find(i), find(j))] = min(find(i), find(j))
        return {find(i) for i in range(len(texts))}

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()}
    every = kept()
    assert every <= got
    recall = (len(texts) - len(got)) / (len(texts) - len(every))
    assert recall > 0.97, recall


def test_language_id(spark, awkward):
    big = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang")
    got = queries.op9_language_id(spark, big).join(truth, "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all() and got.rejected.mean() < 0.01
    model = langid.train(spark.read.parquet(f"{big}/documents.parquet"))
    judged = {r["doc_id"]: r for r in langid.identify(awkward, model).collect()}
    assert all(judged[i]["lang_pred"] == "und" and judged[i]["rejected"] for i in (1, 2, 5)) and judged[6]["rejected"]
    empty = langid.train(awkward.where("doc_id < 0"))
    assert {r["lang_pred"] for r in langid.identify(awkward, empty).collect()} == {"und"}


def test_models_sum_to_one():
    text = "the cat sat on the mat and the hat"
    codes, n = np.unique(langid.grams(langid.letters(text)), return_counts=True)
    model = langid.KneserNey(["x"], {"x": (codes, n)})
    chars = sorted(set(langid.letters(text).tolist()))
    context = (ord("t") << 48) | (ord("h") << 32) | (ord("e") << 16)
    total = np.exp(model.log_probs(np.array([context | c for c in chars], dtype=np.uint64))).sum() + np.exp(model.log_probs(np.array([context | 0x4E00], dtype=np.uint64))).sum()
    assert abs(total - 1) < 0.02


def test_token_counts(spark, docs, awkward):
    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [(1, "a<|endoftext|>b <|startoftext|"), (2, "Don't it's I'LL ΣΑΣ İ éa"), (3, None), (4, "日本語 12½ 🙂🏽 !!'s")]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string")).unionByName(awkward.select("doc_id", "text"))
    for r in prefix_tokens.count_tokens(frame, path).collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 2048)
        head = (r["text"] or "")[: r["cut_chars"]]
        assert len(library.encode(head, add_special_tokens=False).ids) <= 2048
    whole = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    odd = [*(t for _, t in texts if t), "e\u0301 abc e\u0301e\u0301xyz 'll done", "日本語日本語日本語", "internationalization of everything", "a b  c <|endoftext|> d", "x" * 40]
    for limit in (0, 1, 2, 3, 5, 8):
        cuts = prefix_tokens.count_tokens(spark.createDataFrame([(t,) for t in odd], "text string"), path, limit=limit).collect()
        for r in cuts:
            t = r["text"]
            best = max(i for i in range(len(t) + 1) if whole(t[:i]) <= limit)
            # white space after the longest prefix has no tokens of its own
            assert t[: r["cut_chars"]].rstrip() == t[:best].rstrip() and r["n_tokens"] == whole(t), (limit, t, r["cut_chars"], best)
    for r in prefix_tokens.prefix_tables(spark.createDataFrame(texts, "doc_id long, text string"), path).collect():
        t = r["text"] or ""
        assert list(r["prefix_tokens"]) == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
    assert str(public_tokenizers.path("word_bpe_49k.json")) == path


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline

    current = docs
    for name, stage in corpus_pipeline.STAGES:
        current = common.checkpointed(stage(spark, current, sf_dir))
        if name != "packing":
            assert current.columns == docs.columns and current.dtypes == docs.dtypes
    assert current.count() > 0 and current.count() == corpus_pipeline.run(spark, sf_dir).count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
