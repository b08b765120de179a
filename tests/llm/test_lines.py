"""Line dedup against a plain version, on dense groups and on very long lines."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandframe.llm import common, lines

M = (1 << 64) - 1


def plain_print(words):
    h = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in set(words)], dtype=">u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(h)).tobytes(), "big")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def linked(a, b, keys=None):
    """The edit rule of two word lists and, with the keys of each, that they share one and their fingerprints are near."""
    k = int(max(len(a), len(b)) * 0.2 + 1e-9)
    if abs(len(a) - len(b)) > k:
        return False
    if keys is not None and (not keys[tuple(a)] & keys[tuple(b)] or (plain_print(a) ^ plain_print(b)).bit_count() > lines.APART):
        return False
    return distance(a, b) <= k


def keys_of(spark, word_lists):
    """The keys that each line has where no block is crowded."""
    frame = spark.createDataFrame([(list(w),) for w in word_lists], "words array<string>").withColumn("n", F.size("words"))
    codes = frame.withColumn("c", F.transform("words", lambda w: F.hash(w)))
    picked = codes.select("words", lines.blocks(F.col("c"), F.col("n"), 0.8).alias("keys"))
    return {tuple(r["words"]): set(r["keys"]) for r in picked.collect()}


def plain_keep(spark, texts):
    """{doc: text without repeated lines}; texts maps ids, in order, to texts."""
    spots = [(i, k, tuple(re.findall(r"[^\W_]+", x.lower()))) for i, t in texts.items() for k, x in enumerate(t.split("\n"))]
    spots = [s for s in spots if s[2]]
    distinct = sorted({s[2] for s in spots})
    parent, keys = {x: x for x in distinct}, keys_of(spark, distinct)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if find(a) != find(b) and linked(a, b, keys):
                parent[find(a)] = find(b)
    first = {}
    for i, k, x in sorted(spots, key=lambda s: s[:2]):
        first.setdefault(find(x), (i, k))
    doomed = {(i, k) for i, k, _ in spots} - set(first.values())
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in doomed) for i, t in texts.items()}


def changed(rng, base, vocabulary, edits):
    w = list(base)
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k : k + rng.randint(0, 1)] = rng.choice(([], [rng.choice(vocabulary)], [rng.choice(vocabulary)]))
    return w or list(base)


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(12)
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(600)]


@pytest.mark.parametrize("bucket_lines", [32, 2])
def test_line_dedup(spark, vocabulary, monkeypatch, bucket_lines):
    monkeypatch.setattr(lines, "BUCKET_LINES", bucket_lines)
    rng = random.Random(2)
    bases = [[rng.choice(vocabulary) for _ in range(n)] for n in (4, 5, 6, 8, 10, 11, 12, 13, 16, 20, 30, 60) for _ in range(2)]
    texts = {}
    for i in range(90):
        own = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(bases)
            own.append(" ".join(changed(rng, w, vocabulary, rng.choice((0, 1, 1, len(w) // 8)))).capitalize() + rng.choice([".", "", "!"]))
        own += rng.choice([[""], ["***"], ["short " + rng.choice(vocabulary)]])
        texts[i] = "\n".join(own)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = plain_keep(spark, texts)
    assert sum(map(len, want.values())) < sum(len(t) for t in texts.values())
    for limit in (0, common.MOST_BROADCAST):
        assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame, most=limit).collect()} == want


def test_large_buckets_are_cut_without_loss(spark, vocabulary):
    rng = random.Random(6)
    rows = []
    for n in (4, 5, 7, 8, 9, 11, 12, 13, 14, 15, 16, 20, 23, 31):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(n)]
            rows += [tuple(base)] + [tuple(changed(rng, base, vocabulary, rng.randint(1, n // 5 + 1))) for _ in range(5)]
    rows = sorted({r for r in rows if len(r) >= 4})
    frame = spark.createDataFrame([(1, i, len(w), 0, i, -1, list(w)) for i, w in enumerate(rows)], "key long, h1 long, n int, fp long, root long, main long, words array<string>")
    texts = frame.select("h1", lines.code_text(F.transform("words", lambda w: F.hash(w)), 0).alias("one"))
    met = {(r["a"], r["b"]) for r in common._bucket_pairs(*lines._runs(frame.drop("words"), texts), lines._alike(0.8)).collect()}
    want = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and linked(a, b)}
    assert len(want) > 300 and want <= met and len(met) < len(rows) ** 2 / 4


@pytest.mark.parametrize("share", [0.1, 0.2])
def test_recall_of_the_edit_rule(spark, vocabulary, share):
    # pairs apart from each other, so that each stands for itself: as many words changed as the rule allows
    rng = random.Random(5)
    rows = []
    for n in (5, 7, 10, 15, 20, 25, 40, 60):
        for i in range(150):
            base = [f"{rng.choice(vocabulary)}x{n}y{i}" for _ in range(n)]
            near = list(base)
            for k in rng.sample(range(n), max(1, int(n * share))):
                near[k] = f"new{k}"
            rows += [(len(rows), n, " ".join(base)), (len(rows) + 1, n, " ".join(near))]
    kept = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, words int, text string")).where("text <> ''").groupBy("words").count().collect()
    found = {n: (300 - k) / 150 for n, k in kept}
    print(found)
    assert min(found.values()) >= 0.9, found


def test_crowded_blocks(spark, vocabulary, monkeypatch):
    # one run of words in all lines: similar lines still meet, by others, and few pairs are made
    rng = random.Random(3)
    monkeypatch.setattr(lines, "CROWD", 20)
    bases = [[f"{rng.choice(vocabulary)}{i}" for _ in range(16)] + ["see", "also", "the", "page"] + [f"{rng.choice(vocabulary)}{i}" for _ in range(16)] for i in range(300)]
    rows = [(2 * i + k, " ".join(w[:2] + ["other"] * k + w[2 + k :])) for i, w in enumerate(bases) for k in (0, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in lines.dedup_lines(frame).where("text <> ''").orderBy("doc_id").collect()] == [2 * i for i in range(300)]
    table = lines.line_rows(frame, "doc_id", "text").select(F.xxhash64("words").alias("h1"), F.size("words").alias("n"), F.transform("words", lambda w: F.hash(w)).alias("c"))
    members = common.shared_keys(table, lines.blocks(F.col("c"), F.col("n"), 0.8), lines.CROWD, 0.8)
    assert members.groupBy("key").count().where("count > 20").count() == 0


def test_similar_lines_that_share_a_crowded_block_alone(spark, vocabulary):
    # nothing else brings these two together, and more lines than CROWD have the block too
    rng = random.Random(4)
    run = ["see", "also", "the", "page"]
    fresh = lambda k: [f"{rng.choice(vocabulary)}{rng.randrange(10**6)}" for _ in range(k)]
    pairs = []
    for _ in range(600):
        a = [*fresh(10), *run, *fresh(10)]
        b = list(a)
        for k in rng.sample([*range(10), *range(14, 24)], 4):
            b[k] = f"new{rng.randrange(10**6)}"
        pairs.append((a, b))
    others = [[*fresh(10), *run, *fresh(10)] for _ in range(600)]
    keys = {k: v for k, v in keys_of(spark, [x for p in pairs for x in p] + others).items()}
    counts = {}
    for w in others:
        for k in keys[tuple(w)]:
            counts[k] = counts.get(k, 0) + 1
    common_key = max(counts, key=counts.get)
    crowd = [w for w in others if common_key in keys[tuple(w)]][: 2 * lines.CROWD]
    a, b = next((a, b) for a, b in pairs if keys[tuple(a)] & keys[tuple(b)] == {common_key} and linked(a, b, keys))
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([a, b, *crowd])], "doc_id long, text string")
    assert len(crowd) > lines.CROWD
    assert [r["doc_id"] for r in lines.dedup_lines(frame).where("text = ''").collect()] == [1]


def test_unlike_lines_of_a_crowded_block_make_few_pairs(spark, vocabulary, monkeypatch):
    # ten of forty words are each line's own, in the same places: one bucket, near fingerprints, no similar pair but the last
    base, seen, verified = vocabulary[:40], [], lines._verified
    rows = [[f"own{i}x{k}" if 15 <= k < 25 else w for k, w in enumerate(base)] for i in range(60)]
    rows.append([*rows[-1][:39], "end"])

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(lines, "_verified", counted)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    assert [r["doc_id"] for r in lines.dedup_lines(frame).where("text = ''").collect()] == [60]
    print(seen)
    assert sum(seen) < 600, seen


def test_word_bits_keep_all_similar_lines(spark, vocabulary):
    rng = random.Random(9)
    bases = [[rng.choice(vocabulary) for _ in range(n)] for n in (4, 9, 20, 60, 300) for _ in range(6)]
    rows = sorted({tuple(changed(rng, w, vocabulary, rng.randint(0, len(w) // 4))) for w in bases for _ in range(8)})
    frame = spark.createDataFrame([(1, i, len(w), 0, i, list(w)) for i, w in enumerate(rows)], "key long, h1 long, n int, fp long, root long, words array<string>")
    marks = lines.word_bits(frame.select("h1", F.transform("words", lambda w: F.hash(w)).alias("c")))
    marked, extra = frame.drop("words").join(marks, "h1"), [f"b{i}" for i in range(lines.MARKS)]
    met = {(r["a"], r["b"]) for r in common._bucket_pairs(marked, marked, lines._fits(0.8), extra).collect()}
    want = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and linked(a, b)}
    assert len(want) > 300 and want <= met and len(met) < len(rows) ** 2 / 4


def test_permutations_and_repeated_rows(spark, vocabulary):
    # one fingerprint, no similar pair among nearly all: no line may go, and no pair of them all may be made
    rng = random.Random(8)
    base = vocabulary[:20]
    rows = [(i, " ".join(rng.sample(base, 20))) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines.dedup_lines(frame).where("text = ''").count() == 0
    sixty = vocabulary[:60]
    near = next(w for w in ([*sixty[:k], f"new{k}", *sixty[k + 1 :]] for k in range(60)) if linked(w, sixty, keys_of(spark, [w, sixty])))
    for doc_id in (1, None):
        frame = spark.createDataFrame([(doc_id, " ".join(sixty))] * 3 + [(7, " ".join(near))], "doc_id long, text string")
        left = [r["doc_id"] for r in lines.dedup_lines(frame).where("text <> ''").collect()]
        assert left == ([1] * 3 if doc_id else [7])


def test_very_long_lines(spark):
    many = [f"w{i}" for i in range(40_000)]
    frame = spark.createDataFrame([(1, "same " * 600_000), (2, " ".join(many)), (3, " ".join([*many[:500], "x", *many[500:]])), (4, "Same " * 600_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(frame, counts=True).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}
    prints = lines.simhashed(lines.line_rows(frame.where("doc_id in (1, 2)"), "doc_id", "text"), ["doc_id"], "words").groupBy("doc_id").agg({"fp": "bit_or"}).collect()
    assert {i: x & M for i, x in prints} == {1: plain_print(["same"]), 2: plain_print(many)}


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "one two"), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, " \n\t\n "), (6, "x" * 50_000), (7, "é ß 日本 🙂 " * 20), (8, "word " * 40_000)]
    frame = spark.createDataFrame([(i, t, "en", "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, score string, pos int, n int, fp int")
    for limit in (0, common.MOST_BROADCAST):
        odd = lines.dedup_lines(frame, n_chars="n", counts=True, most=limit).collect()
        assert len(odd) == len(rows) and {r["doc_id"]: r["text"] for r in odd}[1] is None
    assert lines.dedup_lines(frame.limit(0)).count() == 0


def test_stored_tables_leave_no_shuffle_files(spark):
    files = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before, setting = files(), spark.conf.get(common.CLEANUP, "false")
    table = common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert files() <= before and spark.conf.get(common.CLEANUP, "false") == setting
    assert table.count() == 7
