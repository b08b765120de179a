"""The pipeline's stages one after the other, over awkward rows beside ordinary ones."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from strandframe.llm import simhash
from strandframe.llm.common import checkpointed


def test_stages_on_awkward_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    some = docs.where("lang = 'en'").orderBy("doc_id").limit(3).collect()
    odd = [(90001, None, "en", "s", 0), (90002, "", "en", "s", 0), (90003, "123 ... \n\n", "en", None, None), (None, some[0]["text"], "en", None, None), (90004, long, None, "s", 1)]
    odd += [tuple(some[1])] * 3 + [(90005, some[2]["text"], None, None, None), (90006, some[2]["text"].upper(), "en", "s", 5)]
    frame = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    kept = [frame]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(checkpointed(stage(spark, kept[-1], sf_dir)))
        if name != "packing":
            assert kept[-1].columns == docs.columns, name
    first, lines, near, clean, packed = kept[1:]
    ids = {r["doc_id"] for r in first.collect()}
    assert not ids & {90001, 90002, 90003} and {r["doc_id"] for r in some} <= ids and first.where("doc_id is null").count() == 1
    assert lines.count() == first.count() and lines.where("text is null").isEmpty()
    # what lines left of repeated rows is one document; the ids that stay are the smallest
    assert near.where(near.doc_id == some[1]["doc_id"]).count() <= 1 and near.count() <= lines.count() - 2
    assert near.join(lines, ["doc_id"], "left_anti").where("doc_id is not null").isEmpty()
    assert clean.count() <= near.count() and clean.join(near, ["doc_id"], "left_anti").where("doc_id is not null").isEmpty()
    pieces = packed.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert packed.select("doc_id").distinct().count() == clean.select("doc_id").distinct().count() and all(r[1] <= 2048 for r in pieces)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_similar_texts_that_share_a_crowded_hash_alone(spark):
    # one smallest hash in common, which more texts have than a bucket holds
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    base = rng.sample(words, 200)
    texts = [base, [*base[:-1], "other"], *[rng.sample(words, 200) for _ in range(2 * simhash.BUCKET_TEXTS)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sketch = F.array(F.lit(1).cast("long"), *[F.xxhash64("doc_id", F.lit(k)) for k in range(7)])
    prints = docs.select(F.xxhash64("text").alias("th"), F.lit(0).cast("long").alias("fp"), sketch.alias("sketch"))
    groups = simhash.similar_groups(docs, prints, 5, 0.8).groupBy("component").count().collect()
    assert [r["count"] for r in groups] == [2]
