"""The operators' queries with production parameters, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, gam, hnsw, langid, lines, merkle, negatives, packing, prefix_tokens, secret_scan, simhash, spaced_seeds, url_trie
from .common import crc_remainder, table


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary lies; the same on every worker."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


# The rules of the url query, as (verdict, host, path).
URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with host, path, the longest rule that fits and its verdict. Null or odd urls have empty host and path and are allowed; repeated rows stay."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_trie.filter_urls(pages, [url_trie.UrlRule(*r) for r in URL_RULES]).select("page_id", "host", "path", "rule", "verdict")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of each vector whose id is divisible by 20. Unusable vectors (null, zero, not finite) take no part; ties go to the smaller id."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hnsw.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with n_lines and n_dropped, its text without lines that occur before, equally or nearly. Null and empty texts stay; ids tie by text hash and position."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, counts=True)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base counts, their digest and all spans. A null text is empty; repeated rows are scanned one by one."""
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score, from a model that learns outside the held-out fold. Empty and null texts are scored too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = gam.train(docs, table(spark, sf_dir, "labels"), learn=gam.learning_rows())
    scored = gam.score(docs, model)
    return scored.select("doc_id", F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that share text, over all documents. Null texts share none; repeated rows of an id count together."""
    return spaced_seeds.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of at most 2048 tokens. Null and empty texts are a piece of the end id; null ids stay null."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest doc_id of its group. Null and empty texts share fingerprint zero; a null id is never the smallest."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language, by models that learn outside the held-out fold. Null texts and texts without a letter are `und`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, learn=langid.learning_rows())
    judged = langid.identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its bytes, tokens and whether it passes 2048 tokens. A null text has none; repeated rows are counted one by one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return prefix_tokens.count_tokens(docs, tokenizer_path("word_bpe_49k.json")).drop("text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and what root its tampered leaf leads to. Null ids are first in their source and are not tampered with; repeated rows are leaves of their own."""
    return merkle.tamper_report(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of each positive of each row whose vec_id is divisible by 100. Rows without a label or a usable vector take no part; ties go to the smaller id."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of identical texts, of which the largest doc_id stays. Null counts as empty; a null id stays only if no other does, and one of repeated rows."""
    return exact.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_nearest_neighbours, op3_line_dedup, op4_secret_scan, op5_quality_classifier, op6_decontamination, op7_packing, op8_simhash_dedup, op9_language_id, op10_token_counts, op11_merkle_manifest, op12_hard_negatives, op13_exact_dedup)}


OP1_SQL = r"""
with parsed as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') path
  from (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages)),
rules(verdict, r_host, r_path) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
urls as (select distinct host, path from parsed),
best as (
  select host, path, r_host || r_path rule, verdict
  from urls, rules where (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
  qualify row_number() over (partition by host, path order by length(r_host) desc, length(r_path) desc) = 1)
select page_id, p.host host, p.path path, rule, coalesce(verdict, 'allow') verdict
from parsed p left join best b on p.host = b.host and p.path = b.path
"""


OP12_SQL = r"""
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v
  from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id anchor_id, b.vec_id other_id, a.l = b.l same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint score
  from usable a, usable b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, other_id positive_id, score positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id)::int "rank",
       s.other_id negative_id, p.positive_score, s.score negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
  and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) <= 5
"""

OP13_SQL = """
with hashed as (select doc_id, coalesce(text, '') body from documents),
sized as (select *, max(doc_id) over (partition by body) keep_id, count(*) over (partition by body) group_size from hashed)
select doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(body) text_sha256 from sized
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op12_hard_negatives": OP12_SQL, "op13_exact_dedup": OP13_SQL}
