"""Queries about input order, panel tables, digests, reports and citations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations, grid, order, qc
from ..sources import derived, panels, provenance
from . import registry
from .registry import query
from .twins import ANCHOR_HITS, RA, RC, SQL, rate


@query
def input_order_breaks(spark, sf_dir):
    rows = order.parquet_rows(spark, f"{sf_dir}/orders.parquet")
    return order.order_breaks(rows, "o_custkey").select("line", "value", "previous", "kind")


@query
def panel_scores_long(spark, sf_dir):
    return panels.scores(derived.score_table(spark, sf_dir), "IID")


@query
def table_digest(spark, sf_dir):
    return provenance.table_digest(derived.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


@query
def qc_report(spark, sf_dir):
    return qc.qc_report(registry._table(spark, sf_dir), derived.anchors(spark, sf_dir)).withColumn("warnings", F.array_join("warnings", ","))


@query
def card_grid_other_sections(spark, sf_dir):
    return grid.grid_groups(registry._assembled(spark, sf_dir), grid.GridQuery("section"), registry.SECTIONS[:5])


@query
def citation_problems(spark, sf_dir):
    return citations.normal_citations(derived.citations(spark, sf_dir)).select("citation_id", "n_id", "problem")


@query
def citation_links(spark, sf_dir):
    rows = derived.citations(spark, sf_dir)
    return rows.select("citation_id", citations.citation_page(F.col("type"), F.col("id"), F.col("database")).alias("page"))


CITED = """with raw as (select p citation_id, case when p % 29 = 0 then null else ['doi',' PMID','pmcid','accession','url','book'][1 + p % 6] end "type",
   case p % 6 when 0 then case when p % 4 = 0 then 'https://DOI.org/' when p % 4 = 2 then 'doi:' else '' end || '10.' || (1000 + p % 9000) || '/x.' || p || case when p % 8 = 0 then ' y' else '' end
     when 1 then cast(p - p % 7 as varchar) when 2 then case when p % 5 = 0 then 'PMC' else 'pmc' end || p when 3 then 'rs' || p when 4 then case when p % 8 = 4 then 'javascript:' else 'https://' end || 'a.org/' || p else 'b' end id,
   case when p % 31 = 0 then '  ' else 'Title ' || p end title,
   case when p % 6 = 3 and p % 5 > 0 then ['dbSNP','PGS-Catalog','Clin Var','nowhere'][1 + p % 4] when p % 37 = 0 then 'dbSNP' end database from (select p_partkey p from part)),
named as (select *, lower(trim("type")) k from raw)"""


def _formed(identifier: str) -> str:
    return "case k " + " ".join(f"when '{k}' then regexp_matches({identifier}, $r${form}$r$)" for k, form in citations.FORMS.items()) + " else false end"


SQL.update(
    {
        "input_order_breaks": """select * from (select line, o_custkey "value", p previous, case when o_custkey = p then 'repeated' when o_custkey < p then 'descending' end kind
   from (select *, lag(o_custkey) over (order by line) p from (select o_custkey, row_number() over () line from orders))) where kind is not null""",
        "panel_scores_long": "select 'S' || s_suppkey sample_id, c component, case c when 1 then s_nationkey / 2.0::double when 2 then -s_suppkey / 4.0::double else s_suppkey / 8.0::double end score from supplier, range(1, 4) r(c)",
        "table_digest": """with h as (select sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') h from orders)
   select count(*) n_rows, sha256('o_custkey:bigint,o_orderkey:bigint,o_orderstatus:string|' || count(*) || '|' || sum(('0x' || h[1:16])::ubigint) || '|' || sum(('0x' || h[17:32])::ubigint) || '|' || sum(('0x' || h[33:48])::ubigint) || '|' || sum(('0x' || h[49:64])::ubigint)) digest from h""",
        "card_grid_other_sections": f"""{RA}, d as (select i rank, 'section ' || i label from range(5) r(i)), o as (select 4 + row_number() over (order by section) rank, section label from (select distinct section from assembled where section not in (select label from d)))
   select rank, label, count(section) total, count(*) filter (interpreted) interpreted, count(section) shown from (select * from d union all select * from o) left join assembled on section = label group by 1, 2""",
        "citation_problems": f"""{CITED}, ids as (select *, case k when 'doi' then regexp_replace(trim(id), '(?i)^(https?://doi\\.org/|doi:)', '') when 'pmcid' then upper(trim(id)) else trim(id) end n_id from named)
   select citation_id, n_id, case when coalesce(trim("type"), '') = '' or coalesce(trim(id), '') = '' or coalesce(trim(title), '') = '' then 'missing_field' when k not in ('doi','pmid','pmcid','accession','url') then 'unknown_type'
     when not {_formed('n_id')} then 'malformed_id' when k = 'accession' and database is null then 'missing_database' when k <> 'accession' and database is not null then 'unexpected_database' end problem from ids""",
        "citation_links": f"""{CITED} select citation_id, case when {_formed('trim(id)')} then case k when 'doi' then 'https://doi.org/' || trim(id) when 'pmid' then 'https://pubmed.ncbi.nlm.nih.gov/' || trim(id) || '/' when 'pmcid' then 'https://www.ncbi.nlm.nih.gov/pmc/articles/' || trim(id) || '/'
     when 'url' then trim(id) when 'accession' then case regexp_replace(lower(coalesce(database, '')), '[^a-z0-9]+', '', 'g') when 'dbsnp' then 'https://www.ncbi.nlm.nih.gov/snp/' || trim(id) when 'clinvar' then 'https://www.ncbi.nlm.nih.gov/clinvar/variation/' || trim(id) || '/'
       when 'pgscatalog' then 'https://www.pgscatalog.org/score/' || trim(id) || '/' end end end page from named""",
        "qc_report": f"""{RC}, {ANCHOR_HITS}, w as (select string_agg(warning, ',' order by precedence) warnings from (WARNED))
   select n_rows, n_called, {rate('n_called', 'n_rows')} call_rate, {rate('autosomal_het', 'autosomal_loci')} autosomal_rate, x_rate, y_rate, sex, n_indels, (select count(*) - count(distinct rsid) from t) extra_rsid_rows,
   (select count(*) from t) - (select count(*) from (select distinct chrom, pos_grch37 from t)) extra_locus_rows, n_found, verdict, coalesce(warnings, '') warnings from sexed, verdicts, w""".replace("WARNED", SQL["qc_warnings"]),
    }
)
