"""Queries about knowledge packs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching, packs, references
from ..sources import derived
from . import registry
from .registry import query
from .twins import CARDS, RM, SCORED, SQL, comp


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pack's variants as a reference has them, some missing, moved, renamed or of other alleles."""
    return derived.cards(spark, sf_dir).where("card_id % 7 <> 0").selectExpr(
        "case when card_id % 5 = 1 then 'rs1' else rsid end rsid", "chrom", "pos_grch37 + case when card_id % 4 = 1 then 20000 else 0 end pos_grch37", "low_allele ref", "case when card_id % 3 = 1 then low_allele else high_allele end alt"
    )


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = derived.pack(spark, sf_dir)
    matched = matching.match_cards(pack, registry._probes(spark, sf_dir), observed=True)
    scored = registry._scored(spark, sf_dir).select("card_id", "score", "final_tier", F.when(F.col("quality").isNull(), "direct").otherwise("imputed").alias("call_source"))
    return packs.shown_texts(packs.strand_frequency(packs.paired(pack, matched, scored)))


@query
def card_texts(spark, sf_dir):
    return _texts(spark, sf_dir).select("card_id", "status", F.col("shown_summary").alias("summary"), F.col("shown_detail").alias("detail"), F.array_join("caveats", " ").alias("caveats"))


@query
def strand_frequency(spark, sf_dir):
    rows = _texts(spark, sf_dir).where("status = 'matched'")
    return rows.select("card_id", "strand", F.col("rarest.allele").alias("allele"), F.round("rarest.frequency", 6).alias("frequency"), F.array_join("unpriced", ",").alias("unpriced"))


@query
def rendered_outcomes(spark, sf_dir):
    return packs.rendered_outcomes(derived.pack(spark, sf_dir))


@query
def pack_lint(spark, sf_dir):
    states = references.cross_check(derived.cards(spark, sf_dir), _reference(spark, sf_dir))
    return packs.lint(derived.pack(spark, sf_dir), states)


@query
def card_payload(spark, sf_dir):
    back = packs.read_payload(packs.payload(_texts(spark, sf_dir)))
    return back.select(
        F.col("card_id").cast("long").alias("card_id"), "section", "kind", "title", "gene", "status", "summary", "detail", F.col("variant.rsid").alias("rsid"), F.col("variant.chrom").alias("chrom"),
        F.col("variant.pos_grch37").alias("pos_grch37"), F.array_join("variant.alleles", ",").alias("alleles"), F.col("match.genotype").alias("genotype"), F.col("match.observed_genotype").alias("observed_genotype"),
        F.col("match.outcome_name").alias("outcome_name"), F.col("confidence.score").alias("score"), F.col("confidence.tier").alias("tier"), F.col("observation.call_source").alias("call_source"),
        F.col("observation.imputation_quality").alias("imputation_quality"), F.col("confidence_frequency.allele").alias("rarest_allele"), F.size("frequencies").alias("n_frequencies"), F.size("citations").alias("n_citations"), F.size("computed_caveats").alias("n_caveats"),
    )


@query
def assembly_pairing_problems(spark, sf_dir):
    cards = derived.cards(spark, sf_dir)
    matches = cards.where("card_id % 31 <> 0").select("card_id").unionByName(cards.where("card_id % 37 = 0").select((F.col("card_id") + F.when(F.col("card_id") % 2 == 0, 10**9).otherwise(0)).alias("card_id")))
    seen = cards.where("card_id % 41 <> 0 and (kind = 'interpretation' or card_id % 3 = 0)").select("card_id").unionByName(cards.where("card_id % 43 = 0").select((F.col("card_id") + 2 * 10**9).alias("card_id")))
    return packs.pairing_problems(cards, matches, seen)


_GOOD = "['You have {genotype} at {rsid}.', '{gene}: {effect_value}{effect_units} of {sample_size}', '{{kept}} at {chrom}:{pos}', 'Now {rsid_current}, {confidence}']"
_BAD = "['Open {genotype', 'Alone } here', 'Wide {pos:>10}', 'Which {}', 'Who {nobody}', '  ']"


def _template(k: int) -> str:
    return f"case when (card_id + {k}) % 10 = 0 then {_BAD}[1 + (card_id // 10 + {k}) % 6] else {_GOOD}[1 + (card_id + {k}) % 4] end"


def _filled(template: str, values: dict[str, str]) -> str:
    """A template's text: null if some token is a lone brace or a placeholder without a value."""
    names = " ".join(f"when x = '{{{n}}}' then {v}" for n, v in values.items())
    tokens = f"list_transform(regexp_extract_all({template}, '\\{{\\{{|\\}}\\}}|\\{{[^{{}}]*\\}}|[^{{}}]+|[{{}}]'), lambda x: case when x = '{{{{' then '{{' when x = '}}}}' then '}}' {names} when x in ('{{', '}}') or (starts_with(x, '{{') and ends_with(x, '}}')) then null else x end)"
    return f"(case when {template} is null or len(list_filter({tokens}, lambda y: y is null)) > 0 then null else array_to_string({tokens}, '') end)"


PACK = f""",
genes as (select *, case when card_id % 6 <> 0 then 'GENE' || (card_id % 50) end gene, case when card_id % 4 = 0 then '%' end effect_units, card_id * 37 % 5000 sample_size,
   case when card_id % 14 = 0 then 0 else 1 end n_citations, case when kind = 'impossibility' and card_id % 2 = 0 then 'Nothing about {{gene}} can be told.' when kind = 'impossibility' then '{{genotype}} of {{gene}}' end summary_t,
   case when kind = 'impossibility' and card_id % 3 > 0 then 'Arrays do not see {{{{this}}}}.' end detail_t from cards),
outcomes as (select card_id, o outcome, part, case o when 'lower' then case part when 'summary' then {_template(1)} else {_template(2)} end
   when 'between' then case part when 'summary' then {_template(3)} else {_template(4)} end else case part when 'summary' then {_template(5)} else {_template(6)} end end template
   from cards, (values ('lower'), ('between'), ('higher')) os(o), (values ('summary'), ('detail')) ps(part) where not (card_id % 9 = 0 and o = 'between')),
maps as (select card_id, unnest([low_allele || low_allele, low_allele || high_allele, high_allele || high_allele]) genotype, unnest([low_outcome, mid_outcome, high_outcome]) outcome from cards where kind = 'interpretation')"""
_STAND_INS = {"rsid": "g.rsid", "rsid_current": "g.rsid", "gene": "g.gene", "chrom": "g.chrom", "pos": "cast(g.pos_grch37 as varchar)", "effect_value": "cast(g.effect_value as varchar)", "effect_units": "coalesce(g.effect_units, '')", "sample_size": "cast(g.sample_size as varchar)", "confidence": "'well-established'", "genotype": "m.genotype"}
_VALUES = _STAND_INS | {"rsid": "coalesce(observed_rsid, g.rsid)", "gene": "coalesce(g.gene, '')", "confidence": "final_tier", "genotype": "case strand when 'complemented' then flipped else genotype end"}
_REASON = "case status " + " ".join(f"when '{k}' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in packs.REASONS.items()) + " end"
FOUND = f""",
scores as (select card_id, score, names[final_rank + 1] final_tier from scored),
found as (select g.*, m.status, m.strand, m.found, p.genotype, p.rsid observed_rsid, {comp('p.genotype')} flipped, s.score s_score, s.final_tier,
   case when m.status = 'matched' and g.frequency is not null then list_sort(list_distinct(list_concat(string_split(case m.strand when 'complemented' then {comp('p.genotype')} else p.genotype end, ''),
      case when m.strand = 'ambiguous' then string_split({comp('p.genotype')}, '') else [] end))) end called
   from matches m join genes g on g.card_id = m.card_id left join probes p on p.chrom = g.chrom and p.pos_grch37 = g.pos_grch37 left join scores s on s.card_id = m.card_id),
priced as (select *, list_filter(called, lambda a: not (a = low_allele or (a = high_allele and card_id % 8 <> 0))) unpriced,
   case when list_contains(called, low_allele) and (not list_contains(called, high_allele) or frequency < 1.0::double - frequency or (frequency = 1.0::double - frequency and low_allele < high_allele)) then low_allele else high_allele end least_allele from found),
shown as (select g.*, case when status = 'matched' and len(unpriced) = 0 then least_allele end r_allele, case when status = 'matched' and len(unpriced) = 0 then case when least_allele = low_allele then frequency else 1.0::double - frequency end end r_frequency,
   case when kind = 'impossibility' then {_filled('summary_t', {'gene': "coalesce(g.gene, '')"})} when status = 'matched' then {_filled('os.template', _VALUES)} else {_REASON} end summary,
   case when kind = 'impossibility' then {_filled('detail_t', {'gene': "coalesce(g.gene, '')"})} when status = 'matched' then {_filled('od.template', _VALUES)} else {_REASON} end detail,
   case when status = 'matched' and len(unpriced) > 0 then 'No frequency is known of ' || array_to_string(unpriced, ', ') || ', so rarity could not be checked and confidence is capped.' else '' end caveats
   from priced g left join outcomes os on os.card_id = g.card_id and os.outcome = g.found and os.part = 'summary' left join outcomes od on od.card_id = g.card_id and od.outcome = g.found and od.part = 'detail')"""
RF = f"{RM}{SCORED}{PACK}{FOUND}"
_TOKENS = "unnest(regexp_extract_all(template, '\\{\\{|\\}\\}|\\{[^{}]*\\}|[^{}]+|[{}]')) x"
_NAMES = "[" + ", ".join(f"'{n}'" for n in packs.TEMPLATE_NAMES) + "]"
SQL.update(
    {
        "card_texts": f"{RF} select card_id, status, summary, detail, caveats from shown",
        "strand_frequency": f"{RF} select card_id, strand, r_allele allele, round(r_frequency, 6) frequency, array_to_string(unpriced, ',') unpriced from shown where status = 'matched'",
        "rendered_outcomes": f"with {CARDS.strip()}{PACK} select m.card_id, m.genotype, m.outcome, o.part, {_filled('o.template', _STAND_INS)} \"text\" from maps m join outcomes o using (card_id, outcome) join genes g using (card_id)",
        "pack_lint": f"""with {CARDS.strip()}{PACK}, ref as (select case when card_id % 5 = 1 then 'rs1' else rsid end rsid, chrom, pos_grch37 + case when card_id % 4 = 1 then 20000 else 0 end pos_grch37, low_allele ref, case when card_id % 3 = 1 then low_allele else high_allele end alt from cards where card_id % 7 <> 0),
   places as (select card_id, kind, gene, o.outcome || '.' || part place, template from outcomes o join genes using (card_id) where kind = 'interpretation'
      union all select card_id, kind, gene, 'summary', summary_t from genes where kind = 'impossibility' union all select card_id, kind, gene, 'detail', detail_t from genes where kind = 'impossibility'),
   tokens as (select *, x[2:-2] as token from (select *, {_TOKENS} from places)),
   states as (select card_id, case when exists (select 1 from ref r where r.chrom = c.chrom and r.pos_grch37 = c.pos_grch37 and r.rsid = c.rsid and low_allele in (ref, alt) and high_allele in (ref, alt)) then null
      when exists (select 1 from ref r where r.chrom = c.chrom and r.pos_grch37 = c.pos_grch37 and r.rsid = c.rsid) then 'variant-allele-mismatch'
      when exists (select 1 from ref r where r.chrom = c.chrom and r.pos_grch37 = c.pos_grch37) then 'variant-rsid-mismatch'
      when exists (select 1 from ref r where r.rsid = c.rsid) then 'variant-coordinate-mismatch' else 'variant-unresolved' end code from cards c where kind = 'interpretation')
   select card_id, code, null::varchar place, null::varchar detail from states where code is not null
   union all select card_id, 'citation-missing', null, null from genes where kind = 'interpretation' and n_citations = 0
   union all select card_id, 'outcome-unresolved', genotype, outcome from maps m where outcome not in (select o.outcome from outcomes o where o.card_id = m.card_id)
   union all select card_id, case when template is null then 'template-missing' else 'template-empty' end, place, null from places where template is null or trim(template) = ''
   union all select card_id, 'template-malformed', place, x from tokens where x in ('{{', '}}')
   union all select card_id, case when token = '' then 'placeholder-positional' when regexp_matches(token, '[:!]') then 'placeholder-format' else 'placeholder-unknown' end, place, token from tokens
      where starts_with(x, '{{') and ends_with(x, '}}') and x not in ('{{{{', '}}}}', '{{', '}}') and (token = '' or regexp_matches(token, '[:!]') or not list_contains({_NAMES}, token) or (token = 'gene' and gene is null) or (kind = 'impossibility' and token <> 'gene'))""",
        "card_payload": f"""{RF} select card_id, section, kind, title, gene, status, summary, detail, case when kind = 'interpretation' then g.rsid end rsid, case when kind = 'interpretation' then chrom end chrom, case when kind = 'interpretation' then pos_grch37 end pos_grch37,
   case when kind = 'interpretation' then low_allele || ',' || high_allele end alleles, case strand when 'as_written' then genotype when 'complemented' then flipped end genotype, genotype observed_genotype, case when status = 'matched' then found end outcome_name,
   case when status = 'matched' then s_score end score, case when status = 'matched' then final_tier end tier, case when kind = 'interpretation' then case when quality is null then 'direct' else 'imputed' end end call_source,
   case when kind = 'interpretation' then quality end imputation_quality, r_allele rarest_allele, case when frequency is null then 0 when card_id % 8 = 0 then 1 else 2 end n_frequencies, n_citations, case when caveats = '' then 0 else 1 end n_caveats from shown g""",
        "assembly_pairing_problems": f"""with {CARDS.strip()}, ms as (select card_id from cards where card_id % 31 <> 0 union all select card_id + case when card_id % 2 = 0 then 1000000000 else 0 end from cards where card_id % 37 = 0),
   os as (select card_id from cards where card_id % 41 <> 0 and (kind = 'interpretation' or card_id % 3 = 0) union all select card_id + 2000000000 from cards where card_id % 43 = 0),
   m as (select card_id, count(*) n from ms group by 1), o as (select card_id, count(*) n from os group by 1)
   select * from (select card_id, case when kind is null and m.n is not null then 'unknown_match' when kind is null then 'unknown_observation' when m.n is null then 'missing_match' when m.n > 1 then 'repeated_match'
      when kind = 'impossibility' and coalesce(o.n, 0) > 0 then 'observed_impossibility' when kind = 'interpretation' and coalesce(o.n, 0) = 0 then 'missing_observation' when o.n > 1 then 'repeated_observation' end problem
      from cards full join m using (card_id) full join o using (card_id)) where problem is not null""",
    }
)
