"""DuckDB SQL of each query, written from the semantics over the same Parquet tables."""

from __future__ import annotations

RAW = """
raw as (select concat('rs', cast(900000000 + o*8+n as varchar)) rsid, cast(code as varchar) chrom,
   cast(1 + (o*7919 + s*104729 + n*1299709) % 16569 as varchar) pos,
   case when e % 97 = 0 then '0' when e % 61 = 0 then 'I' else substr('ACGT', cast(1 + p % 4 as int), 1) end a1,
   case when e % 97 = 0 then '0' when e % 61 = 0 then 'D' when code in (23,24,26) then substr('ACGT', cast(1 + p % 4 as int), 1)
        else substr('ACGT', cast(1 + (p + case when q % 4 = 0 then 2 else 0 end) % 4 as int), 1) end a2, o, n, p, s, q, e
 from (select *, 1 + (p*31+n*7+o) % 26 code from (select l_orderkey o, l_linenumber n, l_partkey p, l_suppkey s, cast(l_quantity as bigint) q,
       cast(round(l_extendedprice*100) as bigint) e from lineitem))),
t as (select rsid, case chrom when '23' then 'X' when '24' then 'Y' when '25' then 'PAR' when '26' then 'MT' else chrom end chrom, cast(pos as bigint) pos_grch37,
   case when a1 <> '0' then least(a1, a2) end allele1, case when a1 <> '0' then greatest(a1, a2) end allele2,
   case when a1 <> '0' then least(a1, a2) || greatest(a1, a2) end genotype, case when a1 <> '0' then 'called' else 'no_call' end call_status, o, n, p, s, q, e from raw)"""
DAMAGED = """,
bad as (select case when e % 211 = 0 then null else rsid end rsid, case when e % 223 = 0 then '77' else chrom end chrom,
   case when e % 227 = 0 then '12x' when e % 229 = 0 then '0' when e % 233 = 0 then '4000000000' else pos end pos,
   case when e % 239 = 0 then 'N' when e % 241 = 0 then '0' else a1 end a1, a2, o, n, p, s, q, e from raw),
checked as (select *, case when rsid is null then 'empty_field' when chrom = '77' then 'unknown_chrom' when pos = '12x' then 'bad_position' when pos = '0' then 'zero_position'
   when pos = '4000000000' then 'beyond_end' when a1 = 'N' then 'bad_allele' when (a1 = '0') <> (a2 = '0') then 'half_call' end as "check" from bad)"""
COMP = "(case when translate(substr({g},1,1),'ACGT','TGCA') <= translate(substr({g},2,1),'ACGT','TGCA') then translate({g},'ACGT','TGCA') else translate(substr({g},2,1)||substr({g},1,1),'ACGT','TGCA') end)"


def comp(g: str) -> str:
    return COMP.format(g=g)


ORDER = "(values (0,'1'),(1,'2'),(2,'3'),(3,'4'),(4,'5'),(5,'6'),(6,'7'),(7,'8'),(8,'9'),(9,'10'),(10,'11'),(11,'12'),(12,'13'),(13,'14'),(14,'15'),(15,'16'),(16,'17'),(17,'18'),(18,'19'),(19,'20'),(20,'21'),(21,'22'),(22,'X'),(23,'Y'),(24,'PAR'),(25,'MT')) as d(chrom_order, chrom)"
RATE = "case when {d} > 0 then round({n} * 1.0::double / {d}, 6) else 0.0 end"


def rate(n: str, d: str) -> str:
    return RATE.format(n=n, d=d)


SNP = "(call_status <> 'no_call' and allele1 not in ('I','D') and allele2 not in ('I','D'))"
AUTO = "(chrom not in ('X','Y','PAR','MT'))"
COUNTS = f""",
counts as (select count(*) n_rows, count(*) filter (call_status <> 'no_call') n_called, count(*) filter ({AUTO} and {SNP}) autosomal_loci,
   count(*) filter ({AUTO} and {SNP} and allele1 <> allele2) autosomal_het, count(*) filter (chrom = 'X' and {SNP}) x_loci,
   count(*) filter (chrom = 'X' and {SNP} and allele1 <> allele2) x_het, count(*) filter (chrom = 'Y') y_rows,
   count(*) filter (chrom = 'Y' and call_status <> 'no_call') y_called, count(*) filter (allele1 in ('I','D') or allele2 in ('I','D')) n_indels from t),
sexed as (select *, case when x_loci < 100 then 'ambiguous' when y_rows = 0 then case when x_rate <= 0.05 then 'male' when x_rate >= 0.15 then 'female' else 'ambiguous' end
   when x_rate <= 0.05 and y_rate >= 0.3 then 'male' when x_rate >= 0.15 and y_rate <= 0.15 then 'female' else 'ambiguous' end sex
   from (select *, {rate('x_het', 'x_loci')} x_rate, {rate('y_called', 'y_rows')} y_rate from counts)),
ploid as (select t.* exclude (call_status), case when call_status = 'no_call' then 'no_call' when not single then 'called' when coalesce(allele1 <> allele2, false) then 'het_haploid' else 'hemizygous' end call_status
   from (select t.*, case when sex = 'male' then chrom in ('X','Y','MT') else chrom = 'MT' end single from t, sexed) t)"""
PROBES = f""",
compared as (select *, case when genotype is null then null when genotype in ('AT','CG') then genotype
   when regexp_matches(genotype, '^[ACGT]+$') then least(genotype, {comp('genotype')}) else genotype end c from ploid),
ranked as (select *, row_number() over (partition by chrom, pos_grch37 order by genotype is null, o, n, p, s, q, e, rsid, allele1, allele2) r from compared),
probes as (select chrom, pos_grch37, count(*) n_probes, count(genotype) n_called, coalesce(min(c) <> max(c), false) conflict,
   max(rsid) filter (r = 1) rsid, max(allele1) filter (r = 1) allele1, max(allele2) filter (r = 1) allele2, max(genotype) filter (r = 1) genotype, max(call_status) filter (r = 1) call_status
   from ranked group by all)"""
CARDS = """
cards as (select p card_id, case when p % 11 = 0 then 'impossibility' else 'interpretation' end kind, 'rs' || cast(900000000 + p*8 + z % 5 as varchar) rsid,
   case code when 23 then 'X' when 24 then 'Y' when 25 then 'PAR' when 26 then 'MT' else cast(code as varchar) end chrom, 1 + (p*7919 + z*104729) % 16569 pos_grch37,
   least(x, y) low_allele, greatest(x, y) high_allele, 'lower' low_outcome, case when p % 5 = 0 then 'higher' else 'between' end mid_outcome, case when p % 13 = 0 then 'lower' else 'higher' end high_outcome,
   ['clinical_guideline','expert_curated','functional','gwas','candidate_gene','anecdotal'][1 + p % 6] evidence,
   ['meta_analysis','independent','same_cohort','none','conflicting'][1 + z % 5] replication,
   ['odds_ratio','proportion','percent_variance_explained','beta'][1 + r % 4] effect_kind, (1 + r % 97) / 100.0::double effect_value,
   case when r % 3 = 0 then (r % 50) / 100.0::double end ci_low, case when r % 3 = 0 then (r % 50 + 40) / 100.0::double end ci_high,
   case when z % 4 = 0 then null when z % 4 = 1 then (r % 7) / 1000000.0::double else (r % 1000) / 2000.0::double end frequency,
   case when z % 3 = 0 then (r % 101) / 100.0::double end quality, case when z % 2 = 0 then (r % 89) / 100.0::double end ancestry_match,
   'Card ' || cast(r % 1000 as varchar) title, 'section ' || cast(p % 13 as varchar) section
 from (select *, 1 + (p*7) % 26 code, substr('ACGT', cast(1 + p % 4 as int), 1) x, substr('ACGT', cast(1 + case when p % 3 = 0 then 3 - p % 4 else (p % 4 + 2) % 4 end as int), 1) y
   from (select p_partkey p, p_size z, cast(round(p_retailprice*100) as bigint) r from part)))"""
FLIP = comp("genotype")


def outcome(g: str) -> str:
    return f"case {g} when low_allele || low_allele then low_outcome when low_allele || high_allele then mid_outcome when high_allele || high_allele then high_outcome end"


MATCHES = f""",
oriented as (select c.*, b.n_probes, b.n_called, b.conflict, b.allele1, b.allele2, b.genotype, b.call_status, {FLIP} flipped,
   low_allele || high_allele in ('AT','CG') palindromic, allele1 in (low_allele, high_allele) and allele2 in (low_allele, high_allele) inside from cards c left join probes b using (chrom, pos_grch37)),
stranded as (select *, case when genotype is null then null when palindromic and inside then 'ambiguous' when palindromic then 'mismatch' when inside then 'as_written'
   when substr(flipped,1,1) in (low_allele, high_allele) and substr(flipped,2,1) in (low_allele, high_allele) then 'complemented' else 'mismatch' end strand from oriented),
judged as (select *, case when strand = 'complemented' then {outcome('flipped')} else {outcome('genotype')} end found, {outcome('flipped')} other from stranded),
matches as (select card_id, kind, case when kind = 'impossibility' then 'not_determinable' when n_probes is null then 'marker_absent' when conflict then 'duplicate_conflict' when genotype is null then 'no_call'
   when allele1 in ('I','D') or allele2 in ('I','D') then 'indel_excluded' when call_status = 'het_haploid' then 'het_haploid' when strand = 'mismatch' then 'allele_mismatch'
   when strand = 'ambiguous' and other <> found then 'strand_ambiguous' else 'matched' end status, strand, found, n_called from judged)"""
SCORED = """,
parts as (select *, 0.30 * case evidence when 'clinical_guideline' then 1.0 when 'expert_curated' then 0.95 when 'functional' then 0.9 when 'gwas' then 0.8 when 'candidate_gene' then 0.35 else 0.1 end::double
   + 0.15::double * case effect_kind when 'odds_ratio' then least(abs(ln(effect_value)) / ln(4.0::double), 1.0) when 'proportion' then effect_value when 'percent_variance_explained' then least(effect_value / 5, 1.0)
       else case when effect_value = 0 then 0.0 when ci_low is null then 0.5 when ci_high > ci_low then least(abs(effect_value) / (ci_high - ci_low), 1.0) else 1.0 end end
   + 0.20::double * case replication when 'meta_analysis' then 1.0 when 'independent' then 0.9 when 'same_cohort' then 0.35 when 'none' then 0.2 else 0.0 end::double
   + 0.20::double * case when frequency is null then 0.5 when frequency < 1e-5 then 0 when frequency < 1e-4 then 0.15 when frequency < 1e-3 then 0.35 when frequency < 0.01 then 0.6 when frequency < 0.05 then 0.8 else 1 end::double
   + 0.10::double * coalesce(quality, 1.0) + 0.05::double * coalesce(ancestry_match, 0.5) total from cards where kind = 'interpretation'),
tiered as (select *, case when score >= 0.85 then 0 when score >= 0.7 then 1 when score >= 0.5 then 2 else 3 end tier_rank from (select *, round(total, 4) score from parts)),
scored as (select *, greatest(tier_rank, case when evidence = 'anecdotal' or replication = 'conflicting' then 3 when evidence = 'candidate_gene' then 2 else 0 end,
   case when frequency < 1e-5 or quality < 0.3 then 4 when quality < 0.6 then 3 when quality < 0.8 then 2 else 0 end,
   case when ancestry_match < 0.25 then 3 when ancestry_match < 0.5 then 2 when ancestry_match is null then 1 else 0 end, case when frequency is null then 2 else 0 end) final_rank,
   ['well-established','strong','moderate','limited','likely-artifact'] names from tiered)"""
ASSEMBLED = """,
assembled as (select c.card_id, c.kind, c.title, c.section, m.status, case when m.status = 'matched' then m.found end outcome, case when m.status = 'matched' then s.score end score,
   case when m.status = 'matched' then s.names[s.final_rank + 1] end tier, m.status = 'matched' interpreted from cards c join matches m using (card_id) left join scored s using (card_id))"""
MERGES = """
merges as (select 'rs' || k retired_rsid, 'rs' || case when k % 9 = 7 and (k // 9) % 50 = 0 then k - 7 else k + 1 end current_rsid from (select c_custkey k from customer) where k % 9 <> 8),
stuck as (select 'rs' || k retired_rsid, case when k % 2 = 0 then 'withdrawn' else 'ambiguous' end stuck from (select c_custkey k from customer) where k % 9 = 8 and (k // 9) % 5 = 1),
orders_r as (select o_orderkey, 'rs' || o_custkey rsid from orders)"""


def resolved(wanted: str) -> str:
    return f""",
walk as (select distinct rsid, rsid node, [rsid] path, 0 looped from {wanted}
   union all select w.rsid, m.current_rsid, list_append(w.path, m.current_rsid), case when list_contains(w.path, m.current_rsid) then 1 else 0 end from walk w join merges m on w.node = m.retired_rsid where w.looped = 0),
ends as (select w.rsid, w.node, w.looped from walk w left join merges m on w.node = m.retired_rsid where w.looped = 1 or m.retired_rsid is null),
resolved as (select e.rsid, case when looped = 0 and stuck is null then e.node end as "current", case when looped = 1 then 'cycle' else coalesce(stuck, 'current') end status from ends e left join stuck s on e.node = s.retired_rsid and e.looped = 0)"""


PLACED = """
placements as (select k allele_id, 'rs' || (1000 + k - case when k % 17 = 0 then 1 else 0 end) rsid, assembly,
   cast(1 + case when assembly = 'GRCh38' and k % 19 = 0 then c % 21 + 1 else c % 22 end as varchar) chrom, 1000 + k*3 + case when assembly = 'GRCh38' and k % 23 <> 0 then 777 else 0 end pos,
   case when k % 4 = 0 then '-' else 'GENE' || (c % 50) end gene
   from (select o_orderkey k, o_custkey c from orders), (values ('GRCh37'), ('GRCh38')) a(assembly) where not (assembly = 'GRCh38' and k % 6 = 0)),
single as (select allele_id, min(rsid) rsid, min(chrom) filter (assembly = 'GRCh37') chrom, min(pos) filter (assembly = 'GRCh37') pos_grch37, min(pos) filter (assembly = 'GRCh38') pos_grch38,
   coalesce(string_agg(distinct gene, '|' order by gene) filter (gene <> '-'), '-') gene from placements group by allele_id
   having count(distinct (chrom, pos)) filter (assembly = 'GRCh37') = 1 and count(distinct (chrom, pos)) filter (assembly = 'GRCh38') = 1 and count(distinct rsid) = 1
   and min(chrom) filter (assembly = 'GRCh37') = min(chrom) filter (assembly = 'GRCh38')),
anchors as (select rsid, min(chrom) chrom, min(pos_grch37) pos_grch37, min(pos_grch38) pos_grch38, min(gene) gene from single group by rsid
   having count(distinct (chrom, pos_grch37, pos_grch38)) = 1 and min(pos_grch37) <> min(pos_grch38))"""
PANEL = """
panel as (select k variant_id, cast(1 + k % 22 as varchar) chrom, 1 + (k*2377) % 16000 - case when k % 29 = 0 then (k*2377) % 16000 else 0 end pos_grch37,
   substr('ACGT', cast(1 + k % 4 as int), 1) ref, substr('ACGT', cast(1 + (k % 4 + 1 + k % 3) % 4 as int), 1) alt, i sample_id,
   case when (k*37 + i*11) % 53 = 0 and k % 3 = 0 then null when k % 31 = 0 then 0 else ((k*13 + i*i*(1 + k % 5) + i*7) % 97) % 3 end dosage
   from (select s_suppkey k from supplier), range(1, 41) r(i)),
sites as (select distinct variant_id, chrom, pos_grch37, ref, alt from panel),
weights as (select k variant_id, (1 + k % 99) / 100.0::double frequency, component, ((k * component) % 41 - 20) / 20.0::double weight from (select s_suppkey k from supplier), (values (1), (2)) c(component))"""
ANCHOR_HITS = """
   a as (select rsid, case when pos % 10 = 0 then pos + 100000 else pos end a37, pos + case when pos % 10 = 0 then 0 else 5000 end a38
     from (select rsid, min(cast(pos as bigint)) pos from raw where o % 40 = 0 and n = 1 group by 1)),
   h as (select a.rsid, bool_or(pos_grch37 = a37) at37, bool_or(pos_grch37 = a38) at38 from a left join t using (rsid) group by 1),
   hits as (select count(*) n_anchors, count(at37) n_found, count(*) filter (at37) n_37, count(*) filter (at38 and not at37) n_38 from h),
   verdicts as (select *, case when n_37 >= 2 and n_37 > n_38 then 'confirmed_37' when n_38 >= 2 and n_38 > n_37 then 'suspected_38' else 'indeterminate' end verdict from hits)"""
SEP = r"(?:[ \t]*[|│┆║┊][ \t]*|[ \t]+|(?:\\t)+|(?:\\s)+)"
LEAKS = {
    "ancestry_row": r"(?m)^\s*(?:rs|i)\d+[ \t]+(?:\d{1,2}|[XYM]|MT|PAR)[ \t]+\d+[ \t]+[ACGTID0][ \t]+[ACGTID0]\s*$",
    "merged_row": r"(?m)^\s*(?:rs|i)\d+[ \t]+(?:\d{1,2}|[XYM]|MT|PAR)[ \t]+\d+[ \t]+(?:[ACGTID0]{1,2}|--)\s*$",
    "escaped_row": rf"(?:rs|i)\d+{SEP}(?:\d{{1,2}}|[XYM]|MT|PAR){SEP}\d+{SEP}[ACGTID0](?:{SEP}[ACGTID0])?",
    "inline_genotype": r"""\b(?:rs|i)\d+\b\s*[:=]\s*['"]?[ACGTID0]\s*[/|]?\s*[ACGTID0]\b""",
    "keyed_fields": r"""(?s)\brsid\s*[=:]\s*['"]?(?:rs|i)\d+['"]?.{0,300}?\b(?:a|allele)1\s*[=:]\s*['"]?[ACGTID0]['"]?""",
}
NOTES = r""",
notes as (select o % 8 shape, case o % 8 when 0 then rsid || chr(9) || chrom || chr(9) || pos || chr(9) || a1 || chr(9) || a2 when 1 then 'ü ' || chr(10) || rsid || ' ' || chrom || ' ' || pos || ' ' || a1 || a2
   when 2 then 'row "' || rsid || '\t' || chrom || '\t' || pos || '\t' || a1 || '\t' || a2 || '"' when 3 then '| ' || rsid || ' | ' || chrom || ' | ' || pos || ' | ' || a1 || ' |' when 4 then 'my ' || rsid || ' = "' || a1 || '/' || a2 || '" call'
   when 5 then 'Row(rsid=''' || rsid || ''', pos=' || pos || ', a1=''' || a1 || ''')' when 6 then 'see ' || rsid || ' at ' || pos else 'x' || rsid || ': ' || a1 || a2 end note from raw)"""
R, RC, RP = f"with {RAW}", f"with {RAW}{COUNTS}", f"with {RAW}{COUNTS}{PROBES}"
RM = f"{RP}, {CARDS.strip()}{MATCHES}"
RA = f"{RM}{SCORED}{ASSEMBLED}"
COLS = "rsid, chrom, pos_grch37, allele1, allele2, genotype, call_status"
TIER_DIM = "(values (0,'well-established'),(1,'strong'),(2,'moderate'),(3,'limited'),(4,'likely-artifact')"

SQL = {
    "normalize_genotypes": f"{R} select {COLS} from t",
    "normalize_damaged": f"""{R}{DAMAGED} select rsid, case chrom when '23' then 'X' when '24' then 'Y' when '25' then 'PAR' when '26' then 'MT' else chrom end chrom, cast(pos as bigint) pos_grch37,
   case when a1 <> '0' then least(a1, a2) end allele1, case when a1 <> '0' then greatest(a1, a2) end allele2, case when a1 <> '0' then least(a1, a2) || greatest(a1, a2) end genotype,
   case when a1 <> '0' then 'called' else 'no_call' end call_status from checked where "check" is null""",
    "normalize_error_summary": f"""{R}{DAMAGED}, firsts as (select *, row_number() over (partition by "check" order by o, n, p, s, q, e, rsid) r from checked where "check" is not null)
   select precedence, d."check", coalesce(n_rows, 0) n_rows, first_rsid
   from (values (0,'empty_field'),(1,'unknown_chrom'),(2,'bad_position'),(3,'zero_position'),(4,'beyond_end'),(5,'bad_allele'),(6,'half_call')) d(precedence, "check")
   left join (select "check", count(*) n_rows, max(rsid) filter (r = 1) first_rsid from firsts group by 1) f on d."check" = f."check" """,
    "merged_genotype_split": f"""{R}, g as (select case when a1 = '0' then '--' when e % 13 = 0 then a1 when e % 89 = 0 then a1 || a2 || a1 else a1 || a2 end g from raw)
   select case when g = '--' then '0' when length(g) in (1, 2) then substr(g, 1, 1) end a1, case when g = '--' then '0' when length(g) = 2 then substr(g, 2, 1) when length(g) = 1 then g end a2,
   length(g) not in (1, 2) malformed, count(*) n_rows from g group by 1, 2, 3""",
    "call_rate_overall": f"{R} select count(*) n_rows, count(*) filter (call_status <> 'no_call') n_called, {rate('count(*) filter (call_status <> $$no_call$$)', 'count(*)')} call_rate from t",
    "call_rate_by_chrom": f"""{R}, c as (select chrom, count(*) n_rows, count(*) filter (call_status <> 'no_call') n_called from t group by 1)
   select chrom_order, chrom, n_rows, n_called, n_rows - n_called n_no_call, {rate('n_called', 'n_rows')} call_rate from c join {ORDER} using (chrom)""",
    "call_rate_rollup": f"""{R}, c as (select chrom, count(*) n_rows, count(*) filter (call_status <> 'no_call') n_called from t group by rollup (chrom))
   select chrom, n_rows, n_called, {rate('n_called', 'n_rows')} call_rate from c""",
    "heterozygosity": f"{RC} select autosomal_loci, autosomal_het, {rate('autosomal_het', 'autosomal_loci')} autosomal_rate, x_loci, x_het, {rate('x_het', 'x_loci')} x_rate from counts",
    "infer_sex": f"{RC} select x_loci, x_rate, y_rows, y_rate, sex from sexed",
    "resolve_ploidy": f"{RC} select chrom, call_status, count(*) n_rows from ploid group by all",
    "het_haploid_count": f"{RC} select count(*) filter (call_status = 'het_haploid') n_het_haploid from ploid",
    "indel_summary": f"{RC} select n_indels from counts",
    "indel_policy_matchable": f"""{R}, {CARDS.strip()} select chrom, count(*) n_matchable from t
   where not coalesce(allele1 in ('I','D') or allele2 in ('I','D'), false) or rsid in (select rsid from cards) group by chrom""",
    "duplicate_summary": f"{R} select count(*) - (select count(*) from (select distinct rsid from t)) extra_rsid_rows, count(*) - (select count(*) from (select distinct chrom, pos_grch37 from t)) extra_locus_rows from t",
    "build_check": f"{R}, {ANCHOR_HITS} select * from verdicts",
    "absent_chromosomes": f"{R} select chrom from {ORDER} where chrom not in (select chrom from t where chrom not in ('7','PAR','Y'))",
    "qc_warnings": f"""{RC}, {ANCHOR_HITS}, x as (select sexed.*, {rate('autosomal_het', 'autosomal_loci')} het, (select verdict from verdicts) verdict,
     (select count(*) from t where coalesce(allele1 <> allele2, false) and call_status <> 'no_call' and allele1 not in ('I','D') and allele2 not in ('I','D') and (chrom = 'MT' or (sex = 'male' and chrom in ('X','Y')))) hh,
     (select count(*) from (select chrom from t group by 1 having count(*) >= 100 and round(count(*) filter (call_status <> 'no_call') * 1.0::double / count(*), 6) < 0.98) where not (chrom = 'Y' and sex = 'female')) low,
     (select count(*) - count(distinct (chrom, pos_grch37)) from t) dup, 26 - (select count(distinct chrom) from t) absent from sexed)
   select precedence, warning from (select unnest([
     {{'precedence': 1, 'warning': 'suspected_38', 'on': verdict = 'suspected_38'}},
     {{'precedence': 2, 'warning': 'ambiguous_sex', 'on': sex = 'ambiguous'}}, {{'precedence': 3, 'warning': 'low_call_rate', 'on': round(n_called * 1.0::double / n_rows, 6) < 0.98}},
     {{'precedence': 4, 'warning': 'low_chrom_call_rate', 'on': low > 0}}, {{'precedence': 5, 'warning': 'heterozygosity', 'on': autosomal_loci > 0 and not (het between 0.15 and 0.4)}},
     {{'precedence': 6, 'warning': 'het_haploid', 'on': hh > 0}}, {{'precedence': 7, 'warning': 'female_y', 'on': sex = 'female' and y_rate > 0.15}},
     {{'precedence': 8, 'warning': 'duplicate_positions', 'on': dup > 0}}, {{'precedence': 9, 'warning': 'absent_chromosomes', 'on': absent > 0}}], recursive := true) from x) where "on" """,
    "locus_lookup_inner": f"{R}, {CARDS.strip()} select t.chrom, t.pos_grch37, t.rsid, t.genotype, t.call_status from t join cards c on t.chrom = c.chrom and t.pos_grch37 = c.pos_grch37",
    "rsid_lookup_semi": f"""with recursive {MERGES.strip()}, wanted as (select retired_rsid rsid from merges), both_r as (select rsid from orders_r union all select rsid from wanted){resolved('both_r')},
   cur as (select rsid, "current" current_rsid from resolved) select o_orderkey, rsid, current_rsid from orders_r join cur using (rsid) where current_rsid in (select current_rsid from wanted join cur using (rsid) where current_rsid is not null)""",
    "current_rsid": f"""with recursive {MERGES.strip()}{resolved('orders_r')} select o_orderkey, rsid, "current" current_rsid from orders_r join resolved using (rsid)""",
    "rsid_resolution_status": f"""with recursive {MERGES.strip()}, wanted as (select retired_rsid rsid from merges){resolved('wanted')} select rsid, "current", status from resolved""",
    "merge_split_resolved": "select 'rs' || k retired_rsid, 'rs' || (k + 1) current_rsid from (select c_custkey k from customer) where k % 7 <> 0 and k % 5 <> 0",
    "merge_split_unresolved": "select 'rs' || k retired_rsid, case when k % 7 = 0 then 'withdrawn' else 'ambiguous' end status, case when k % 7 = 0 then '' else 'rs' || (k + 1) || ',rs' || (k + 2) end targets from (select c_custkey k from customer) where k % 7 = 0 or k % 5 = 0",
    "variant_cross_check": f"""with {CARDS.strip()}, ref as (select case when card_id % 5 = 1 then 'rs1' else rsid end rsid, chrom, pos_grch37 + case when card_id % 4 = 1 then 20000 else 0 end pos_grch37, low_allele ref,
     case when card_id % 3 = 1 then low_allele else high_allele end alt from cards where card_id % 7 <> 0),
   placed as (select card_id, bool_or(r.rsid = c.rsid) here, bool_or(r.rsid = c.rsid and low_allele in (ref, alt) and high_allele in (ref, alt)) fits from cards c join ref r on c.chrom = r.chrom and c.pos_grch37 = r.pos_grch37 group by 1)
   select card_id, case when here is null and rsid not in (select rsid from ref) then 'unresolved' when here is null then 'coordinate-mismatch' when not here then 'rsid-mismatch' when not fits then 'allele-mismatch' else 'ok' end state
   from cards left join placed using (card_id)""",
    "variant_lookup_rsid_or_locus": f"""{R}, {CARDS.strip()} select distinct rsid, chrom, pos_grch37 from t where rsid in (select rsid from cards where card_id % 2 = 0)
   or (chrom, pos_grch37) in (select (chrom, pos_grch37) from cards where card_id % 2 = 1)""",
    "duplicate_probe_resolution": f"{RP} select * from probes",
    "card_match": f"{RM} select card_id, kind, status, strand, case when status = 'matched' then found end outcome, n_called n_called_probes from matches",
    "match_status_counts": f"""{RM} select rank, d.status, coalesce(n, 0) n_cards from (values (0,'matched'),(1,'marker_absent'),(2,'duplicate_conflict'),(3,'no_call'),(4,'indel_excluded'),(5,'het_haploid'),(6,'allele_mismatch'),
   (7,'strand_ambiguous'),(8,'not_determinable')) d(rank, status) left join (select status, count(*) n from matches group by 1) m using (status)""",
    "strand_orientation": f"{R} select genotype, {comp('genotype')} other_strand, least(genotype, {comp('genotype')}) canonical, count(*) n_rows from t where regexp_matches(genotype, '^[ACGT]+$') group by 1, 2, 3",
    "genotype_enumeration": f"with {CARDS.strip()} select card_id, unnest([low_allele || low_allele, low_allele || high_allele, high_allele || high_allele]) genotype from cards",
    "confidence_score": f"with {CARDS.strip()}{SCORED} select card_id, score, names[tier_rank + 1] tier, names[final_rank + 1] final_tier from scored",
    "confidence_tier_counts": f"with {CARDS.strip()}{SCORED} select rank, final_tier, coalesce(n, 0) n_cards from {TIER_DIM}) d(rank, final_tier) left join (select names[final_rank + 1] final_tier, count(*) n from scored group by 1) s using (final_tier)",
    "rarest_called_allele": f"""{RP}, {CARDS.strip()}, called as (select distinct card_id, unnest([b.allele1, b.allele2]) allele from cards c join probes b on c.chrom = b.chrom and c.pos_grch37 = b.pos_grch37 where b.genotype is not null),
   f as (select card_id, low_allele allele, frequency from cards where frequency is not null union all select card_id, high_allele, 1.0::double - frequency from cards where frequency is not null),
   j as (select card_id, c.allele, f.frequency, row_number() over (partition by card_id order by f.frequency nulls first, c.allele) r, count(*) filter (f.frequency is null) over (partition by card_id) n_missing from called c left join f using (card_id, allele))
   select card_id, case when n_missing = 0 then allele end allele, case when n_missing = 0 then round(frequency, 6) end frequency, n_missing from j where r = 1""",
    "assembled_cards": f"{RA} select * from assembled",
    "card_grid_by_section": f"""{RA} select rank, label, count(section) total, count(*) filter (interpreted) interpreted, count(*) filter (interpreted) shown
   from (select i rank, 'section ' || i label from range(13) r(i)) d left join assembled on section = label group by 1, 2""",
    "card_grid_by_tier": f"""{RA} select rank, label, count(card_id) total, count(*) filter (interpreted) interpreted, count(*) filter (section in ('section 0','section 1','section 2','section 3','section 4')) shown
   from {TIER_DIM}, (5,'untiered')) d(rank, label) left join assembled on coalesce(tier, 'untiered') = label group by 1, 2""",
    "card_grid_sorted": f"{RA} select card_id, title, section, tier from assembled where tier in ('moderate','limited') order by lower(title), card_id",
    "anchor_pairing": f"with {PLACED.strip()} select * from anchors",
    "anchor_round_robin": f"""with {PLACED.strip()}, r as (select rsid, chrom, row_number() over (partition by chrom order by cast(substr(rsid, 3) as bigint)) turn from anchors)
   select rsid, r.chrom, turn, chrom_order from r join {ORDER} on r.chrom = d.chrom order by turn, chrom_order limit 200""",
    "panel_site_qc": f"""with {PANEL.strip()}, c as (select variant_id, chrom, pos_grch37, ref, alt, count(*) n, count(dosage) k, sum(dosage) a from panel group by all),
   f as (select *, a / (2.0::double * k) f from c) select variant_id, chrom, pos_grch37, ref, alt, round(least(f, 1 - f), 6) maf, round(1 - k * 1.0::double / n, 6) missing from f
   where round(least(f, 1 - f), 6) >= 0.05 and round(1 - k * 1.0::double / n, 6) <= 0.02""",
    "duplicate_site_removal": f"with {PANEL.strip()} select variant_id, chrom, pos_grch37 from sites qualify count(*) over (partition by chrom, pos_grch37) = 1",
    "panel_range_exclusion": f"""with {PANEL.strip()} select variant_id, chrom, pos_grch37 from sites s where not exists (select 1 from nation where cast(1 + n_nationkey % 22 as varchar) = s.chrom and s.pos_grch37 between n_nationkey * 600 and n_nationkey * 600 + 2500)""",
    "panel_array_intersection": f"{R}, {PANEL.strip()} select variant_id, chrom, pos_grch37 from sites where (chrom, pos_grch37) in (select (chrom, pos_grch37) from t)",
    "panel_harmonization": f"""{RP}, {PANEL.strip()}, j as (select s.*, n_probes, conflict, genotype, {comp('genotype')} other from sites s left join probes b using (chrom, pos_grch37)),
   o as (select *, case when n_probes is null then 'not_on_array' when conflict then 'duplicate_conflict' when genotype is null then 'no_call' when least(ref, alt) || greatest(ref, alt) in ('AT','CG') then 'ambiguous_site'
     when substr(genotype,1,1) in (ref, alt) and substr(genotype,2,1) in (ref, alt) then 'as_written' when substr(other,1,1) in (ref, alt) and substr(other,2,1) in (ref, alt) then 'complemented' else 'allele_mismatch' end outcome from j),
   g as (select *, case outcome when 'as_written' then genotype when 'complemented' then other end g from o)
   select variant_id, chrom, pos_grch37, outcome, cast(substr(g,1,1) = alt as int) + cast(substr(g,2,1) = alt as int) dosage from g""",
    "projection_scores": f"""with {PANEL.strip()} select sample_id, component, round(sum(weight * (dosage - 2 * frequency) / sqrt(2 * frequency * (1 - frequency))) / count(*), 6) score, count(*) n_used
   from panel join weights using (variant_id) where dosage is not null group by 1, 2""",
    "projection_coverage": f"""with {PANEL.strip()}, n as (select sample_id, count(distinct variant_id) n from panel where dosage is not null group by 1), m as (select count(distinct variant_id) m from weights)
   select min(n) least_called, any_value(m) n_markers, round(min(n) * 1.0::double / any_value(m), 6) coverage from n, m""",
    "linked_sites": f"""with {PANEL.strip()}, s as (select a.chrom, a.variant_id keep_id, b.variant_id drop_id, count(*) n, sum(a.dosage) sx, sum(b.dosage) sy, sum(a.dosage*a.dosage) xx, sum(b.dosage*b.dosage) yy, sum(a.dosage*b.dosage) xy
     from panel a join panel b on a.chrom = b.chrom and a.sample_id = b.sample_id and (a.pos_grch37, a.variant_id) < (b.pos_grch37, b.variant_id) and b.pos_grch37 - a.pos_grch37 <= 6000
     where a.dosage is not null and b.dosage is not null group by 1, 2, 3),
   v as (select *, (n*xy - sx*sy)::double c, (n*xx - sx*sx)::double vx, (n*yy - sy*sy)::double vy from s)
   select chrom, keep_id, drop_id, round(c*c/(vx*vy), 6) r2 from v where vx > 0 and vy > 0 and round(c*c/(vx*vy), 6) > 0.02""",
    "merge_artifact_overlap": f"""with {MERGES.strip()} select retired_rsid from merges where cast(substr(retired_rsid, 3) as bigint) % 7 = 0 union select m.retired_rsid from merges m join stuck s using (retired_rsid)""",
    "site_id_problems": """with i as (select case when k % 11 = 0 then '.' when k % 13 = 0 then '' when k % 17 = 0 then null else 'rs' || (k // 2) end id from (select s_suppkey k from supplier))
   select count(*) filter (id is null or id in ('', '.')) n_blank, count(*) filter (id not in ('', '.')) - count(distinct id) filter (id not in ('', '.')) n_repeated from i""",
    "genotype_map_gaps": f"""with {CARDS.strip()}, pairs as (select distinct card_id, unnest([low_allele || low_allele, low_allele || high_allele, high_allele || high_allele]) g from cards),
   keys as (select card_id, g, 1 n from pairs where not (card_id % 17 = 0 and substr(g,1,1) <> substr(g,2,1)) union all select card_id, g, 1 from pairs where card_id % 19 = 0 and substr(g,1,1) <> substr(g,2,1)
     union all select distinct card_id, 'QQ', 1 from pairs where card_id % 23 = 0),
   n as (select card_id, g, sum(n) n from keys group by 1, 2)
   select coalesce(n.card_id, p.card_id) card_id, coalesce(n.g, p.g) genotype, case when p.g is null then 'not_constructible' when n.g is null then 'no_outcome' else 'mapped_twice' end problem
   from n full join pairs p on n.card_id = p.card_id and n.g = p.g where p.g is null or n.g is null or n.n > 1""",
    "outcome_gaps": f"""with {CARDS.strip()}, used as (select distinct card_id, unnest([low_outcome, mid_outcome, high_outcome]) outcome from cards),
   known as (select distinct card_id, unnest(case when card_id % 9 = 0 then ['lower','higher','none'] else ['lower','between','higher'] end) outcome from cards)
   select card_id, outcome, 'undefined' problem from (select * from used except select * from known) union all select card_id, outcome, 'unused' from (select * from known except select * from used)""",
    "orphan_observations": f"with {CARDS.strip()} select distinct l_partkey + l_linenumber * 10 card_id from lineitem where l_partkey + l_linenumber * 10 not in (select card_id from cards)",
    "frequency_problems": f"""with {CARDS.strip()}, f as (select card_id, case when card_id % 11 = 0 then 'N' else low_allele end allele, case when card_id % 13 = 0 then 1.5 else frequency end::double f from cards where frequency is not null
     union all select card_id, case when card_id % 7 = 0 then low_allele else high_allele end, case when card_id % 5 = 0 then frequency + 0.75 else 0.25 end::double from cards where frequency is not null)
   select * from (select card_id, count(*) filter (allele not in ('A','C','G','T')) n_bad_alleles, count(*) filter (not (f between 0 and 1)) n_bad_frequencies, count(*) - count(distinct allele) n_repeated, sum(f) > 1 + 1e-12::double above_one from f group by 1)
   where n_bad_alleles > 0 or n_bad_frequencies > 0 or n_repeated > 0 or above_one""",
    "marker_digest": f"{R}, d as (select distinct chrom, pos_grch37 p from t) select chrom, count(*) n_markers, sha256(string_agg(chrom || ':' || p, chr(10) order by p) || chr(10)) digest from d group by 1",
    "worst_chromosomes": f"""{R}, c as (select chrom, count(*) n_rows, {rate("count(*) filter (call_status <> 'no_call')", 'count(*)')} call_rate from t group by 1)
   select chrom_order, chrom, call_rate, n_rows from c join {ORDER} using (chrom) where n_rows >= 20 and call_rate < 0.99 order by chrom_order limit 6""",
    "privacy_scan": "select doc_id, " + ", ".join(f"coalesce(len(regexp_extract_all(text, $r${p}$r$)), 0)::bigint n_{n}" for n, p in LEAKS.items()) + " from documents",
    "privacy_shapes": f"{R}{NOTES} select shape, " + ", ".join(f"sum(len(regexp_extract_all(note, $r${p}$r$)))::bigint n_{n}" for n, p in LEAKS.items()) + " from notes group by 1",
    "privacy_spans": f"{R}{NOTES}, found as ("
    + " union all ".join(f"select shape, '{n}' pattern, note, unnest(regexp_extract_all(note, $r${p}$r$)) hit from notes" for n, p in LEAKS.items())
    + """), placed as (select *, strpos(note, hit) - 1 as place from found)
   select shape, pattern, count(*) n_hits, sum(place)::bigint sum_start, sum(place + length(hit))::bigint sum_end from placed group by 1, 2""",
    "array_markers": f"{R} select distinct t.chrom, pos_grch37, chrom_order from t join {ORDER} on t.chrom = d.chrom where chrom_order < 22",
}
