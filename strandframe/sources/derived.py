"""Genotype, card, anchor, merge and panel tables derived from the star-schema tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What orders rows of the derived export: no single column is unique.
SOURCE_ORDER = ["o", "n", "p", "s", "q", "e"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rsid, chrom, pos, a1 and a2 as strings, in the numeric layout, with the SOURCE_ORDER columns."""
    base = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey o", "l_linenumber n", "l_partkey p", "l_suppkey s", "cast(l_quantity as bigint) q", "cast(round(l_extendedprice * 100) as bigint) e"
    )
    return base.withColumn("code", F.expr("1 + (p * 31 + n * 7 + o) % 26")).selectExpr(
        "concat('rs', cast(900000000 + o * 8 + n as string)) rsid",
        "cast(code as string) chrom",
        "cast(1 + (o * 7919 + s * 104729 + n * 1299709) % 16569 as string) pos",
        "case when e % 97 = 0 then '0' when e % 61 = 0 then 'I' else substr('ACGT', cast(1 + p % 4 as int), 1) end a1",
        "case when e % 97 = 0 then '0' when e % 61 = 0 then 'D' when code in (23, 24, 26) then substr('ACGT', cast(1 + p % 4 as int), 1)"
        " else substr('ACGT', cast(1 + (p + case when q % 4 = 0 then 2 else 0 end) % 4 as int), 1) end a2",
        *SOURCE_ORDER,
    )


def damaged_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export with every kind of bad row in it."""
    raw = raw_export(spark, sf_dir)
    return raw.selectExpr(
        "case when e % 211 = 0 then null else rsid end rsid",
        "case when e % 223 = 0 then '77' else chrom end chrom",
        "case when e % 227 = 0 then '12x' when e % 229 = 0 then '0' when e % 233 = 0 then '4000000000' else pos end pos",
        "case when e % 239 = 0 then 'N' when e % 241 = 0 then '0' else a1 end a1",
        "a2",
        *SOURCE_ORDER,
    )


def merged_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rsid and a merged genotype: no call, one letter, two letters or a bad length."""
    return raw_export(spark, sf_dir).selectExpr(
        "rsid", "case when a1 = '0' then '--' when e % 13 = 0 then a1 when e % 89 = 0 then concat(a1, a2, a1) else concat(a1, a2) end genotype"
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card per part: locus, two alleles (each third palindromic), outcomes, evidence and a title."""
    base = table(spark, sf_dir, "part").selectExpr("p_partkey p", "p_size z", "cast(round(p_retailprice * 100) as bigint) r")
    named = base.selectExpr("*", "1 + (p * 7) % 26 code", "substr('ACGT', cast(1 + p % 4 as int), 1) x", "substr('ACGT', cast(1 + case when p % 3 = 0 then 3 - p % 4 else (p % 4 + 2) % 4 end as int), 1) y")
    return named.selectExpr(
        "p card_id",
        "case when p % 11 = 0 then 'impossibility' else 'interpretation' end kind",
        "concat('rs', cast(900000000 + p * 8 + z % 5 as string)) rsid",
        "case code when 23 then 'X' when 24 then 'Y' when 25 then 'PAR' when 26 then 'MT' else cast(code as string) end chrom",
        "1 + (p * 7919 + z * 104729) % 16569 pos_grch37",
        "least(x, y) low_allele",
        "greatest(x, y) high_allele",
        "'lower' low_outcome",
        "case when p % 5 = 0 then 'higher' else 'between' end mid_outcome",
        "case when p % 13 = 0 then 'lower' else 'higher' end high_outcome",
        "element_at(array('clinical_guideline', 'expert_curated', 'functional', 'gwas', 'candidate_gene', 'anecdotal'), cast(1 + p % 6 as int)) evidence",
        "element_at(array('meta_analysis', 'independent', 'same_cohort', 'none', 'conflicting'), cast(1 + z % 5 as int)) replication",
        "element_at(array('odds_ratio', 'proportion', 'percent_variance_explained', 'beta'), cast(1 + r % 4 as int)) effect_kind",
        "(1 + r % 97) / 100.0D effect_value",
        "case when r % 3 = 0 then (r % 50) / 100.0D end ci_low",
        "case when r % 3 = 0 then (r % 50 + 40) / 100.0D end ci_high",
        "case when z % 4 = 0 then null when z % 4 = 1 then (r % 7) / 1000000.0D else (r % 1000) / 2000.0D end frequency",
        "case when z % 3 = 0 then (r % 101) / 100.0D end quality",
        "case when z % 2 = 0 then (r % 89) / 100.0D end ancestry_match",
        "concat('Card ', cast(r % 1000 as string)) title",
        "concat('section ', cast(p % 13 as string)) section",
    )


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 40th order's first line as build anchor, some at the other build's position."""
    rows = raw_export(spark, sf_dir).where("o % 40 = 0 and n = 1").groupBy("rsid").agg(F.min(F.expr("cast(pos as bigint)")).alias("pos"))
    return rows.selectExpr("rsid", "case when pos % 10 = 0 then pos + 100000 else pos end anchor_37", "pos + case when pos % 10 = 0 then 0 else 5000 end anchor_38")


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(retired_rsid, current_rsid) chains of up to eight links over customers; every 50th chain is a cycle."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey k")
    return c.where("k % 9 <> 8").selectExpr("concat('rs', cast(k as string)) retired_rsid", "concat('rs', cast(case when k % 9 = 7 and (k div 9) % 50 = 0 then k - 7 else k + 1 end as string)) current_rsid")


def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(retired_rsid, status) of every 5th chain's end."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey k").where("k % 9 = 8 and (k div 9) % 5 = 1")
    return c.selectExpr("concat('rs', cast(k as string)) retired_rsid", "case when k % 2 = 0 then 'withdrawn' else 'ambiguous' end status")


def merge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(retired_rsid, targets) with no, one or two targets."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey k")
    return c.selectExpr(
        "concat('rs', cast(k as string)) retired_rsid",
        "case when k % 7 = 0 then cast(array() as array<string>) when k % 5 = 0 then array(concat('rs', cast(k + 1 as string)), concat('rs', cast(k + 2 as string))) else array(concat('rs', cast(k + 1 as string))) end targets",
    )


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(allele_id, rsid, assembly, chrom, pos, gene) of orders, in both builds for most."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey k", "o_custkey c").withColumn("assembly", F.explode(F.array(F.lit("GRCh37"), F.lit("GRCh38"))))
    kept = o.where("not (assembly = 'GRCh38' and k % 6 = 0)")
    return kept.selectExpr(
        "k allele_id",
        "concat('rs', cast(1000 + k - case when k % 17 = 0 then 1 else 0 end as string)) rsid",
        "assembly",
        "cast(1 + case when assembly = 'GRCh38' and k % 19 = 0 then c % 21 + 1 else c % 22 end as string) chrom",
        "1000 + k * 3 + case when assembly = 'GRCh38' and k % 23 <> 0 then 777 else 0 end pos",
        "case when k % 4 = 0 then '-' else concat('GENE', cast(c % 50 as string)) end gene",
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long dosages of 40 samples at a site per supplier; some calls missing, some sites repeated or monomorphic."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey k").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(40).cast("long"))))
    return s.selectExpr(
        "k variant_id",
        "cast(1 + k % 22 as string) chrom",
        "1 + (k * 2377) % 16000 - case when k % 29 = 0 then (k * 2377) % 16000 else 0 end pos_grch37",
        "substr('ACGT', cast(1 + k % 4 as int), 1) ref",
        "substr('ACGT', cast(1 + (k % 4 + 1 + k % 3) % 4 as int), 1) alt",
        "i sample_id",
        "case when (k * 37 + i * 11) % 53 = 0 and k % 3 = 0 then null when k % 31 = 0 then 0 else ((k * 13 + i * i * (1 + k % 5) + i * 7) % 97) % 3 end dosage",
    )


def panel_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant_id, frequency, component, weight): two components with small rational weights."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey k").withColumn("component", F.explode(F.array(F.lit(1), F.lit(2))))
    return s.selectExpr("k variant_id", "(1 + k % 99) / 100.0D frequency", "component", "((k * component) % 41 - 20) / 20.0D weight")


def genotype_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shape, note): raw rows written in eight ways, six of them with a genotype."""
    return raw_export(spark, sf_dir).selectExpr(
        "o % 8 shape",
        r"""case o % 8 when 0 then concat(rsid, chr(9), chrom, chr(9), pos, chr(9), a1, chr(9), a2) when 1 then concat('ü ', chr(10), rsid, ' ', chrom, ' ', pos, ' ', a1, a2)
        when 2 then concat('row "', rsid, chr(92), 't', chrom, chr(92), 't', pos, chr(92), 't', a1, chr(92), 't', a2, '"') when 3 then concat('| ', rsid, ' | ', chrom, ' | ', pos, ' | ', a1, ' |')
        when 4 then concat('my ', rsid, ' = "', a1, '/', a2, '" call') when 5 then concat('Row(rsid=', chr(39), rsid, chr(39), ', pos=', pos, ', a1=', chr(39), a1, chr(39), ')')
        when 6 then concat('see ', rsid, ' at ', pos) else concat('x', rsid, ': ', a1, a2) end note""",
    )


def declared_genotypes(pairs: DataFrame) -> DataFrame:
    """(card_id, genotype) maps as packs write them: some lack a genotype, have one twice or one of other alleles."""
    het = "substr(genotype, 1, 1) <> substr(genotype, 2, 1)"
    kept = pairs.where(f"not (card_id % 17 = 0 and {het})").selectExpr("card_id", "concat(' ', lower(genotype)) genotype")
    twice = pairs.where(f"card_id % 19 = 0 and {het}").selectExpr("card_id", "reverse(genotype) genotype")
    other = pairs.where("card_id % 23 = 0").selectExpr("card_id", "'QQ' genotype").distinct()
    return kept.unionByName(twice).unionByName(other)


def damaged_frequencies(cards: DataFrame) -> DataFrame:
    """(card_id, allele, frequency) of cards with a frequency; some alleles, numbers and totals are wrong."""
    return cards.where("frequency is not null").selectExpr(
        "card_id",
        "inline(array(struct(case when card_id % 11 = 0 then 'N' else low_allele end as allele, case when card_id % 13 = 0 then 1.5D else frequency end as frequency),"
        " struct(case when card_id % 7 = 0 then low_allele else high_allele end as allele, case when card_id % 5 = 0 then frequency + 0.75D else 0.25D end as frequency)))",
    )


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cards() with genes, citations, genotype maps and templates; some templates are broken in each way that there is."""
    good = "'You have {genotype} at {rsid}.', '{gene}: {effect_value}{effect_units} of {sample_size}', '{{kept}} at {chrom}:{pos}', 'Now {rsid_current}, {confidence}'"
    bad = "'Open {genotype', 'Alone } here', 'Wide {pos:>10}', 'Which {}', 'Who {nobody}', '  '"

    def text(k: int) -> str:
        return f"case when (card_id + {k}) % 10 = 0 then element_at(array({bad}), cast(1 + (card_id div 10 + {k}) % 6 as int)) else element_at(array({good}), cast(1 + (card_id + {k}) % 4 as int)) end"

    def outcome(k: int) -> str:
        return f"struct({text(k)} as summary, {text(k + 1)} as detail)"

    return cards(spark, sf_dir).selectExpr(
        "*",
        "case when card_id % 6 <> 0 then concat('GENE', cast(card_id % 50 as string)) end gene",
        "case when card_id % 4 = 0 then '%' end effect_units",
        "card_id * 37 % 5000 sample_size",
        "case when card_id % 14 = 0 then cast(array() as array<string>) else array(concat('doi:', cast(card_id as string))) end citations",
        "map(concat(low_allele, low_allele), low_outcome, concat(low_allele, high_allele), mid_outcome, concat(high_allele, high_allele), high_outcome) genotypes",
        f"map_filter(map('lower', {outcome(1)}, 'between', {outcome(3)}, 'higher', {outcome(5)}), (k, v) -> not (card_id % 9 = 0 and k = 'between')) outcomes",
        "case when kind = 'impossibility' and card_id % 2 = 0 then 'Nothing about {gene} can be told.' when kind = 'impossibility' then '{genotype} of {gene}' end summary",
        "case when kind = 'impossibility' and card_id % 3 > 0 then 'Arrays do not see {{this}}.' end detail",
        "case when frequency is null then cast(array() as array<struct<allele: string, frequency: double>>) when card_id % 8 = 0 then array(struct(low_allele as allele, frequency))"
        " else array(struct(low_allele as allele, frequency), struct(high_allele as allele, 1.0D - frequency as frequency)) end frequencies",
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(citation_id, type, id, title, database) of parts: five types and an unknown one, some identifiers, titles and databases odd."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey p").selectExpr(
        "p citation_id",
        "case when p % 29 = 0 then null else element_at(array('doi', ' PMID', 'pmcid', 'accession', 'url', 'book'), cast(1 + p % 6 as int)) end type",
        "case p % 6 when 0 then concat(case when p % 4 = 0 then 'https://DOI.org/' when p % 4 = 2 then 'doi:' else '' end, '10.', cast(1000 + p % 9000 as string), '/x.', cast(p as string), case when p % 8 = 0 then ' y' else '' end)"
        " when 1 then cast(p - p % 7 as string) when 2 then concat(case when p % 5 = 0 then 'PMC' else 'pmc' end, cast(p as string)) when 3 then concat('rs', cast(p as string))"
        " when 4 then concat(case when p % 8 = 4 then 'javascript:' else 'https://' end, 'a.org/', cast(p as string)) else 'b' end id",
        "case when p % 31 = 0 then '  ' else concat('Title ', cast(p as string)) end title",
        "case when p % 6 = 3 and p % 5 > 0 then element_at(array('dbSNP', 'PGS-Catalog', 'Clin Var', 'nowhere'), cast(1 + p % 4 as int)) when p % 37 = 0 then 'dbSNP' end database",
    )


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per supplier with component columns that are neither in order nor numbered without gaps."""
    return table(spark, sf_dir, "supplier").selectExpr("concat('S', cast(s_suppkey as string)) IID", "2 * s_suppkey ALLELE_CT", "s_suppkey / 8.0D PC10_AVG", "-s_suppkey / 4.0D SCORE2_SUM", "0.5D PC2_X", "s_nationkey / 2.0D PC1_AVG")
