"""Knowledge packs: template values, pairing of cards with results, displayed texts, lint and stored payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import complement
from ..functions.templates import problems, render

# What a template of a matched card may name, and what one of an impossible card may.
TEMPLATE_NAMES = ("genotype", "rsid", "rsid_current", "gene", "chrom", "pos", "effect_value", "effect_units", "sample_size", "confidence")
IMPOSSIBLE_NAMES = ("gene",)
# Issue codes of the variant cross-check's states.
VARIANT_ISSUES = {"unresolved": "variant-unresolved", "coordinate-mismatch": "variant-coordinate-mismatch", "rsid-mismatch": "variant-rsid-mismatch", "allele-mismatch": "variant-allele-mismatch"}
#: What a card without a finding says instead.
REASONS = {
    "marker_absent": "The array has no probe at this position.",
    "duplicate_conflict": "Probes at this position disagree.",
    "no_call": "The probe gave no call.",
    "indel_excluded": "Insertions and deletions are not interpreted.",
    "het_haploid": "Two alleles were read where one is expected.",
    "allele_mismatch": "The alleles read are not the card's.",
    "strand_ambiguous": "Both strands fit and lead to different outcomes.",
    "not_determinable": "This can't be told from an array.",
}
PAYLOAD_VERSION = 1


def known_names(kind: Column, gene: Column) -> Column:
    """The placeholders that a card can fill in: an impossible one has no match, and no card a gene that it doesn't declare."""
    listed = F.when(kind == "impossibility", F.array(*map(F.lit, IMPOSSIBLE_NAMES))).otherwise(F.array(*map(F.lit, TEMPLATE_NAMES)))
    return F.when(gene.isNull(), F.array_remove(listed, "gene")).otherwise(listed)


def template_values(**columns: Column) -> Column:
    """A map of names to texts; nulls are left out, so that a template that names one isn't rendered."""
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), c.cast("string").alias("value")) for n, c in columns.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def oriented(genotype: Column, strand: Column) -> Column:
    """The genotype as the card is written, where the strand is known."""
    return F.when(strand == "as_written", genotype).when(strand == "complemented", complement(genotype))


def pairing_problems(cards: DataFrame, matches: DataFrame, observations: DataFrame) -> DataFrame:
    """(card_id, problem): cards without exactly one match, interpretations without exactly one observation, and what belongs to no card."""
    joined = _paired(cards.select("card_id", "kind"), matches, observations)
    return joined.select("card_id", _problem().alias("problem")).where("problem is not null")


def _paired(cards: DataFrame, matches: DataFrame, observations: DataFrame) -> DataFrame:
    counts = [f.groupBy("card_id").agg(F.count("*").alias(f"__{n}")) for f, n in ((matches, "matches"), (observations, "observations"), (cards, "cards"))]
    return cards.withColumn("__card", F.lit(True)).join(counts[2], "card_id", "left").join(counts[0], "card_id", "full").join(counts[1], "card_id", "full")


def _problem() -> Column:
    seen = F.coalesce("__observations", F.lit(0))
    return (
        F.when(F.col("__card").isNull() & F.col("__matches").isNotNull(), "unknown_match")
        .when(F.col("__card").isNull(), "unknown_observation")
        .when(F.col("__cards") > 1, "repeated_card")
        .when(F.col("__matches").isNull(), "missing_match")
        .when(F.col("__matches") > 1, "repeated_match")
        .when((F.col("kind") == "impossibility") & (seen > 0), "observed_impossibility")
        .when((F.col("kind") == "interpretation") & (seen == 0), "missing_observation")
        .when(seen > 1, "repeated_observation")
    )


def paired(cards: DataFrame, matches: DataFrame, observations: DataFrame) -> DataFrame:
    """Cards with the columns of their match and observation; fails, naming the card, where pairing_problems() finds one.

    A card that is lost on the way would otherwise vanish without a word.
    """
    whole = _paired(cards, matches.select("card_id"), observations.select("card_id"))
    fault = F.raise_error(F.concat(F.lit("card "), F.coalesce(F.col("card_id").cast("string"), F.lit("?")), F.lit(": "), _problem())).cast("boolean")
    sound = whole.where(F.when(_problem().isNotNull(), fault).otherwise(True)).select(*cards.columns)
    own = [c for c in matches.columns if c == "card_id" or c not in cards.columns]
    seen = [c for c in observations.columns if c == "card_id" or c not in (*cards.columns, *own)]
    return sound.join(matches.select(*own), "card_id", "left").join(observations.select(*seen), "card_id", "left")


def strand_frequency(matched: DataFrame) -> DataFrame:
    """Add `rarest` (allele, frequency) of the called alleles, and `unpriced`, those of them that have no frequency, if any.

    Reads status, strand, genotype (as observed) and frequencies, an array of (allele, frequency), besides low and
    high allele. At a site that reads alike from both strands the complemented alleles count as called, too. A
    frequency of an allele that the card doesn't declare fails the query. Only matched cards with frequencies have either.
    """
    g = F.col("genotype")
    letters = lambda x: F.array_distinct(F.split(x, ""))
    read = F.when(F.col("strand") == "ambiguous", F.array_union(letters(g), letters(complement(g)))).otherwise(letters(oriented(g, F.col("strand"))))
    priced = F.when((F.col("status") == "matched") & (F.size("frequencies") > 0), F.array_sort(read))
    stranger = F.exists("frequencies", lambda f: ~f["allele"].isin(F.col("low_allele"), F.col("high_allele")))
    fault = F.raise_error(F.concat(F.lit("a frequency of card "), F.col("card_id").cast("string"), F.lit(" has an allele that it doesn't declare")))
    checked = matched.withColumn("__called", F.when(F.coalesce(stranger, F.lit(False)), fault.cast("array<string>")).otherwise(priced))
    known = F.transform("frequencies", lambda f: f["allele"])
    called = F.filter("frequencies", lambda f: F.array_contains("__called", f["allele"]))
    least = F.array_min(F.transform(called, lambda f: F.struct(f["frequency"].alias("frequency"), f["allele"].alias("allele"))))
    missing = checked.withColumn("unpriced", F.array_except("__called", known))
    return missing.withColumn("rarest", F.when(F.size("unpriced") == 0, least)).drop("__called")


def shown_texts(assembled: DataFrame) -> DataFrame:
    """Add summary, detail and caveats, as a card shows them.

    A matched card fills in its outcome's templates, an impossible one its own; others give the reason. Reads the columns of
    a pack and of strand_frequency(), and final_tier.
    """
    impossible, matched = F.col("kind") == "impossibility", F.col("status") == "matched"
    values = F.when(impossible, template_values(gene=F.coalesce("gene", F.lit("")))).otherwise(
        template_values(
            genotype=F.coalesce(oriented(F.col("genotype"), F.col("strand")), "genotype", F.lit("unresolved")), rsid=F.coalesce("observed_rsid", "rsid"), rsid_current=F.col("rsid"),
            gene=F.coalesce("gene", F.lit("")), chrom=F.col("chrom"), pos=F.col("pos_grch37"), effect_value=F.col("effect_value"), effect_units=F.coalesce("effect_units", F.lit("")),
            sample_size=F.col("sample_size"), confidence=F.col("final_tier"),
        )
    )
    reason = F.try_element_at(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair]), F.col("status"))
    of = lambda part: F.when(impossible, F.col(part)).otherwise(F.try_element_at("outcomes", F.col("outcome"))[part])
    text = lambda part: F.when(impossible | matched, render(of(part), values)).otherwise(reason)
    unpriced = F.concat(F.lit("No frequency is known of "), F.array_join("unpriced", ", "), F.lit(", so rarity could not be checked and confidence is capped."))
    caveats = F.when(matched & (F.size("unpriced") > 0), F.array(unpriced)).otherwise(F.array().cast("array<string>"))
    return assembled.withColumns({"shown_summary": text("summary"), "shown_detail": text("detail"), "caveats": caveats})


def rendered_outcomes(pack: DataFrame) -> DataFrame:
    """(card_id, genotype, outcome, part, text): each template of each genotype's outcome, filled in with stand-in values; null text where it can't be."""
    named = pack.where("kind = 'interpretation'").withColumn("values", F.map_concat(_stand_ins(), F.create_map(F.lit("genotype"), F.lit(""))))
    each = named.select("card_id", "outcomes", "values", F.explode("genotypes").alias("genotype", "outcome"))
    filled = F.map_zip_with("values", F.create_map(F.lit("genotype"), F.col("genotype")), lambda k, a, b: F.coalesce(b, a))
    both = each.withColumn("values", filled).withColumn("o", F.try_element_at("outcomes", F.col("outcome"))).where("o is not null")
    parts = both.select("card_id", "genotype", "outcome", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), render(F.col(f"o.{p}"), F.col("values")).alias("text")) for p in ("summary", "detail")])).alias("p"))
    return parts.select("card_id", "genotype", "outcome", "p.part", "p.text")


def _stand_ins() -> Column:
    return template_values(
        rsid=F.col("rsid"), rsid_current=F.col("rsid"), gene=F.col("gene"), chrom=F.col("chrom"), pos=F.col("pos_grch37"), effect_value=F.col("effect_value"),
        effect_units=F.coalesce("effect_units", F.lit("")), sample_size=F.col("sample_size"), confidence=F.lit("well-established"),
    )


def lint(pack: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """(card_id, code, place, detail): everything that is wrong with a pack, in one pass over its cards.

    Every rule gives an array of issues of its own, so none hides another. `states` are the cards' states in the
    reference (card_id, state), as cross_check() has them; without them each interpretation has the issue
    variant-index-unavailable.
    """
    issue = "array<struct<code: string, place: string, detail: string>>"
    none, interpretation = F.array().cast(issue), F.col("kind") == "interpretation"
    one = lambda code, place=None, detail=None: F.array(F.struct(code.alias("code") if isinstance(code, Column) else F.lit(code).alias("code"), F.lit(place).alias("place"), F.lit(detail).alias("detail"))).cast(issue)
    names = known_names(F.col("kind"), F.col("gene"))

    def placed(template: Column, place: Column) -> Column:
        return F.transform(problems(template, names), lambda p: F.struct(p["code"].alias("code"), place.alias("place"), p["detail"].alias("detail"))).cast(issue)

    def of_outcome(entry: Column) -> Column:
        return F.concat(*[placed(entry["value"][part], F.concat(entry["key"], F.lit(f".{part}"))) for part in ("summary", "detail")])

    undefined = F.filter(F.map_entries("genotypes"), lambda g: ~F.coalesce(F.array_contains(F.map_keys("outcomes"), g["value"]), F.lit(False)))
    rules = [
        F.when(interpretation & (F.coalesce(F.size("citations"), F.lit(0)) <= 0), one("citation-missing")).otherwise(none),
        F.when(interpretation & (F.col("genotypes").isNull() | (F.size("genotypes") == 0)), one("match-missing")).otherwise(none),
        F.when(interpretation & F.col("genotypes").isNotNull(), F.transform(undefined, lambda g: F.struct(F.lit("outcome-unresolved").alias("code"), g["key"].alias("place"), g["value"].alias("detail"))).cast(issue)).otherwise(none),
        F.when(interpretation & F.col("outcomes").isNotNull(), F.flatten(F.transform(F.map_entries("outcomes"), of_outcome))).otherwise(none),
        F.when(~interpretation, F.concat(placed(F.col("summary"), F.lit("summary")), placed(F.col("detail"), F.lit("detail")))).otherwise(none),
    ]
    if states is None:
        rules.append(F.when(interpretation, one("variant-index-unavailable")).otherwise(none))
    else:
        pack = pack.join(states.select("card_id", F.col("state").alias("__state")), "card_id", "left")
        code = F.try_element_at(F.create_map(*[F.lit(x) for pair in VARIANT_ISSUES.items() for x in pair]), F.coalesce("__state", F.lit("unresolved")))
        rules.append(F.when(interpretation & code.isNotNull(), one(code)).otherwise(none))
    return pack.select("card_id", F.explode(F.concat(*rules)).alias("issue")).select("card_id", "issue.*")


def payload(assembled: DataFrame) -> DataFrame:
    """(card_id, payload): what a run stores of each card, as JSON of a fixed form; a number that JSON can't hold fails the query."""
    interpretation, matched = F.col("kind") == "interpretation", F.col("status") == "matched"

    def number(name: str) -> Column:
        value = F.col(name).cast("double")
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.lit(f"{name} is not a number that JSON holds")).cast("double")).otherwise(value)

    fields = {
        "format_version": F.lit(PAYLOAD_VERSION),
        "card_id": F.col("card_id").cast("string"),
        **{c: F.col(c) for c in ("section", "kind", "title", "gene", "status")},
        "summary": F.col("shown_summary"),
        "detail": F.col("shown_detail"),
        "variant": F.when(interpretation, F.struct("rsid", "chrom", "pos_grch37", F.array("low_allele", "high_allele").alias("alleles"))),
        "match": F.struct(oriented(F.col("genotype"), F.col("strand")).alias("genotype"), F.col("genotype").alias("observed_genotype"), "observed_rsid", "strand", F.col("outcome").alias("outcome_name")),
        "confidence": F.when(matched, F.struct(number("score").alias("score"), F.col("final_tier").alias("tier"))),
        "observation": F.when(interpretation, F.struct("call_source", number("quality").alias("imputation_quality"), number("ancestry_match").alias("ancestry_match"))),
        "frequencies": F.col("frequencies"),
        "confidence_frequency": F.col("rarest"),
        "citations": F.col("citations"),
        "computed_caveats": F.col("caveats"),
    }
    return assembled.select("card_id", F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"}).alias("payload"))


#: The form of a stored payload, by version.
PAYLOADS = {
    1: "format_version int, card_id string, section string, kind string, title string, gene string, status string, summary string, detail string,"
    " variant struct<rsid: string, chrom: string, pos_grch37: bigint, alleles: array<string>>,"
    " match struct<genotype: string, observed_genotype: string, observed_rsid: string, strand: string, outcome_name: string>,"
    " confidence struct<score: double, tier: string>, observation struct<call_source: string, imputation_quality: double, ancestry_match: double>,"
    " frequencies array<struct<allele: string, frequency: double>>, confidence_frequency struct<frequency: double, allele: string>, citations array<string>, computed_caveats array<string>",
}


def read_payload(stored: DataFrame) -> DataFrame:
    """Stored payloads as columns again; other versions and JSON of another form fail the query."""
    version = F.get_json_object("payload", "$.format_version").cast("int")
    fault = F.raise_error(F.concat(F.lit("payload version "), F.coalesce(version.cast("string"), F.lit("none")), F.lit(" is not supported")))
    known = F.when(F.coalesce(version.isin(*PAYLOADS), F.lit(False)), F.col("payload")).otherwise(fault.cast("string"))
    return stored.select(F.from_json(known, PAYLOADS[PAYLOAD_VERSION], {"mode": "FAILFAST"}).alias("p")).select("p.*")
