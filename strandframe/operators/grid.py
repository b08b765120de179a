"""Grouped, filtered and sorted views of a run's cards."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import dimension
from .confidence import TIERS

GROUPS, SORTS = ("section", "tier"), ("tier", "section", "title")


@dataclass(frozen=True)
class GridQuery:
    group: str = "section"
    sort: str = "tier"
    tiers: tuple[str, ...] = ()
    sections: tuple[str, ...] = ()
    interpreted_only: bool = False
    ignored: tuple[str, ...] = field(default=(), compare=False)


def parse_query(pairs: list[tuple[str, str]], sections: tuple[str, ...]) -> GridQuery:
    """A query from key-value pairs; unknown ones are named in `ignored`, the last of a repeated single value counts."""
    single, many, ignored = {}, {"tier": [], "section": []}, []
    allowed = {"group": GROUPS, "sort": SORTS, "interpreted": ("1", "0")}
    for key, value in pairs:
        if key in allowed and value in allowed[key]:
            single[key] = value
        elif key in many and value in (TIERS if key == "tier" else sections):
            many[key].append(value)
        else:
            ignored.append(f"{key}={value}")
    return GridQuery(single.get("group", "section"), single.get("sort", "tier"), tuple(dict.fromkeys(many["tier"])), tuple(dict.fromkeys(many["section"])), single.get("interpreted") == "1", tuple(ignored))


def filtered(cards: DataFrame, query: GridQuery) -> DataFrame:
    if query.tiers:
        cards = cards.where(F.coalesce(F.col("tier").isin(*query.tiers), F.lit(False)))
    if query.sections:
        cards = cards.where(F.col("section").isin(*query.sections))
    return cards.where(F.col("interpreted")) if query.interpreted_only else cards


def grid_groups(cards: DataFrame, query: GridQuery, sections: tuple[str, ...]) -> DataFrame:
    """A row per known group in order, then one for each other label that cards have, with total and interpreted before the filter and shown after it; zeros kept.

    Groups by tier end with untiered, unknown labels follow in alphabetical order: a card of a later version
    is shown, not lost.
    """
    key = "section" if query.group == "section" else "tier"
    labels = sections if key == "section" else (*TIERS, "untiered")
    label = F.coalesce(F.col(key), F.lit("untiered")).alias("label")
    before = cards.groupBy(label).agg(F.count("*").alias("total"), F.count_if("interpreted").alias("interpreted"))
    after = filtered(cards, query).groupBy(label).agg(F.count("*").alias("shown"))
    known = dimension(cards.sparkSession, "label", labels)
    # a row a label
    more = before.join(known, "label", "left_anti").select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")) + len(labels) - 1).alias("rank"), "label")
    known = known.unionByName(more)
    return known.join(before, "label", "left").join(after, "label", "left").select("rank", "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "interpreted", "shown")])


def grid_cards(cards: DataFrame, query: GridQuery, sections: tuple[str, ...]) -> DataFrame:
    """The filtered cards in the query's order; those of unknown sections or tiers come last in it."""
    from ..schema import literal_map

    tier_rank = F.coalesce(F.try_element_at(literal_map({t: i for i, t in enumerate(TIERS)}), F.col("tier")), F.lit(len(TIERS)))
    section_rank = F.coalesce(F.try_element_at(literal_map({s: i for i, s in enumerate(sections)}), F.col("section")), F.lit(len(sections)))
    title = F.lower("title")
    order = {"tier": [tier_rank, title, "card_id"], "section": [section_rank, title, "card_id"], "title": [title, "card_id"]}[query.sort]
    return filtered(cards, query).orderBy(*order)
