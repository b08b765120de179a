"""Columns that are computed once a row, however often they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with further columns that later filters and projections read instead of writing out again.

    They are inlined from an array of one struct: the optimizer moves no filter below that and merges no
    projection into it, so that conditions over them stay short enough to be compiled.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
