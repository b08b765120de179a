"""Text templates with plain {name} placeholders and doubled braces, parsed and filled in by column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A doubled brace, a placeholder, text without braces, or a brace that belongs to neither.
TOKEN = r"\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pieces(template: Column) -> Column:
    """A template as an array of (text, name, stray): literal text, a placeholder's name, or a brace without its partner; null for null."""

    def piece(token: Column) -> Column:
        inner = F.when(F.length(token) > 1, F.substring(token, F.lit(2), F.length(token) - 2))
        name = F.when(token.startswith("{") & token.endswith("}") & ~token.isin("{{", "}}"), inner)
        text = F.when(token == "{{", "{").when(token == "}}", "}").when(name.isNull(), token)
        return F.struct(text.alias("text"), name.alias("name"), token.isin("{", "}").alias("stray"))

    return F.transform(F.regexp_extract_all(template, F.lit(TOKEN), F.lit(0)), piece)


def problems(template: Column, known: Column) -> Column:
    """All that is wrong with a template, as an array of (code, detail); `known` are the names that can be filled in."""

    def of(parts: Column) -> Column:
        none = F.array().cast("array<struct<code: string, detail: string>>")
        blank = F.array(F.struct(F.lit("template-empty").alias("code"), F.lit(None).cast("string").alias("detail")))
        stray = F.transform(F.filter(parts, lambda p: p["stray"]), lambda p: F.struct(F.lit("template-malformed").alias("code"), p["text"].alias("detail")))

        def named(p: Column) -> Column:
            code = F.when(p["name"] == "", "placeholder-positional").when(p["name"].rlike("[:!]"), "placeholder-format").when(~F.array_contains(known, p["name"]), "placeholder-unknown")
            return F.struct(code.alias("code"), p["name"].alias("detail"))

        names = F.filter(F.transform(F.filter(parts, lambda p: p["name"].isNotNull()), named), lambda x: x["code"].isNotNull())
        return F.concat(F.when(F.trim(template) == "", blank).otherwise(none), stray.cast("array<struct<code: string, detail: string>>"), names.cast("array<struct<code: string, detail: string>>"))

    missing = F.array(F.struct(F.lit("template-missing").alias("code"), F.lit(None).cast("string").alias("detail")))
    return F.when(template.isNull(), missing).otherwise(bound(pieces(template), of))


def render(template: Column, values: Column) -> Column:
    """A template filled in from the map `values`; null if it is malformed or names something without a value."""

    def of(parts: Column) -> Column:
        filled = F.transform(parts, lambda p: F.when(~p["stray"], F.coalesce(p["text"], F.try_element_at(values, p["name"]))))
        # array_join would skip what has no value
        return F.when(~F.exists(filled, lambda x: x.isNull()), F.array_join(filled, ""))

    return bound(pieces(template), of)
