"""URL filters: a broadcast trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """`verdict` is allow or block. The rule fits `host` with all its subdomains and every path that starts with `path`."""

    verdict: str
    host: str
    path: str = ""

    def __post_init__(self) -> None:
        if self.verdict not in ("allow", "block"):
            raise ValueError(f"verdict must be allow or block, not {self.verdict!r}")
        if not self.host:
            raise ValueError("a rule needs a host")
        object.__setattr__(self, "host", self.host.translate(str.maketrans(UPPER, LOWER)))

    @property
    def text(self) -> str:
        return self.host + self.path


class UrlTrie:
    """Nodes are dicts: host labels from the right, then path segments from the left.

    The last piece of a rule's path is a prefix of a segment, as rules may end inside one. A walk keeps the
    deepest terminal: more host labels first, then the longer path; block wins over allow for an equal rule.
    """

    def __init__(self, rules: Iterable[UrlRule]) -> None:
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault("hosts", {}).setdefault(label, {})
            *full, last = rule.path.split("/")
            node = node.setdefault("path", {})
            for segment in full:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            ends = node.setdefault("ends", {})
            if ends.get(last, (None, "allow"))[1] == "allow":
                ends[last] = (rule.text, rule.verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        node, found = self.root, None
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            found = self._match_path(node.get("path"), path) or found
        return found

    @staticmethod
    def _match_path(node: dict | None, path: str) -> tuple[str, str] | None:
        found = None
        for segment in path.split("/"):
            if node is None:
                break
            fits = [p for p in node.get("ends", ()) if segment.startswith(p)]
            if fits:
                found = node["ends"][max(fits, key=len)]
            node = node.get("segments", {}).get(segment)
        return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a url; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def filter_urls(
    pages: DataFrame,
    rules: Iterable[UrlRule],
    url: str = "url",
    default: str = "allow",
    max_broadcast_chars: int = 16_000_000,
) -> DataFrame:
    """Add host, path, rule and verdict to every row of `pages`; columns of these names are replaced.

    The trie is broadcast while its rules' text is at most `max_broadcast_chars`; a larger rule set is joined
    by (host suffix, path folder) instead, with equal results. Null and malformed urls have empty host and
    path, no rule and the default verdict. Repeated rows are judged one by one; row order is not kept.
    """
    rules = list(rules)
    host, path = host_and_path(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.withColumns({"__host": host, "__path": path}).select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"))
    if sum(len(r.text) for r in rules) <= max_broadcast_chars:
        return _by_trie(parsed, rules, default)
    return _by_join(parsed, rules, default)


def _by_trie(parsed: DataFrame, rules: list[UrlRule], default: str) -> DataFrame:
    shared = parsed.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in batches:
            found = [trie.match(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    return parsed.withColumn("__judged", judge("host", "path")).select(*parsed.columns, "__judged.rule", "__judged.verdict")


def _by_join(parsed: DataFrame, rules: list[UrlRule], default: str) -> DataFrame:
    spark = parsed.sparkSession
    split = [(r.host, r.path.rpartition("/")[0] + r.path.rpartition("/")[1], r.path, r.text, r.verdict) for r in rules]
    right = spark.createDataFrame(split, "r_host string, r_folder string, r_path string, r_rule string, r_verdict string").distinct()
    numbered = parsed.withColumn("__row", F.monotonically_increasing_id())
    distinct = parsed.select("host", "path").distinct()
    labels, folders = F.split("host", r"\."), F.split("path", "/")
    keys = (
        distinct.withColumn("__n", F.explode(F.sequence(F.lit(1), F.size(labels))))
        .withColumn("r_host", F.array_join(F.slice(labels, F.size(labels) - F.col("__n") + 1, F.col("__n")), "."))
        .withColumn("__m", F.explode(F.sequence(F.lit(0), F.size(folders) - 1)))
        .withColumn("r_folder", F.when(F.col("__m") == 0, "").otherwise(F.concat(F.array_join(F.slice(folders, F.lit(1), F.greatest("__m", F.lit(1))), "/"), F.lit("/"))))
    )
    fits = keys.join(right, ["r_host", "r_folder"]).where(F.expr("startswith(path, r_path)"))
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct("__n", F.length("r_path").alias("len"), (F.col("r_verdict") == "block").alias("block"), F.col("r_rule").alias("rule"))).alias("best")
    )
    joined = numbered.join(best, ["host", "path"], "left")
    verdict = F.when(F.col("best").isNull(), F.lit(default)).otherwise(F.when(F.col("best.block"), "block").otherwise("allow"))
    return joined.select(*parsed.columns, F.col("best.rule").alias("rule"), verdict.alias("verdict"))
