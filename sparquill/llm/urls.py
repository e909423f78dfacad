"""Allow and block rules on URLs: a trie over reversed host labels and path segments.

A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with
the rule's path. Of the fitting rules the longest wins: the one with most host labels, then the
longest path; of equal rules, block wins.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

#: Rules up to this size are compiled into a trie and broadcast; more are joined.
MAX_BROADCAST_BYTES = 32_000_000

Rule = tuple[str, str, str]


@dataclass
class _Node:
    labels: dict[str, _Node] = field(default_factory=dict)
    paths: _Node | None = None
    segments: dict[str, _Node] = field(default_factory=dict)
    #: Rules by the last, unfinished segment of their path.
    tails: dict[str, int] = field(default_factory=dict)


class UrlTrie:
    def __init__(self, rules: list[Rule]) -> None:
        self.rules = sorted(rules)
        self.root = _Node()
        for number, (host, path, verdict) in enumerate(self.rules):
            node = self.root
            for label in reversed(host.split(".")):
                node = node.labels.setdefault(label, _Node())
            node.paths = node.paths or _Node()
            node = node.paths
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, _Node())
            if tail not in node.tails or verdict == "block":
                node.tails[tail] = number

    def find(self, host: str, path: str) -> int:
        """The number of the rule that wins, or -1."""
        best, node = -1, self.root
        for label in reversed(host.split(".")):
            if node.paths is not None and node is not self.root:
                best = self._path(node.paths, path, best)
            node = node.labels.get(label)
            if node is None:
                return best
        return best if node.paths is None else self._path(node.paths, path, best)

    @staticmethod
    def _path(node: _Node, path: str, best: int) -> int:
        at = 0
        while node is not None:
            if node.tails:
                fits = [t for t in node.tails if path.startswith(t, at)]
                if fits:
                    best = node.tails[max(fits, key=len)]
            end = path.find("/", at)
            if end < 0:
                return best
            node, at = node.segments.get(path[at:end]), end + 1
        return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) after the first :// and the path up to ? or #; both empty for null or without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(text, pattern, 2)


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (host and path of the winning rule, else null), verdict (its, else default) for every row.

    Hosts of rules are lower-cased as those of urls are.
    A null, empty or scheme-less url has an empty host and path, which no rule fits; a very long one is judged whole. Repeated rows and null
    ids are judged each, an empty table has no rows, and further columns are not read.
    """
    rules = [(h.translate(_LOWER), p, v) for h, p, v in rules]
    host, path = host_and_path(C.quoted(url_col))
    rows = pages.select(C.quoted(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if sum(len(h) + len(p) + 200 for h, p, _ in rules) > MAX_BROADCAST_BYTES:
        found = _by_join(rows, rules)
    else:
        trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

        @F.pandas_udf("rule string, own string")
        def find(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
            table = trie.value
            numbers = [table.find(h, p) for h, p in zip(hosts, paths, strict=True)]
            return pd.DataFrame({"rule": ["".join(table.rules[n][:2]) if n >= 0 else None for n in numbers], "own": [table.rules[n][2] if n >= 0 else None for n in numbers]})

        found = rows.withColumn("found", find("host", "path")).select("page_id", "host", "path", "found.rule", "found.own")
    return found.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit(default)).alias("verdict"))


def _by_join(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """The same for rules of any number: each distinct host and path meets the rules by its host suffixes and path prefixes."""
    spark = rows.sparkSession
    table = spark.createDataFrame(rules, "rh string, rp string, own string").groupBy("rh", "rp").agg(F.max("own").alias("own"))
    lengths = sorted({len(p) for _, p, _ in rules})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    prefixes = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length("path"))
    keys = rows.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("rh"), prefixes.alias("n"))
    keys = keys.select("host", "path", "rh", F.explode("n").alias("n")).withColumn("rp", F.substring(F.col("path"), F.lit(1), F.col("n")))
    rank = F.struct(F.size(F.split("rh", r"\.")), "n")
    best = keys.join(table, ["rh", "rp"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rh", "rp").alias("rule"), "own"), rank).alias("b"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", "b.rule", "b.own")
