"""Secrets in every version of every text, scanned once a content and rule version.

The ledger says which rule versions were applied to which content (a blob, addressed by its
SHA-256), and what each of them found. A run hashes all texts, scans only the pairs of blob and
rule version that the ledger lacks, and joins the findings of the rules now in force back to all
paths that hold a blob. Column expressions only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern; of them, those with least characters after what head matches, if there is a head."""

    kind: str
    version: int
    pattern: str
    head: str = ""
    least: int = 0

    @property
    def key(self) -> str:
        """What the ledger knows the rule by: its kind, version and content."""
        content = hashlib.sha256("\0".join((self.pattern, self.head, str(self.least))).encode()).hexdigest()
        return f"{self.kind}@{self.version}@{content[:16]}"


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""

#: The base kinds, in the order in which spans with the same start are listed.
BASE = (
    Rule("assign", 1, _ASSIGN + "[A-Za-z0-9+/_.=-]+", f"^{_ASSIGN}", 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
#: Kinds that the base leaves out.
MORE = (
    Rule("private_key", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host_token", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("signed_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

_LEDGER = "blob string, rules array<string>, findings array<struct<rule:string,start:int,end:int>>"
_FINDINGS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _matches(rule: Rule, found: str) -> Column:
    """For each match of a rule (column found) in column text: its number, the characters before it since the last one, its own, and whether it counts."""
    pieces = F.arrays_zip(F.col(found).alias("m"), F.slice(F.split("text", rule.pattern, -1), F.lit(1), F.size(found)).alias("p"))

    def each(x: Column, i: Column) -> Column:
        good = F.length(F.regexp_replace(x["m"], rule.head, "")) >= rule.least if rule.head else F.lit(True)
        return F.struct(F.lit(rule.key).alias("rule"), i.alias("k"), F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("size"), good.alias("good"))

    none = F.array().cast("array<struct<rule:string,k:int,gap:int,size:int,good:boolean>>")
    return F.when(F.size(found) > 0, F.transform(pieces, each)).otherwise(none)


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, findings for those of the blobs (blob, text; each once) with any. Positions are code points.

    A match starts where the lengths of all pieces and matches before it end: a running sum over the rows of a blob's matches.
    """
    found = [F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias(f"m{k}") for k, r in enumerate(rules)]
    # The numbers keep the optimizer from searching a text a second time for a filter on the matches.
    rows = blobs.select("blob", "text", *found, F.monotonically_increasing_id().alias("number"))
    rows = rows.select("blob", F.explode(F.concat(*(_matches(r, f"m{k}") for k, r in enumerate(rules)))).alias("x"), "number").select("blob", "x.*").repartition("blob")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "rule").orderBy("k")).cast("int")
    rows = rows.withColumn("end", end).filter("good").select("blob", F.struct("rule", (F.col("end") - F.col("size")).alias("start"), "end").alias("x"))
    return rows.groupBy("blob").agg(F.collect_list("x").alias("findings"))


def _ledger(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _scan_new(rows: DataFrame, place: str, blobs: DataFrame, ledger: DataFrame | None, path: str, rules: tuple[Rule, ...]) -> None:
    """Scans the blobs (blob, at: the place of one row that holds it) for the rules not yet applied to them, and adds the results to the ledger.

    Blobs with the same rules to apply are scanned in one pass, in the rows that hold them, which the tasks know by a bit each.
    """
    keys = [r.key for r in rules]
    if ledger is None:
        todo = blobs.withColumn("due", F.array(*map(F.lit, keys)))
    else:
        known = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("known"))
        due = F.array_except(F.array(*map(F.lit, keys)), F.coalesce("known", F.array().cast("array<string>")))
        todo = blobs.join(known, "blob", "left").withColumn("due", due).drop("known")
    todo = C.materialize(todo, "todo")
    # The sets of rules due are few: one for each set of versions that was ever in force.
    for due in [r["due"] for r in todo.filter(F.size("due") > 0).select("due").distinct().collect()]:
        wanted = todo.filter(F.col("due") == F.array(*map(F.lit, due))).select("blob", "at")
        own = tuple(r for r in rules if r.key in due)
        found = scan(C.at_places(rows, place, wanted.select("at"), True).select("blob", "text"), own)
        done = wanted.select("blob", F.array(*map(F.lit, due)).alias("rules"), F.array().cast("array<struct<rule:string,start:int,end:int>>").alias("findings"))
        done.unionByName(found.select("blob", F.array().cast("array<string>").alias("rules"), "findings")).write.mode("append").parquet(path)


def scan_history(versions: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "path", text_col: str = "text", scan: bool = False) -> DataFrame:
    """path, blob, findings (ordered by start, then by the rule's place in rules) for every row of versions.

    Rows are versions of the texts at paths, as many as there were, repeated ones too; null counts as empty; further
    columns are not read; an empty table has no rows. The ledger at ledger_path, a Parquet folder in a shared store, is made or
    extended; without a path it lasts for this run. Findings of rules or versions that are not in rules stay in the
    ledger and are not returned. scan as in common.placed.
    """
    spark = versions.sparkSession
    rows, place = C.placed(versions, scan)
    text = F.coalesce(C.quoted(text_col).cast("string"), F.lit(""))
    rows = rows.select(C.quoted(path_col).alias("path"), F.col(place).alias("place"), text.alias("text"), F.sha2(F.encode(text, "UTF-8"), 256).alias("blob"))
    at = C.materialize(rows.select("path", "blob", "place"), "paths")
    path = ledger_path or C.scratch_path(spark, "ledger")
    blobs = at.groupBy("blob").agg(F.min("place").alias("at"))
    _scan_new(rows, "place", blobs, _ledger(spark, path), path, rules)

    keys = F.array(*(F.lit(r.key) for r in rules))

    def named(x: Column) -> Column:
        rank = (F.array_position(keys, x["rule"]) - 1).cast("int")
        return F.struct(x["start"].alias("start"), rank.alias("rank"), F.substring_index(x["rule"], "@", 1).alias("kind"), x["end"].alias("end"))

    ledger = _ledger(spark, path)
    if ledger is None:  # nothing was ever scanned
        return at.select("path", "blob", F.array().cast(_FINDINGS).alias("findings"))
    hits = ledger.select("blob", F.filter("findings", lambda x: F.array_contains(keys, x["rule"])).alias("findings")).filter(F.size("findings") > 0)
    hits = hits.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("all"))
    hits = hits.select("blob", F.array_sort(F.transform("all", named)).alias("findings"))
    out = C.join_salted(at.select("path", "blob"), hits, "blob", at.count(), "left")
    return out.select("path", "blob", F.coalesce("findings", F.array().cast(_FINDINGS)).alias("findings"))


def listed(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
