"""Text expressions: words, word-bag cosine, tags, clean-up, prompts' small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The opening tags of a structured answer (fixed values).
ANSWER_TAGS = ("<problem>", "<gap>", "<key_insight>", "<approach>", "<expected_contributions>")
#: The tags that a full answer has, opened and closed (fixed values).
REQUIRED_TAGS = ("problem", "gap", "core_idea", "implementation_plan", "algorithm_or_system", "training_or_data_recipe", "evaluation_plan", "expected_results", "risks_and_limitations")
#: The tags that a preview shows (fixed values).
PREVIEW_TAGS = ("title", "problem", "approach", "novelty", "experiment")
#: Keywords of the text quality flags (fixed values).
IMPLEMENTATION_TERMS = ("implement", "train", "dataset", "algorithm", "baseline", "metric")
EVALUATION_TERMS = ("evaluate", "baseline", "ablation", "metric", "benchmark")
#: Patterns that hold the references of a rendered prompt, tried in this order (fixed values).
REFERENCE_PATTERNS = (
    r"(?s)Below are \d+ papers.*?\n\n(.*?)\n\nThe researcher has identified",
    r"(?s)Below are \d+ papers.*?\n\n(.*?)\n\nGenerate a structured",
    r"(?s)studying the following area[^\n]*\n\n(.*?)\n\nBased on this",
)


def empty(c: Column) -> Column:
    """Null and empty count alike."""
    return F.coalesce(c, F.lit("")) == ""


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Lower-cased words of letters, digits and underscores in any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))


def counts(tokens: Column) -> Column:
    """A map from each word to its number, for short texts; long ones are better exploded and grouped."""
    distinct = F.array_distinct(tokens)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda w: F.size(F.filter(tokens, lambda x: x == w)).cast("long")))


def bag_cosine(a: Column, b: Column) -> Column:
    """The cosine of two word maps; 0 where either is empty."""
    def total(m: Column) -> Column:
        return F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, x: s + x * x)

    zero = F.lit(0).cast("long")
    dot = F.aggregate(F.map_entries(a), zero, lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), zero))
    norm = F.sqrt(total(a).cast("double")) * F.sqrt(total(b).cast("double"))
    return F.when(norm > 0, dot / norm).otherwise(F.lit(0.0))


def block(c: Column, tag: str) -> Column:
    """The first block of a tag, its inner tags as spaces, stripped; the whole text where there is none."""
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    inner = strip(F.regexp_replace(F.regexp_extract(c, pattern, 1), "<[^>]+>", " "))
    return F.when(F.regexp_like(c, F.lit(pattern)), inner).otherwise(c)


def tag_share(c: Column, tags: tuple[str, ...] = ANSWER_TAGS) -> Column:
    """The share of the tags that a text has."""
    return sum((F.contains(c, F.lit(t)).cast("int") for t in tags), F.lit(0)) / F.lit(float(len(tags)))


def reference_text(prompt: Column, limit: int = 3000) -> Column:
    """The first pattern's group that matches, else the first characters."""
    out = F.when(F.lit(False), F.lit(""))
    for p in REFERENCE_PATTERNS:
        out = out.when(F.regexp_like(prompt, F.lit(p)), F.regexp_extract(prompt, p, 1))
    return out.otherwise(F.left(prompt, F.lit(limit)))


def cut(c: Column, limit: int, keep: int | None = None) -> Column:
    """Texts over limit characters are cut to keep (limit) characters and an ellipsis of three dots."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit if keep is None else keep)), F.lit("..."))).otherwise(c)


def short_text(c: Column, cached: Column, limit: int = 400) -> Column:
    """Texts up to limit unchanged; longer ones by their cached form, else cut to limit with dots; a note for empty ones."""
    body = strip(F.coalesce(c, F.lit("")))
    return F.when(body == "", "(no abstract available)").when(F.length(body) <= limit, body).otherwise(F.coalesce(cached, cut(body, limit, limit - 3)))


def insert_before(c: Column, marker: str, text: Column) -> Column:
    """text before the first marker; after the right-stripped whole where there is none."""
    at = F.instr(c, marker)
    inside = F.concat(F.left(c, at - 1), text, F.substring(c, at, F.length(c)))
    return F.when(at > 0, inside).otherwise(F.concat(F.regexp_replace(c, r"(?U)\s+$", ""), F.lit("\n\n"), text))


def index_list(c: Column, n: Column, k: int) -> Column:
    """1-based numbers of a text as 0-based indices below n, the first k; 0 to k-1 where none is valid."""
    numbers = F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: F.expr("bigint(null)") if x is None else x.try_cast("bigint"))
    valid = F.slice(F.transform(F.filter(numbers, lambda x: (x >= 1) & (x <= n)), lambda x: x - 1), 1, k)
    return F.when(F.size(valid) > 0, valid).otherwise(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>"))


def tenth_score(c: Column) -> Column:
    """The first whole number, 10 at most, over 10; 0 without one."""
    return F.least(F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("double"), F.lit(0.0)), F.lit(10.0)) / 10


def clean_title(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^\s*\d{4}\s*\.\s*", ""), r"^[\s.,;:]+", "")


def quality(c: Column, tags: tuple[str, ...] = REQUIRED_TAGS) -> Column:
    """word_count, has_all_tags and two keyword flags of a text's answer block."""
    own = block(c, "proposal")
    low = F.lower(own)
    pairs = [F.contains(c, F.lit(f"<{t}>")) & F.contains(c, F.lit(f"</{t}>")) for t in tags]
    every = pairs[0]
    for p in pairs[1:]:
        every = every & p

    def some(terms: tuple[str, ...]) -> Column:
        return F.regexp_like(low, F.lit("|".join(terms)))

    return F.struct(F.size(words(own)).alias("word_count"), every.alias("has_all_tags"), some(IMPLEMENTATION_TERMS).alias("implementation"), some(EVALUATION_TERMS).alias("evaluation"))


def tail(c: Column, limit: int = 20_000) -> Column:
    """The last characters of a text over limit, after a note; a note alone for an empty one."""
    cut_ = F.concat(F.lit(f"[...truncated, showing last {limit} chars...]\n\n"), F.right(c, F.lit(limit)))
    return F.when(F.length(c) > limit, cut_).when(empty(c), "(empty)").otherwise(c)


def named_blocks(c: Column, tags: tuple[str, ...] = PREVIEW_TAGS) -> Column:
    """The first block of each tag that a text has under its tag, a line each; without any, the text without its thinking."""
    found = [F.when(F.regexp_like(c, F.lit(f"(?s)<{t}>.*?</{t}>")), F.concat(F.lit(f"<{t}>\n"), strip(F.regexp_extract(c, f"(?s)<{t}>(.*?)</{t}>", 1)), F.lit("\n"))) for t in tags]
    joined = F.concat_ws("\n", *found)
    return F.when(joined != "", joined).otherwise(strip(F.regexp_replace(c, "(?s)<thinking>.*?</thinking>", "")))
