"""LaTeX to plain sections, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Environments that are dropped, commands whose argument goes and commands whose argument stays.
DROPPED = ("figure", "figure*", "table", "table*", "comment", "thebibliography")
REFERRING = ("cite", "citet", "citep", "citealp", "citeauthor", "citeyear", "ref", "eqref", "cref", "Cref", "autoref", "label", "url", "email")
STYLES = ("textit", "textbf", "emph", "underline", "textsc", "textrm", "mathrm", "mathbf", "mathit", "mbox")
#: Section kinds by keyword, tried in this order (fixed values).
KINDS = (
    ("abstract", ("abstract",)),
    ("other", ("data availability", "acknowledg")),
    ("problem", ("intro", "background", "motivation", "overview")),
    ("method", ("method", "approach", "algorithm", "model", "framework", "system", "calculation", "simulation", "protocol")),
    ("implementation", ("implementation", "training", "dataset", "data", "loss", "objective")),
    ("evaluation", ("experiment", "evaluation", "setup", "baseline", "benchmark", "ablation")),
    ("results", ("result", "analysis", "finding")),
    ("discussion", ("discussion", "limitation", "future", "conclusion")),
    ("appendix", ("appendix", "supplement")),
)
#: The order in which kinds are selected (fixed values).
PRIORITY = {"abstract": 0, "problem": 1, "method": 2, "implementation": 2, "evaluation": 3, "results": 3, "discussion": 4, "appendix": 5, "other": 9}

# Fixed patterns of options, headings and, below, of environments, abstracts, pseudo-headings and what cleaned() removes.
_OPTION = r"\*?(?:\[[^\]]*\])?"
_HEADING = r"\\(?:section|subsection|subsubsection|paragraph)\*?(?:\[[^\]]*\])?\{([^{}]{1,220})\}"
_MARK, _END = "\u0001", "\u0002"


def without_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<!\\)%[^\n]*", "")


def prepared(c: Column) -> Column:
    """Comments and dropped environments removed; abstracts and italic pseudo-headings become sections."""
    c = without_comments(c)
    for env in DROPPED:
        name = env.replace("*", r"\*")
        c = F.regexp_replace(c, rf"(?s)\\begin\{{{name}\}}.*?\\end\{{{name}\}}", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"\\begin\{abstract\}", r"\\section*{Abstract}"), r"\\end\{abstract\}", "\n")
    pseudo = r"(?m)^\s*(?:\([a-z]\)\s*)?(?:\\noindent\s*)?\\textit\{(?=[A-Z][^{}]{2,100}\.?\})([^{}]*?)\.*\}\s*(?:\\\\)?"
    return F.regexp_replace(c, pseudo, "\n\\\\section*{$1}\n")


def cleaned(c: Column, depth: int = 4) -> Column:
    """Plain text; arguments of nested commands are kept down to the given depth."""
    c = F.regexp_replace(without_comments(c), r"\\href\{[^{}]*\}\{([^{}]*)\}", "$1")
    c = F.regexp_replace(c, rf"\\(?:{'|'.join(REFERRING)}){_OPTION}\{{[^{{}}]*\}}", " ")
    for _ in range(depth):
        c = F.regexp_replace(c, rf"\\(?:{'|'.join(STYLES)}){_OPTION}\{{([^{{}}]*)\}}", "$1")
    for _ in range(depth):
        c = F.regexp_replace(c, rf"\\[a-zA-Z]+{_OPTION}\{{([^{{}}]*)\}}", "$1")
    c = F.regexp_replace(F.regexp_replace(c, rf"\\[a-zA-Z]+{_OPTION}", " "), r"\\.", " ")
    c = F.replace(F.translate(c, "~${}", "    "), F.lit("&"), F.lit(" and "))
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+([,.;:])", "$1"), r"(?U)\s+", " ")
    return strip(c)


def kind(heading: Column) -> Column:
    low, out = F.lower(heading), F.when(F.lit(False), "")
    for name, keys in KINDS:
        out = out.when(F.regexp_like(low, F.lit("|".join(keys))), name)
    return out.otherwise("other")


def _bound(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c) with c computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(c), body), 1)


def sections(c: Column, name: Column, least: int = 120, least_whole: int = 200) -> Column:
    """An array of (heading, kind, text, order); a text without headings is one section under the given name."""

    def section(part: Column, i: Column) -> Column:
        pieces = F.split(part, _END, 2)
        heading = F.regexp_replace(cleaned(pieces[0]), r"^[ .:-]+|[ .:-]+$", "")
        heading = F.when(heading == "", "Untitled").otherwise(heading)
        return F.struct(heading.alias("heading"), cleaned(pieces[1]).alias("text"), i.alias("order"))

    def kinds(s: Column) -> Column:
        return F.struct(s["heading"].alias("heading"), kind(s["heading"]).alias("kind"), s["text"].alias("text"), s["order"].alias("order"))

    def of(ready: Column) -> Column:
        # What stands before the first heading is left out.
        parts = F.split(F.regexp_replace(ready, _HEADING, f"{_MARK}$1{_END}"), _MARK, -1)
        return F.transform(F.filter(F.transform(F.filter(parts, lambda p, i: i > 0), section), lambda s: F.length(s["text"]) >= least), kinds)

    def alone(whole: Column) -> Column:
        one = F.array(F.struct(name.alias("heading"), F.lit("other").alias("kind"), whole.alias("text"), F.lit(0).alias("order")))
        return F.when(F.length(whole) >= least_whole, one).otherwise(F.slice(one, 1, 0))

    return _bound(prepared(c), lambda ready: F.when(F.regexp_like(ready, F.lit(_HEADING)), of(ready)).otherwise(_bound(cleaned(ready), alone)))


def selected(items: Column, limit: int) -> Column:
    """Sections by kind and order until limit characters are used; each is cut, and left out if under 120 then remain."""
    cap = max(2500, min(6500, limit // 4))

    def ranked(s: Column) -> Column:
        rank = F.when(F.lit(False), 0)
        for name, place in PRIORITY.items():
            rank = rank.when(s["kind"] == name, place)
        return F.struct(rank.otherwise(9).alias("rank"), s["order"].alias("order"), s["heading"].alias("heading"), s["kind"].alias("kind"), s["text"].alias("text"))

    kept = "array<struct<heading:string,kind:string,text:string>>"

    def step(state: Column, s: Column) -> Column:
        room = F.least(F.lit(cap), F.lit(limit) - state["used"])

        def add(text: Column) -> Column:
            more = F.struct((state["used"] + F.length(text)).alias("used"), F.concat(state["out"], F.array(F.struct(s["heading"].alias("heading"), s["kind"].alias("kind"), text.alias("text")))).alias("out"))
            return F.when(F.length(text) < 120, state).otherwise(more)

        return _bound(strip(F.left(s["text"], F.greatest(room, F.lit(0)))), add)

    start = F.struct(F.lit(0).alias("used"), F.array().cast(kept).alias("out"))
    return F.aggregate(F.array_sort(F.transform(items, ranked)), start, step)["out"]
