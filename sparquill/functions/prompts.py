"""Reference lists as prompt text. A reference is a struct of title, year and abstract."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cut, strip


def _head(r: Column, i: Column) -> Column:
    year = F.when(F.coalesce(r["year"].cast("string"), F.lit("")) == "", "n.d.").otherwise(r["year"].cast("string"))
    return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(r["title"], F.lit("Unknown")), F.lit(" ("), year, F.lit(")"))


def reference_block(refs: Column, most: int, limit: int = 400) -> Column:
    """Numbered entries of title, year and abstract cut to limit, a blank line between."""
    def entry(r: Column, i: Column) -> Column:
        body = cut(strip(F.coalesce(r["abstract"], F.lit(""))), limit)
        return F.concat(_head(r, i), F.lit("\nAbstract: "), F.when(body == "", "(no abstract available)").otherwise(body))

    return F.array_join(F.transform(F.slice(refs, 1, most), entry), "\n\n")


def compact_list(refs: Column) -> Column:
    return F.array_join(F.transform(refs, _head), "\n")


def preview(refs: Column, n: int) -> Column:
    """The first n lines and the number of the rest."""
    more = F.size(refs) - n
    lines = compact_list(F.slice(refs, 1, n))
    return F.when(more > 0, F.concat(lines, F.lit("\n... and "), more.cast("string"), F.lit(" more"))).otherwise(lines)


def fill(template: str, **values: Column) -> Column:
    """A template with {name} places filled, {{ and }} standing for braces; what a value brings in is not filled again, a null value is empty.

    A place without a value is an error.
    """
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def seeded_order(key: Column, seed: int) -> Column:
    """A deterministic shuffle: sort by this."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
