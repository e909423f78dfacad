"""Dense numbers for all rows of an order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import materialize

#: monotonically_increasing_id() counts the rows of a partition in this many low bits.
_BITS = 33


def free(columns: list[str], name: str) -> str:
    """name, or a longer one that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def prefix_sums(totals: DataFrame, part: str, n: str, group: int = 1000) -> DataFrame:
    """part, base: the sum of n over all smaller parts; sums over groups of parts first, then within each group."""
    grouped = totals.select(F.col(part).cast("long").alias("part"), F.col(n).cast("long").alias("n")).withColumn("g", F.floor(F.col("part") / group))
    sums = grouped.groupBy("g").agg(F.sum("n").alias("gn"))
    before = sums.select("g", (F.sum("gn").over(Window.orderBy("g")) - F.col("gn")).alias("gb"))
    within = F.sum("n").over(Window.partitionBy("g").orderBy("part")) - F.col("n")
    return grouped.withColumn("w", within).join(before, "g").select("part", (F.col("gb") + F.col("w")).alias("base"))


def dense_places(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """rows with a long column name: 0 to n - 1 in the given order.

    Rows are dealt into ranges of the order, each is sorted by a task of its own and written with its rows' numbers; the
    number of rows in all ranges before it comes from prefix sums over the ranges' counts. Rows that are equal in the whole
    order stay in one range, so an order with very many ties needs a further column that tells them apart. An existing
    column called name is replaced; an empty table stays empty.
    """
    rows = rows.drop(name)
    own, base, part = (free([*rows.columns, name], c) for c in ("__row", "__base", "__part"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(own, F.monotonically_increasing_id())
    held = materialize(dealt, "ordered")
    number = F.shiftright(own, _BITS)
    bases = prefix_sums(held.groupBy(number.alias("part")).agg(F.count("*").alias("n")), "part", "n")
    # One row a range; there are as many ranges as the shuffle has partitions.
    bases = F.broadcast(bases.select(F.col("part").alias(part), F.col("base").alias(base)))
    place = F.col(base) + F.col(own).bitwiseAND(F.lit((1 << _BITS) - 1))
    return held.join(bases, number == F.col(part)).select(*rows.columns, place.alias(name))
