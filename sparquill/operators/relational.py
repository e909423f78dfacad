"""Joins, selections by key and folds that the corpus and run tables need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.prompts import seeded_order
from ..functions.runs import experiment_number, label_base, label_timestamp
from ..functions.text import empty


def resolved_references(edges: DataFrame, papers: DataFrame, key: str, ref: str, order: str, least: int = 0) -> DataFrame:
    """One row for each key with its references that can be resolved, in order, where there are least of them or more.

    edges: key, ref, order, and the reference's own title, abstract, year; papers: id, title, abstract, year. A paper
    with an abstract wins, else the edge's own fields count if they have one, else the edge is dropped.
    Edges join papers on the id, so neither side has to fit in memory.
    """
    local = papers.select(F.col("id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in ("title", "abstract", "year")))
    joined = edges.join(local, F.col(ref) == F.col("__id"), "left")
    own = ~empty(F.col("__abstract"))
    fields = [F.when(own, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in ("title", "abstract", "year")]
    kept = joined.filter(own | ~empty(F.col("abstract"))).select(key, F.struct(F.col(order).alias("pos"), F.col(ref).alias("id"), *fields).alias("r"))
    groups = kept.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("refs"))
    return groups.filter(F.size("refs") >= least)


def pending(rows: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """Rows whose key is in none of the done tables."""
    for d in done:
        rows = rows.join(d.select(key), key, "left_anti")
    return rows


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, all columns.

    Spark keeps each task's first row of a key before it deals rows out by key (WindowGroupLimit), so a hot key sends a row a task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def best_row(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Like latest() for ascending orders of plain values, by a partial aggregate: right for hot keys."""
    rest = [c for c in rows.columns if c not in keys]
    picked = F.min(F.struct(*(o.alias(f"__o{i}") for i, o in enumerate(order)), F.struct(*rest).alias("__row")))
    return rows.groupBy(*keys).agg(picked.alias("__b")).select(*keys, *(F.col(f"__b.__row.{c}").alias(c) for c in rest))


def first_tier(rows: DataFrame, *tiers: Column) -> DataFrame:
    """The rows of the first condition that any row fulfils; all rows where none does."""
    tier = F.lit(len(tiers))
    for i in reversed(range(len(tiers))):
        tier = F.when(tiers[i], i).otherwise(tier)
    rows = rows.withColumn("__tier", tier)
    found = rows.agg(F.min("__tier").alias("__least"))
    return rows.join(F.broadcast(found), F.col("__tier") == F.col("__least")).drop("__tier", "__least")


def ordered_union(seeds: DataFrame, refs: DataFrame) -> DataFrame:
    """id, ord: the seeds (id, ord) first, then each new id of refs (id, ord) at its first place."""
    first = refs.groupBy("id").agg(F.min("ord").alias("ord")).join(seeds.select("id"), "id", "left_anti")
    return seeds.select("id", "ord", F.lit(0).alias("part")).unionByName(first.select("id", "ord", F.lit(1).alias("part")))


def pinned(refs: Column, pinned_count: Column | int, most: int, seed: int = 42) -> Column:
    """The first pinned_count references (structs with an id), then the rest in seeded order, most in all."""
    n = F.lit(pinned_count) if isinstance(pinned_count, int) else pinned_count
    head = F.slice(refs, F.lit(1), F.least(n, F.lit(most)))
    rest = F.slice(refs, n + 1, F.greatest(F.size(refs) - n, F.lit(0)))
    keyed = F.array_sort(F.transform(rest, lambda r: F.struct(seeded_order(r["id"], seed).alias("k"), r.alias("r"))))
    return F.concat(head, F.slice(F.transform(keyed, lambda x: x["r"]), F.lit(1), F.greatest(F.lit(most) - F.size(head), F.lit(0))))


def tail_mean(rows: DataFrame, keys: list[str], value: str, order: Column, n: int, otherwise: float) -> DataFrame:
    """Each key's mean of its last n values that are not null; otherwise where it has none.

    Keys are found by a partial aggregate, and of their values each task sends its last n (WindowGroupLimit), so a hot key is no burden.
    """
    every = rows.select(*keys).distinct()
    w = Window.partitionBy(*keys).orderBy(order.desc())
    last = rows.filter(F.col(value).isNotNull()).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n)
    means = last.groupBy(*keys).agg(F.avg(value).alias("tail_mean"))
    return every.join(means, keys, "left").withColumn("tail_mean", F.coalesce("tail_mean", F.lit(otherwise)))


def last_value(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Each key's value at the highest order that has one, null where none has; a partial aggregate."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def skip_counts(rows: DataFrame, **reasons: Column) -> DataFrame:
    """reason, n: rows by the first reason that holds; kept for none."""
    reason = F.when(F.lit(False), "")
    for name, test in reasons.items():
        reason = reason.when(test, name)
    return rows.groupBy(reason.otherwise("kept").alias("reason")).agg(F.count("*").alias("n"))


def missing_ordinals(rows: DataFrame, key: str, ordinal: str, block: int = 4096) -> DataFrame:
    """key, missing: the smallest ordinal from 0 on that a key lacks.

    A key's ordinals are looked at in blocks, each by a partial aggregate; what is sorted together are blocks, not rows.
    """
    # Ordinals below 0 are none; a key with no others lacks 0.
    numbers = rows.select(F.col(key), F.col(ordinal).cast("long").alias("o")).withColumn("b", F.when(F.col("o") >= 0, F.floor(F.col("o") / block)))
    own = numbers.groupBy(key, "b").agg(F.collect_set("o").alias("s"))
    gap = F.array_min(F.array_except(F.sequence(F.col("b") * block, F.col("b") * block + block - 1), F.col("s")))
    gaps = own.select(key, "b", gap.alias("gap")).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last("b"))) - 1)
    # A block that is not there at all leaves the next one out of its place: its first ordinal is missing.
    first = F.when(F.col("b").isNull() | (F.col("b") > F.col("place")), F.col("place") * block).otherwise(F.col("gap"))
    after = (F.max(F.when(F.col("b").isNotNull(), F.col("b"))) + 1) * block
    return gaps.groupBy(key).agg(F.coalesce(F.min(first), after, F.lit(0)).cast("long").alias("missing"))


def numbered_prefix(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Rows whose ordinals run from 0 without a gap, up to the first gap of their key; rows that share an ordinal all count."""
    return rows.join(missing_ordinals(rows, key, ordinal), key).filter((F.col(ordinal) >= 0) & (F.col(ordinal) < F.col("missing"))).drop("missing")


def row_at(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The row with ordinal n (from 0) in an order: a limit on the sort, not a number for every row."""
    return rows.orderBy(*order).offset(n).limit(1)


def overlaid(rows: DataFrame, cached: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rows with the fields of the cached row of the same key where that has them; fields that rows lacks are added."""
    own = cached.select(F.col(key), *(F.col(f).alias(f"__{f}") for f in fields))
    joined = rows.join(own, key, "left")
    return joined.withColumns({f: F.coalesce(f"__{f}", f) if f in rows.columns else F.col(f"__{f}") for f in fields}).drop(*(f"__{f}" for f in fields))


def first_found(keys: DataFrame, key: str, value: str, *sources: DataFrame) -> DataFrame:
    """keys with the value of the first source that has one for the key, and the source's number; null where none has."""
    out = keys
    for i, s in enumerate(sources):
        out = out.join(s.select(key, F.col(value).alias(f"__{i}")), key, "left")
    found = [F.when(F.col(f"__{i}").isNotNull(), F.lit(i)) for i in range(len(sources))]
    return out.select(*keys.columns, F.coalesce(*(F.col(f"__{i}") for i in range(len(sources)))).alias(value), F.coalesce(*found).alias("source"))


def aligned(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns named, with null of the given type for those that rows lacks."""
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))


def matching_runs(rows: DataFrame, name: str, prefix: str = "", part: str = "") -> DataFrame:
    """Rows whose name starts with prefix and contains part."""
    return rows.filter(F.startswith(F.col(name), F.lit(prefix)) & F.contains(F.col(name), F.lit(part)))


def to_relaunch(states: DataFrame, stuck: bool = False) -> DataFrame:
    """Samples in error, and with stuck those still generating."""
    return states.filter(F.col("step").isin("error", "generating") if stuck else F.col("step") == "error")


def grid(rows: DataFrame, name: str, values: list) -> DataFrame:
    """Every row with every value of a stated list, as machines with devices or checkpoints with strategies."""
    return rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def with_samples(runs: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """Each run with its number of samples and those done, passed and in error; runs without samples have zeros."""
    own = samples.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("step") == "done").alias("n_done"), F.count_if("passed").alias("n_passed"), F.count_if(F.col("step") == "error").alias("n_errors"))
    counts = ["n", "n_done", "n_passed", "n_errors"]
    return runs.join(own, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def latest_summaries(rows: DataFrame) -> DataFrame:
    """One row for each label without its timestamp and strategy: the latest timestamp, then most n_proposals, then the first path.

    rows: label, strategy, n_proposals, path. A partial aggregate, so a label with very many runs is no burden.
    """
    keyed = rows.withColumns({"base": label_base(F.col("label")), "stamp": label_timestamp(F.col("label")), "strategy": F.coalesce("strategy", F.lit(""))})
    inverse = F.struct("stamp", F.coalesce("n_proposals", F.lit(0)).alias("n"))
    most = keyed.groupBy("base", "strategy").agg(F.max(inverse).alias("m"))
    tied = keyed.join(most, ["base", "strategy"]).filter((F.col("stamp") == F.col("m.stamp")) & (F.coalesce("n_proposals", F.lit(0)) == F.col("m.n"))).drop("m")
    return best_row(tied, ["base", "strategy"], F.col("path"))


def latest_checkpoints(rows: DataFrame) -> DataFrame:
    """One usable row for each experiment number: the latest timestamp of the path's first folder, then the greatest path. rows: name, path, usable."""
    stamp = F.regexp_extract(F.split("path", "/")[0], r"_(\d{8}_\d{6})$", 1)
    keyed = rows.filter("usable").withColumns({"experiment": experiment_number(F.col("path"), F.col("name")), "stamp": stamp})
    rest = [c for c in keyed.columns if c != "experiment"]
    best = keyed.groupBy("experiment").agg(F.max_by(F.struct(*rest), F.struct("stamp", "path")).alias("r"))
    return best.select("experiment", *(f"r.{c}" for c in rest))


def newest_matching(rows: DataFrame, prefixes: list[str]) -> DataFrame:
    """For each prefix the newest row (name, path, mtime) whose name starts with it, else the newest that contains it; ties go to the smallest path."""
    asked = F.filter(F.array(*map(F.lit, prefixes)), lambda p: F.contains(F.col("name"), p))
    found = rows.select("name", "path", "mtime", F.explode(asked).alias("prefix"))
    tier = F.when(F.startswith("name", F.col("prefix")), 0).otherwise(1)
    best = found.groupBy("prefix").agg(F.min(F.struct(tier.alias("tier"), (-F.col("mtime")).alias("age"), "path", "name")).alias("b"))
    return best.select("prefix", "b.name", "b.path", (-F.col("b.age")).alias("mtime"), "b.tier")


def experiments(registered: DataFrame, found: DataFrame) -> DataFrame:
    """label, path, part: all registered (label, path), then of what was found (name, path, mtime) elsewhere the newest of each name without its last two parts."""
    others = found.join(registered.select("path"), "path", "left_anti")
    parts = F.split("name", "_")
    base = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 2), "_")).otherwise(F.col("name"))
    newest = others.groupBy(base.alias("label")).agg(F.min(F.struct((-F.col("mtime")).alias("age"), "path")).alias("b"))
    return registered.select("label", "path", F.lit(0).alias("part")).unionByName(newest.select("label", "b.path", F.lit(1).alias("part")))


def step_numbers(traces: DataFrame) -> DataFrame:
    """trace, ord, place, name, step: the tool calls of traces (trace, ord, type, content: array of type and name) numbered from 1 in each trace.

    A trace's calls, without their inputs, are sorted in one task, on disk if need be.
    """
    calls = traces.filter("type = 'assistant'").select("trace", "ord", F.posexplode("content").alias("place", "b")).filter("b.type = 'tool_use'")
    step = F.row_number().over(Window.partitionBy("trace").orderBy("ord", "place"))
    return calls.select("trace", "ord", "place", "b.name").withColumn("step", step)


def cell_text(done: Column, passed: Column, errors: Column, mean: Column) -> Column:
    """passed/done (mean with its sign), or the number of errors where none is done."""
    sign = F.when(mean >= 0, "+").otherwise("")
    some = F.concat(passed.cast("string"), F.lit("/"), done.cast("string"), F.lit(" ("), sign, F.format_string("%.2f", mean), F.lit("%)"))
    return F.when(done > 0, some).otherwise(F.concat(F.lit("0/0 ("), errors.cast("string"), F.lit(" err)")))


def nulls_last(rows: DataFrame, value: str, *ties: str) -> DataFrame:
    """Rows in descending order of a value, null and NaN last."""
    return rows.orderBy(F.nullif(F.col(value), F.lit(float("nan"))).desc_nulls_last(), *ties)
