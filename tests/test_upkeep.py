import os
import random

import pytest
from pyspark.sql import functions as F

from sparquill.functions import scoring
from sparquill.operators import hooks, relational, upkeep

EDGES = "k long, ref long, pos int, title string, abstract string, year int"
PAPERS = "id long, title string, abstract string, year int"


def edge(rng, k):
    return (k, rng.randrange(60), rng.randrange(9), "edge", rng.choice([None, "", "own"]), 2000)


def changed(rng, edges, papers):
    """Some edges go, some come, some papers go, come or change."""
    edges = [e for e in edges if rng.random() > 0.05] + [edge(rng, rng.randrange(140)) for _ in range(12)]
    papers = {i: (i, "t", rng.choice([None, "new", "newer"]), 2010) if rng.random() < 0.1 else p for i, p in papers.items() if rng.random() > 0.05}
    new = rng.randrange(60)
    papers[new] = (new, "t", "put in", 2011)
    return edges, papers


def plain(df):
    return sorted((r["k"], tuple(map(tuple, r["refs"]))) for r in df.collect())


def test_three_change_sets_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(8)
    edges, papers = [edge(rng, rng.randrange(120)) for _ in range(700)], {i: (i, "t", rng.choice([None, "text"]), 2009) for i in range(0, 60, 2)}
    path = str(tmp_path / "table")

    def frames():
        return spark.createDataFrame(edges, EDGES), spark.createDataFrame(list(papers.values()), PAPERS)

    e, p = frames()
    upkeep.write_buckets(relational.resolved_references(e, p, "k", "ref", "pos", 2), path, "k", 16)
    for _ in range(3):
        edges, papers = changed(rng, edges, papers)
        ne, np_ = frames()
        touched = upkeep.touched_keys(ne, upkeep.changed_keys(e, ne, "k"), upkeep.changed_keys(p, np_, "id"), "k", "ref")
        want = plain(relational.resolved_references(ne, np_, "k", "ref", "pos", 2))
        current = upkeep.read_buckets(spark, path, "k")
        assert plain(upkeep.refreshed(current, touched, ne, np_, "k", "ref", "pos", 2)) == want
        upkeep.replace_keys(spark, path, touched, upkeep.recomputed(touched, ne, np_, "k", "ref", "pos", 2), "k", 16)
        assert plain(upkeep.read_buckets(spark, path, "k")) == want
        e, p = ne, np_


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_only_touched_buckets_are_replaced_and_emptied_ones_are_empty(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(40).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    upkeep.write_buckets(rows, path, "k", 8)
    before = files(path)
    bucket = rows.filter("k = 3").select(upkeep.bucket_of("k", 8)).first()[0]
    gone = rows.filter(upkeep.bucket_of("k", 8) == bucket)
    n = gone.count()
    upkeep.replace_keys(spark, path, gone.select("k"), rows.limit(0), "k", 8)
    assert upkeep.read_buckets(spark, path, "k").count() == 40 - n
    after = files(path)
    assert {f: t for f, t in before.items() if f"bucket={bucket}/" not in f} == {f: t for f, t in after.items() if f"bucket={bucket}/" not in f}
    upkeep.replace_keys(spark, path, rows.filter("k = 3").select("k"), rows.filter("k = 3"), "k", 8)
    assert upkeep.read_buckets(spark, path, "k").count() == 41 - n
    upkeep.replace_keys(spark, path, rows.limit(0).select("k"), rows, "k", 8)
    assert upkeep.read_buckets(spark, path, "k").count() == 41 - n


def test_changed_keys_count_repeated_rows(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "z")], "k int, v string")
    assert sorted(r["k"] for r in upkeep.changed_keys(a, b, "k").collect()) == [1, 3, 4]


def test_scorers_of_sql(spark):
    hooks.register(spark)
    rows = spark.createDataFrame([(1, 0.5, 0.9, 1.0, "old"), (2, None, 0.1, 0.5, "old")], "id int, retrieval double, overlap double, form double, score string")
    found = spark.sql("SELECT * FROM score(TABLE({t}), 'fas') ORDER BY id", t=rows)
    assert found.columns == ["id", "retrieval", "overlap", "form", "score", "fas", "format", "antileak"]
    first, second = found.collect()
    assert first["score"] == pytest.approx(0.6 * 0.5 + 0.2 + 0.2 * 0.5) and first["antileak"] == pytest.approx(0.5)
    assert second["score"] is None and second["overlap"] == 0.1
    assert [r["score"] for r in spark.sql("SELECT * FROM score(TABLE({t}), 'fas', 0.95) ORDER BY id", t=rows).collect()][0] == pytest.approx(0.6 * 0.5 + 0.4)
    assert [r["score"] for r in spark.sql("SELECT * FROM score(TABLE({t}), 'other') ORDER BY id", t=rows).collect()] == [1.0, 0.5]
    with pytest.raises(Exception, match="similarity"):
        spark.sql("SELECT * FROM score(TABLE({t}), 'prs')", t=rows)
    own = {"twice": hooks.Scorer(("form",), ("double_form",), lambda form, limit: (2 * form,))}
    hooks.register(spark, "own_score", own)
    assert [r["double_form"] for r in spark.sql("SELECT * FROM own_score(TABLE({t}), 'twice') ORDER BY id", t=rows).collect()] == [2.0, 1.0]
    with pytest.raises(Exception, match="no scorer"):
        spark.sql("SELECT * FROM own_score(TABLE({t}), 'thrice')", t=rows)


def test_reward_of_sql_equals_the_column_expression(spark):
    hooks.reward_function(spark)
    modes = ["prs", "fas", "ppl", "none", None]
    rows = spark.range(100).select(F.element_at(F.array(*map(F.lit, modes)), (F.col("id") % 5 + 1).cast("int")).alias("mode"), *((F.pmod(F.xxhash64("id", F.lit(c)), F.lit(101)) / 100).alias(c) for c in ("form", "sim", "ret", "over", "pred")))
    both = rows.select(F.expr("reward(mode, form, sim, ret, over, pred)").alias("a"), scoring.composite(*map(F.col, ("mode", "form", "sim", "ret", "over", "pred"))).alias("b"))
    assert all(r["a"] == pytest.approx(r["b"]) for r in both.collect())
