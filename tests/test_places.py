import random

import pytest
from pyspark.sql import functions as F

from sparquill.operators.places import dense_places
from sparquill.sources.scratch import discard, materialize


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_dense_places(spark, n):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 1, 1, rng.randrange(9)]), "x") for i in range(n)]
    df = spark.createDataFrame(rows, "id long, v int, __row string").repartition(7)
    got = dense_places(df, F.desc_nulls_last("v"), "id").orderBy("place").collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r["id"], r["v"], r["__row"]) for r in got] == want and [r["place"] for r in got] == list(range(n))


def test_discard(spark, tmp_path):
    held = materialize(spark.range(10), "some")
    assert held.count() == 10
    discard(held)
    other = str(tmp_path / "own")
    spark.range(3).write.parquet(other)
    discard(spark.read.parquet(other))
    assert spark.read.parquet(other).count() == 3
