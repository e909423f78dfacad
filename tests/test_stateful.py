import datetime as dt
import random

import pytest

from sparquill.streaming import latest, stateful

BEGAN = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def store(spark):
    stateful.rocks(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def folder(spark, tmp_path, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))


def drained(spark, out, tmp_path, name):
    """Runs a stream to the end of what is there and returns all it wrote so far."""
    out.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start().awaitTermination(120)
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect()))


def lines(seed, n=60):
    """Lines of four runs in the order of time, with gaps below, at and above the limit."""
    rng = random.Random(seed)
    out = []
    for run in "abcd":
        at = rng.randrange(500)
        for _ in range(n):
            at += rng.choice([1, 5, 60, 199, 200, 201, 900])
            out.append((run, BEGAN + dt.timedelta(seconds=at)))
    return sorted(out, key=lambda r: r[1])


def test_liveness_equals_recomputation_after_a_restart(spark, tmp_path):
    schema = "run string, ts timestamp"
    every = lines(1)
    cuts = [0, 50, 51, 130, len(every)]
    parts = [every[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    folder(spark, tmp_path, parts[:2], schema)

    def stream():
        return stateful.liveness(latest.records(spark, str(tmp_path / "in/*"), schema, 1, "parquet"))

    def want(rows):
        return sorted(map(tuple, stateful.liveness_changes(spark.createDataFrame(rows, schema), rows[-1][1]).collect()))

    first = drained(spark, stream(), tmp_path, "out")
    seen = parts[0] + parts[1]
    # The clock stops at the last line's time, a timer just there has not fired.
    clock = seen[-1][1]
    assert [r for r in first if r[1] < clock] == [r for r in want(seen) if r[1] < clock]
    for k, rows in enumerate(parts[2:], 2):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    got, clock = drained(spark, stream(), tmp_path, "out"), every[-1][1]
    assert [r for r in got if r[1] < clock] == [r for r in want(every) if r[1] < clock]
    assert {r[2] for r in got} == {"running", "interrupted"}


def test_every_twentieth_row_whatever_the_batches(spark, tmp_path):
    schema = "worker string, n long, text string"
    rows = [(f"w{i % 3}", i, f"t{i}") for i in range(200)]
    want = sorted((w, i, t, k + 1) for x in ("w0", "w1", "w2") for k, (w, i, t) in enumerate(r for r in rows if r[0] == x) if (k + 1) % 20 == 0)
    for name, cuts in (("one", [0, 200]), ("some", [0, 3, 50, 51, 120, 200])):
        base = tmp_path / name
        first, rest = cuts[:3], cuts[2:]
        folder(spark, base, [rows[a:b][::-1] for a, b in zip(first, first[1:], strict=False)], schema)
        stream = stateful.every_nth(latest.records(spark, str(base / "in/*"), schema, 1, "parquet"), "worker", "n")
        got = drained(spark, stream, base, "out")
        for k, (a, b) in enumerate(zip(rest, rest[1:], strict=False), 2):
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(str(base / "in" / f"{k}"))
        got = drained(spark, stateful.every_nth(latest.records(spark, str(base / "in/*"), schema, 1, "parquet"), "worker", "n"), base, "out") if len(rest) > 1 else got
        assert got == want
