import numpy as np
import pytest

from sparquill.operators import ivf, vector
from sparquill.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around 40 centers, one of which has a third of all rows."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 16))
    own = np.where(rng.random(3000) < 1 / 3, 0, rng.integers(0, 40, 3000))
    v = centers[own] + 0.15 * rng.normal(size=(3000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(f"p/{i:04d}", x.tolist(), int(o)) for i, (x, o) in enumerate(zip(v, own, strict=True))], "vec_id string, embedding array<double>, label int").cache()


def exact(rows, asked, k):
    """The k best ids of every query, one product at a time."""
    held = [(r["vec_id"], np.array(r["embedding"])) for r in rows.collect() if r["embedding"] is not None]
    out = {}
    for q in asked.collect():
        sims = sorted((-round(float(np.array(q["embedding"]) @ v), 9), i) for i, v in held if i != q["vec_id"])
        out[q["vec_id"]] = [i for _, i in sims[:k]]
    return out


def by_query(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query"], []).append(r["id"])
    return out


def test_recall_and_rows_multiplied(spark, clustered, monkeypatch):
    index = ivf.build(clustered, 60, sample=1500)
    assert index.rows.count() == 3000
    asked = clustered.filter("vec_id like '%7'")
    want = exact(clustered, asked, 10)
    probes = ivf.calibrated(index, asked)
    few = asked.filter("label <> 0")
    hits = ivf.search(index, asked, 10, probes)
    got = by_query(hits)
    assert np.mean([len(set(got[q]) & set(w)) / 10 for q, w in want.items()]) >= 0.9
    assert ivf.multiplied(index, few, probes) < 0.2
    assert by_query(ivf.search(index, asked, 10, 60)) == want
    monkeypatch.setattr(vector, "QUERY_BLOCK", 16)
    monkeypatch.setattr(ivf, "BLOCK", 100)
    assert sorted(map(tuple, ivf.search(index, asked, 10, probes).collect())) == sorted(map(tuple, hits.collect()))


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = rows.filter("vec_id % 20 = 0")
    index = ivf.build(rows, 32)
    probes = ivf.calibrated(index, asked)
    assert ivf.recall(ivf.search(index, asked, 10, probes), vector.top_k(rows, asked, 10)) >= 0.9


def test_index_on_disk(spark, clustered, tmp_path):
    index = ivf.build(clustered, 20)
    ivf.write(index, str(tmp_path / "ivf"))
    again = ivf.read(spark, str(tmp_path / "ivf"))
    asked = clustered.limit(5)
    found = ivf.search(again, asked, 5, 3)
    assert sorted(map(tuple, found.select("query", "id", "rank").collect())) == sorted(map(tuple, ivf.search(index, asked, 5, 3).select("query", "id", "rank").collect()))
    assert "PartitionFilters: [list" in found._jdf.queryExecution().toString()


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<double>")
    index = ivf.build(rows, 9)
    assert by_query(ivf.search(index, rows.filter("vec_id = 5"), 10, 9)) == {5: [1, 4, 3]}
    none = ivf.build(rows.limit(0), 4)
    assert ivf.search(none, rows, 3, 2).count() == 0 and ivf.search(index, rows.limit(0), 3, 2).count() == 0 and ivf.calibrated(none, rows) == 1


def test_written_index_of_text_ids_is_searched(spark, clustered, tmp_path):
    """Ids are texts and there is no label, as in an index file."""
    papers = clustered.selectExpr("vec_id AS id", "embedding", "'x' AS abstract").limit(300)
    tables.write_index(papers, str(tmp_path / "index"))
    index = tables.read_index(spark, str(tmp_path / "index"))
    asked = index.limit(4)
    hits = vector.top_k(index, asked, 5, "id", "embedding", None)
    assert hits.columns == ["query", "id", "sim", "rank"]
    assert by_query(hits) == exact(index.withColumnRenamed("id", "vec_id"), asked.withColumnRenamed("id", "vec_id"), 5)
