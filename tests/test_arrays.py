import numpy as np
import pytest

from sparquill.operators import vector
from sparquill.sources import arrays, tables


def made(n, d=8, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.array([f"math/{i:07d}" if i % 3 else f"24{i % 12 + 1:02d}.{i:05d}" for i in range(n)])
    return v, ids, np.array([f"abstract é {i} " * (i % 5) for i in range(n)])


def test_rows_of_an_index_file_in_parts(spark, tmp_path):
    v, ids, abstracts = made(1000)
    np.savez(tmp_path / "a.npz", embeddings=v, arxiv_ids=ids, abstracts=abstracts)
    df = arrays.read_npz_index(spark, str(tmp_path / "a.npz"), partition_bytes=40_000)
    assert df.rdd.getNumPartitions() > 5
    rows = {r["id"]: r for r in df.collect()}
    assert len(rows) == 1000
    for i in range(1000):
        r = rows[str(ids[i])]
        assert np.array_equal(np.array(r["embedding"], np.float32), v[i]) and r["abstract"] == abstracts[i]


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_folder_types_and_missing_abstracts(spark, tmp_path, save):
    v, ids, _ = made(30)
    save(tmp_path / "a.npz", embeddings=v.astype(np.float64), arxiv_ids=np.char.encode(ids))
    save(tmp_path / "b.npz", embeddings=v[:0], arxiv_ids=ids[:0])
    save(tmp_path / "c.npz", embeddings=v[:3].astype(np.float16), arxiv_ids=np.arange(3))
    rows = arrays.read_npz_index(spark, f"file://{tmp_path}", partition_bytes=500).collect()
    assert sorted(r["id"] for r in rows) == sorted([*map(str, ids), "0", "1", "2"])
    assert {r["abstract"] for r in rows} == {""}


def test_no_rows(spark, tmp_path):
    v, ids, _ = made(1)
    np.savez(tmp_path / "a.npz", embeddings=v[:0], arxiv_ids=ids[:0])
    assert arrays.read_npz_index(spark, str(tmp_path / "a.npz")).collect() == []


def test_what_is_refused(spark, tmp_path):
    v, ids, _ = made(4)
    np.savez(tmp_path / "objects.npz", embeddings=v, arxiv_ids=ids.astype(object))
    np.savez(tmp_path / "short.npz", embeddings=v, arxiv_ids=ids[:3])
    np.savez(tmp_path / "other.npz", vectors=v)
    np.savez(tmp_path / "columns.npz", embeddings=np.asfortranarray(v), arxiv_ids=ids)
    for name in ("objects", "short", "other", "columns"):
        with pytest.raises(Exception, match="objects|different|no array|columns"):
            arrays.read_npz_index(spark, str(tmp_path / f"{name}.npz")).collect()


def test_index_file_feeds_the_search(spark, tmp_path):
    v, ids, abstracts = made(300)
    np.savez(tmp_path / "a.npz", embeddings=v, arxiv_ids=ids, abstracts=abstracts)
    index = arrays.read_npz_index(spark, str(tmp_path / "a.npz"), partition_bytes=20_000)
    asked = index.filter("id like 'math/%1'")
    hits = vector.top_k(index, asked, 5, id_col="id", label_col=None)
    got = {}
    for r in hits.collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["id"]
    sims = v.astype(np.float64) @ v.astype(np.float64).T
    at = {str(x): i for i, x in enumerate(ids)}
    assert got
    for query, ranks in got.items():
        best = sorted((j for j in range(300) if j != at[query]), key=lambda j: (-round(sims[at[query], j], 9), str(ids[j])))[:5]
        assert [ranks[k] for k in range(1, 6)] == [str(ids[j]) for j in best]
    tables.write_index(index, str(tmp_path / "out"))
    assert tables.read_index(spark, str(tmp_path / "out")).count() == 300
