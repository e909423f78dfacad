import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparquill.operators import overlap

SF = "/root/testdata/sf0.001"


def cosines(rows, references, threshold):
    def counts(t):
        return Counter(re.findall(r"\w+", (t or "").lower()))

    out = {}
    for k, t in rows:
        for r, u in references:
            a, b = counts(t), counts(u)
            dot = sum(n * b[w] for w, n in a.items())
            if dot:
                s = dot / (sum(n * n for n in a.values()) ** 0.5 * sum(n * n for n in b.values()) ** 0.5)
                if s > threshold:
                    out[k, r] = s
    return out


@pytest.mark.parametrize(("threshold", "rest"), [(0.85, None), (0.85, 0.6), (0.5, 0.1), (0.3, None)])
def test_pairs_equal_brute_force(spark, threshold, rest):
    """Words from very frequent to rare, texts of one word and of many, equal texts, and texts without words."""
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    base = [rng.choices(words, k=rng.choice([1, 2, 5, 30])) for _ in range(30)]

    def text():
        own = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        return " ".join(own)

    rows = [(i, text()) for i in range(120)] + [(500, None), (501, ""), (502, "  ")]
    references = [(f"r{i}", text()) for i in range(40)] + [("none", None), ("empty", "")]
    a, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(references, "item_id string, text string")
    want = cosines(rows, references, threshold)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in overlap.similar_pairs(a, b, threshold=threshold, rest=rest).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    flags = overlap.flags(a, b, threshold=threshold).collect() if rest is None else []
    assert {r["doc_id"]: r["n_close"] for r in flags if r["flagged"]} == (Counter(k for k, _ in want) if flags else {})
    assert len(flags) in (0, len(rows)) and overlap.similar_pairs(a, b.limit(0)).count() == 0


def test_frequent_words_do_not_join(spark):
    """A word that all texts have joins nothing, where others have most of a text's norm; few pairs are compared in full."""
    docs = [(i, "the " + " ".join(f"w{i}_{j}" for j in range(30))) for i in range(300)]
    refs = [(i, "the " + " ".join(f"v{i}_{j}" for j in range(30))) for i in range(300)] + [(1000, docs[7][1])]
    own = overlap.term_counts(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    other = overlap.term_counts(spark.createDataFrame(refs, "item_id long, text string"), "item_id", "text").withColumnRenamed("n", "m")
    assert [tuple(r) for r in overlap.candidates(own, other, "doc_id", "item_id", 0.85).collect()] == [(7, 1000)]


def test_candidates_are_few(spark):
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    own, other = overlap.term_counts(docs, "doc_id", "text"), overlap.term_counts(items, "item_id", "text").withColumnRenamed("n", "m")
    assert overlap.candidates(own, other, "doc_id", "item_id", 0.85).count() < docs.count() * items.count() / 10


def test_screen_by_text_ids(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    named = items.selectExpr("'paper/' || lpad(item_id, 6, '0') AS item_id", "text")
    want = {r["doc_id"]: r["item_id"] for r in overlap.closest(docs, items).collect()}
    for rows in (2_000_000, 10):
        monkeypatch.setattr(overlap, "MATRIX_ROWS", rows)
        got = {r["doc_id"]: r["item_id"] for r in overlap.closest(docs, named).collect()}
        assert got == {k: None if v is None else f"paper/{v:06d}" for k, v in want.items()}


@pytest.mark.parametrize("limit", [2_000_000, 10])
def test_pairs_by_matrix_and_by_join(spark, monkeypatch, limit):
    """Both ways give the same pairs: ids of any kind, rows of one key as one text, keys of null in no pair, blocks of few cells."""
    monkeypatch.setattr(overlap, "MATRIX_ROWS", limit)
    monkeypatch.setattr(overlap, "CELLS", 50)
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.choice([1, 3, 20]))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(300, None), (301, "")]
    references = [(i, t + " more") for i, t in enumerate(texts[:25])] + [(90, None), (91, "")]
    want = cosines([*rows, (400, f"{texts[0]} {texts[1]}")], references, 0.6)
    a = spark.createDataFrame([*rows, (400, texts[0]), (400, texts[1]), (None, texts[2])], "doc_id long, text string")
    b = spark.createDataFrame([*references, (None, texts[3])], "item_id int, text string")
    pairs = overlap.similar_pairs(a, b, threshold=0.6)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in pairs.collect()}
    assert any(k == 400 for k, _ in want) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert pairs.schema["item_id"].dataType.simpleString() == "int" and pairs.count() == len(want)


def test_few_references_shuffle_no_words(spark):
    """Against few references no word of a text is shuffled, sorted or written: the plan has the scan and the tasks' own work alone."""
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    plan = overlap.similar_pairs(docs, items, threshold=0.6)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Sort" not in plan and "token" not in plan


def test_flags_hold_blocks_in_memory(spark):
    """Whatever the texts, a block of the matrix has a bounded number of cells and of meetings; no sort or window holds a text's words."""
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    plan = overlap.flags(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "token" not in plan
    found = pa.table({"item_id": [i for i in range(100) for _ in range(2)], "token": ["the", "a"] * 100, "m": [1, 2] * 100})
    matrix = overlap._Matrix(found, "item_id")
    blocks = list(matrix.similarities(pa.array([["the", "a", "x"]] * 50 + [[], None, ["x"]])))
    assert [(first, len(s)) for first, s in blocks] == [(0, 53)]
    old, overlap.CELLS = overlap.CELLS, 1000
    try:
        small = list(matrix.similarities(pa.array([["the", "a", "x"]] * 50 + [[], None, ["x"]])))
    finally:
        overlap.CELLS = old
    assert max(len(s) for _, s in small) <= 10 and (np.concatenate([s for _, s in small]) == blocks[0][1]).all()


@pytest.mark.parametrize("texts", [2, 128])
def test_words_are_counted_where_the_texts_are(spark, monkeypatch, texts):
    """No word is shuffled, sorted or held in a map of a task's keys and words, where keys differ; rows of one key, null too, count as one text."""
    monkeypatch.setattr(overlap, "TEXTS", texts)
    rows = [(i, f"The the w{i} of {'x ' * i}") for i in range(20)] + [(100, None), (101, ""), (102, " !")]
    own = overlap.term_counts(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id", "text")
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Aggregate" not in plan and "Sort" not in plan
    assert own.schema.simpleString() == "struct<doc_id:int,token:string,n:bigint>"
    more = [(3, "the end"), (100, "late"), (None, "a b a"), (None, "b c")]
    both = overlap.term_counts(spark.createDataFrame(rows + more, "doc_id int, text string"), "doc_id", "text")
    for got, given in ((own, rows), (both, rows + more)):
        want = Counter((k, w) for k, t in given for w in re.findall(r"\w+", (t or "").lower()))
        assert sorted((str(r["doc_id"]), r["token"], r["n"]) for r in got.collect()) == sorted((str(k), w, n) for (k, w), n in want.items())
