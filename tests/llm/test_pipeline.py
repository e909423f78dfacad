import re

import numpy as np
import pyarrow.parquet as pq
from test_ops import SF, groups, shingles

import corpus_pipeline
from sparquill.llm import decontaminate, queries


def test_stages_equal_brute_force(spark):
    """Every stage's decisions on its own input, recomputed one document at a time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r["doc_id"]: r["score"] for r in queries.op9_quality(spark, SF).collect()}
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    cfg = decontaminate.SeedConfig()

    def plain(text):
        return re.sub(r"[!-/:-@\[-`{-~]", " ", text.lower()).split()

    def leaking(texts):
        """The ids of texts in which some window of some item has enough equal words; windows that leave a text don't count."""
        number, codes, ids, found = {}, [], [], set()
        for i, t in texts.items():
            own = [number.setdefault(w, len(number)) for w in plain(t)] + [-1] * cfg.window
            codes, ids = codes + own, ids + [i] * len(own)
        codes = np.array(codes)
        outside = np.concatenate(([0], np.cumsum(codes < 0)))
        for item in ([number.get(w, -2) for w in plain(b["text"])] for b in bench):
            size = min(cfg.window, len(item))
            n = len(codes) - size + 1
            for k in range(len(item) - size + 1):
                equal = sum((codes[j : j + n] == item[k + j]).astype(int) for j in range(size))
                hits = (equal * cfg.window >= size * cfg.matches) & (outside[size:] == outside[:-size])
                found.update(ids[p] for p in np.flatnonzero(hits))
        return found

    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        docs = corpus_pipeline.common.materialize(after, "test")
        kept = {r["doc_id"] for r in docs.collect()}
        if name == "quality":
            want = {i for i in before if scores[i] >= 0.3}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i]), i)
            want = set(first.values())
        elif name == "minhash":
            want = {i for i, c in groups({i: shingles(t) for i, t in before.items()}).items() if i == c}
        else:
            want = set(before) - leaking(before)
        assert kept == want, name
    pieces = corpus_pipeline.pack(spark, docs, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == kept


def test_run_and_empty_table(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stages_on_odd_rows(spark):
    """Null and repeated ids, null, empty and very long texts, ties, and columns whose names clash: stages decide by row and return all columns."""
    item = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()[0]["text"]
    words = [f"w{i}" for i in range(200)]
    near = " ".join([*words[:100], "zz", *words[101:]])
    rows = [(None, item), (1, item), (1, "a clean text of its own, nothing else"), (2, " ".join(words)), (2, near), (3, None), (3, ""), (None, ""), (4, "y" * 300_000 + " end"), (5, "same text"), (5, "same  text"), (None, "same text")]
    columns = ["doc_id long", "text string", "lang string", "source string", "n_chars long", "__score double", "row long", "place string", "`a.b` int", "maybe int", "digest string"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7.0, k, "p", k, 0, "d") for k, (i, t) in enumerate(rows)], ", ".join(columns))
    stages = dict(corpus_pipeline.STAGES)
    #: Rows that stay; of a tuple one does.
    want = {"exact_dedup": {1, 2, 3, 4, (5, 6), 8, (9, 10)}, "minhash": {1, 2, (3, 4), 5, 6, 7, 8, (9, 10)}, "decontaminate": set(range(2, 12))}
    for name, keep in want.items():
        out = stages[name](spark, df, SF)
        assert out.columns == df.columns
        got = out.collect()
        rows_ = {r["row"] for r in got}
        assert len(got) == len(keep) and all(len(rows_ & set(k if isinstance(k, tuple) else (k,))) == 1 for k in keep), name
        assert {r["__score"] for r in got} == {7.0} and all(r["a.b"] == r["row"] for r in got)
    kept = stages["quality"](spark, df, SF)
    assert kept.columns == df.columns and {r["__score"] for r in kept.collect()} <= {7.0}
    pieces = stages["pack"](spark, df, SF).collect()
    assert {r["doc_id"] for r in pieces} == {None, 1, 2, 3, 4, 5} and len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)
