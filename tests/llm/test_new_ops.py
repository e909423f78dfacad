import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_ops import ODD, SF

from sparquill.llm import divergence, genetic, importance, tokens

#: A second ODD: null and repeated sources too, and columns whose names clash with the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, term string, place string, `a.b` int, weight int, rank int, part int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, (None, "en", "")[k % 3], (None, "s1")[k % 2], "t", "p", 1, 2, 3, 4) for k, (i, t) in enumerate(ODD)], SCHEMA)


# --- Packing by the genetic algorithm ------------------------------------------------------------


def packed(rows, capacity=2048):
    """The sequences of pieces, checked to be gapless and within capacity."""
    seq = defaultdict(list)
    for r in rows:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return seq


@pytest.mark.parametrize("cfg", [genetic.GeneticConfig(), genetic.GeneticConfig(block_items=16, reopen=2, islands=2, population=3)])
def test_genetic_pack_is_lossless_and_tight(spark, cfg):
    """Also with blocks so small that several levels are packed."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = tokens.default_path()
    rows = genetic.pack(docs, path, cfg=cfg).collect()
    own = defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    for d in docs.collect():
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        pieces = sorted(own.pop(d["doc_id"]), key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in pieces] == [(k, at, min(2048, len(ids) - at)) for k, at in enumerate(range(0, len(ids), 2048))]
        assert b"".join(r["ids"] for r in pieces) == np.array(ids, "<u2").tobytes()
    assert not own
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert len(packed(rows)) <= least + (2 if cfg == genetic.GeneticConfig() else least // 20)


def test_genetic_pack_sequences(spark):
    docs = spark.createDataFrame([(i, "word " * (37 * i % 90)) for i in range(60)], "doc_id long, text string")
    pieces = genetic.pack(docs, tokens.default_path(), 128)
    rows = genetic.sequences(pieces).collect()
    assert sum(len(r["doc_ids"]) for r in rows) == 60 and all(len(r["ids"]) == 2 * sum(r["lengths"]) <= 256 for r in rows)


def triplets(rng, n, capacity=1000):
    """Sizes of which every three fill a bin, and which best fit decreasing packs badly."""
    a = rng.integers(380, 490, n)
    b = rng.integers(250, (capacity - a) // 2 + 1)
    return np.sort(np.concatenate([a, b, capacity - a - b]))[::-1].astype(np.int64)


def test_evolution_beats_best_fit():
    sizes = triplets(np.random.default_rng(4), 40)
    cfg = genetic.GeneticConfig()
    plain = genetic.first_packing(sizes, 1000, np.random.default_rng(0), 0.0)
    islands = [[] for _ in range(cfg.islands)]
    for epoch in range(cfg.epochs):
        islands = [genetic.evolve(sizes, p, 1000, cfg, [epoch, i], i) for i, p in enumerate(islands)]
        islands = [p[:-1] + islands[i - 1][:1] for i, p in enumerate(islands)]
    best = min((p[0] for p in islands), key=lambda x: len(x.fill))
    assert 40 <= len(best.fill) < len(plain.fill)
    assert (np.bincount(best.bins, sizes) == best.fill).all() and best.fill.max() <= 1000


def test_operators_of_evolution_keep_every_piece():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50):
        sizes = np.sort(rng.integers(1, 100, n))[::-1].astype(np.int64)
        a, b = (genetic.first_packing(sizes, 100, rng, x) for x in (0.0, 0.5))
        for child in (genetic.crossover(a, b, sizes, 100, rng, 0.3), genetic.mutation(a, sizes, 100, rng)):
            assert len(child.bins) == n and (np.bincount(child.bins, sizes) == child.fill).all() and child.fill.max() <= 100


def test_least_bins():
    assert genetic.least_bins(np.array([60, 60, 60]), 100) == 3
    assert genetic.least_bins(np.array([50, 50, 50]), 100) == 2
    assert genetic.least_bins(np.array([70, 30, 30]), 100) == 2
    assert genetic.least_bins(np.array([70, 31, 30, 30]), 100) == 2
    assert genetic.least_bins(np.array([70, 70, 40, 40, 40]), 100) == 4


def test_evolution_of_a_hard_block_runs_all_epochs(spark):
    """Pieces that need several epochs, through the migration of elites, in two blocks."""
    sizes = triplets(np.random.default_rng(6), 60)
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "at long, size long")
    rows = genetic.pack_items(items, 1000, genetic.GeneticConfig(block_items=100, reopen=2)).collect()
    assert sorted(r["at"] for r in rows) == list(range(180))
    bins = packed([{"sequence_id": r["bin"], "offset": r["offset"], "length": int(sizes[r["at"]])} for r in rows], 1000)
    assert 60 <= len(bins) <= len(genetic.first_packing(sizes, 1000, np.random.default_rng(0), 0.0).fill)


def test_genetic_pack_odd_rows(spark, odd):
    rows = genetic.pack(odd, tokens.default_path()).collect()
    packed(rows)
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(i for i, _ in ODD)
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert genetic.pack(odd.limit(0), tokens.default_path()).count() == 0


# --- Source divergence -----------------------------------------------------------------------------


def audited(rows, least=3, top=200):
    """The audit of (lang, source, text) rows, term by term."""
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs, total, own = Counter(), Counter(), {s: Counter() for x, s, _ in rows if x == lang}
        for x, s, words in rows:
            if x == lang:
                docs.update(set(words))
                own[s].update(words)
        kept = [t for t in docs if docs[t] >= least]
        for c in own.values():
            total.update(c)

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        of = {s: shares(c) for s, c in own.items()}
        q = shares(total)
        for s in own:
            pairs = [(sum((of[s][t] - of[o][t]) ** 2 // of[o][t] for t in kept), o) for o in own if o != s]
            terms = [((of[s][t] - q[t]) ** 2 // q[t], t) for t in kept if own[s][t] and of[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def collected(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("cfg", [divergence.AuditConfig(), divergence.AuditConfig(top=3, block_entries=20, block_sources=2)])
def test_divergence_equals_brute_force(spark, cfg):
    """Also in blocks of few terms and sources; copies within and across sources and languages, a source without terms, a language without kept ones."""
    rng = random.Random(7)
    words = [f"w{c}" for c in "abcdefghij"] + ["É", "été", "ABC", "x1y", "naïve"]
    rows = [(rng.choice(["en", "de"]), f"s{rng.randrange(5)}", " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for _ in range(60)]
    rows += [("en", s, "one same text, one") for s in ("s1", "s1", "s2", None)] + [("de", "s1", "one same text, one"), (None, None, None), ("xx", "a", "rare"), ("xx", "b", "rarer"), ("en", "none", "1 2 3"), ("de", "S1", "One same text, one")]
    df = spark.createDataFrame([(None, *r) for r in rows], "n long, lang string, source string, text string")
    assert collected(divergence.audit(df, cfg)) == audited(rows, top=cfg.top)


def test_divergence_tokenizes_equal_texts_once(spark):
    rows = [("en", f"s{i % 3}", "a text that many copies share") for i in range(300)] + [("en", "s0", "another one")]
    texts, _ = divergence.collapsed(spark.createDataFrame(rows, "lang string, source string, text string"), "lang", "source", "text", False)
    got = {r["text"]: {c["source"]: c["m"] for c in r["copies"]} for r in texts.collect()}
    assert got == {"a text that many copies share": {"s0": 100, "s1": 100, "s2": 100}, "another one": {"s0": 1}}


def test_divergence_odd_rows(spark, odd):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    assert collected(divergence.audit(odd)) == audited(rows)
    assert divergence.audit(odd.limit(0)).count() == 0


def test_scaled_shares_are_exact(spark):
    cases = [(1, 1), (1, 3), (7, 10**15 - 1), (10**14, 3 * 10**14 + 1), (999_999_999, 10**9)]
    df = spark.createDataFrame(cases, "x long, total long")
    assert [r[0] for r in df.select(divergence._scaled(df.x, df.total)).collect()] == [1 + 10**9 * x // t for x, t in cases]


# --- Importance resampling -------------------------------------------------------------------------


def resampled(docs, target, least=20, percent=25, longest=2, buckets=10_000):
    """doc_id, n_features, weight, score, rank of (doc_id, text) rows, feature by feature."""

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(words) - k + 1)]

    found = [(i, *features(t)) for i, t in docs]
    raw, goal = (Counter(b for f in fs for b in f) for fs in ((f for _, _, f in found), (features(t)[1] for t in target)))
    size, goal_size = sum(raw.values()), sum(goal.values())
    out = []
    for i, n, f in found:
        gain = [math.floor(1000 * math.log((goal[b] + 1) * (size + buckets) / ((raw[b] + 1) * (goal_size + buckets)))) for b in f]
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain) // len(gain) if gain else 0
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return Counter((r[0], *r[2:], ranks.get(id(r))) for r in out)


def drawn(df):
    return Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect())


def test_importance_equals_brute_force(spark):
    rng = random.Random(9)
    words = ["alpha", "Beta", "g4mma", "délta", "中文", "x" * 60, "İ", "a_b"] + [f"w{i}" for i in range(300)]
    docs = [(i, rng.choice([" ", " ", ", ", "\n"]).join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(200)]
    target = [" ".join(rng.choices(words[:40], k=30)) for _ in range(5)] + [None]
    df, goal = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    assert drawn(importance.resample(df, goal)) == resampled(docs, target)
    for longest, buckets in ((3, 70_000), (1, 16)):
        cfg = importance.ImportanceConfig(longest=longest, buckets=buckets)
        assert drawn(importance.resample(df, goal, cfg)) == resampled(docs, target, longest=longest, buckets=buckets)


def test_words_survive_a_small_memory():
    few, many = importance.Words(limit=2), importance.Words()
    for text in (b"one two three four five", b"six " + b"y" * 100 + b" seven", b"one two"):
        a, b = (w.runs(w.of(text), 3) for w in (few, many))
        assert (a == b).all()
        few.room()
    assert len(few) <= 2


def test_importance_odd_rows(spark, odd):
    """Ties go to the smaller doc_id, a null one last; of rows that are equal in all, either may come first."""
    cfg = importance.ImportanceConfig(least_words=0, percent=100)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    goal = odd.select("text").limit(0)
    got = drawn(importance.resample(odd, goal, cfg))
    want = resampled(rows, [], least=0, percent=100)
    assert got == want and sorted(k[-1] for k in got) == list(range(1, len(ODD) + 1))
    assert importance.resample(odd.limit(0), goal).count() == 0
    out = importance.draw(odd, goal, importance.ImportanceConfig(percent=100))
    assert out.columns == odd.columns and [r["doc_id"] for r in out.collect()] == [6]
