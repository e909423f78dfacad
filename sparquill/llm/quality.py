"""Document quality by histogram gradient-boosted trees over statistics of the text.

The trees are learned from a bounded sample of labelled rows and flattened into arrays; scoring
walks all rows of a batch down a tree at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FEATURES = (
    "log_bytes", "log_words", "mean_word", "long_words", "short_words", "distinct_words", "top_word", "top_ten_words", "distinct_pairs",
    "upper", "lower", "digit", "mark", "odd_mark", "shout", "bar", "above_ascii", "space", "newline",
    "lines_log", "mean_line", "distinct_lines", "short_lines", "capital_words", "sentence_ends", "byte_entropy", "most_repeated_line",
)

_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b"\"'(),-.:;?/", b"#$%&*+<=>@[\\]^_`{}~", b"!", b"|", range(128, 256), b" \t\r\x0b\x0c", b"\n"), 1):
    _KIND[list(_chars)] = _k


def statistics(text: bytes) -> list[float]:
    """The FEATURES of a text; all are finite, also for an empty one."""
    size = max(len(text), 1)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, counts, 11)[1:] / size
    p = counts[counts > 0] / size
    words = text.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen = Counter(words)
    top = [c for _, c in seen.most_common(10)]
    lines = [x for x in text.split(b"\n") if x.strip()]
    rows = max(len(lines), 1)
    repeated = Counter(lines)
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(lengths.sum()) / n, float((lengths > 12).sum()) / n, float((lengths < 4).sum()) / n,
        len(seen) / n, (top or [0])[0] / n, sum(top) / n, len(set(zip(words, words[1:], strict=False))) / n,
        *kinds[:4], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8], kinds[9],
        np.log1p(len(lines)), len(text) / rows, len(repeated) / rows, sum(len(x) < 30 for x in lines) / rows,
        sum(w[:1].isupper() for w in words) / n, sum(w[-1:] in b".?!" for w in words) / n, float(-(p * np.log2(p)).sum()), max(repeated.values(), default=0) / rows,
    ]


@dataclass(frozen=True)
class TreeConfig:
    """max_rows bounds the labelled rows learned from; bins, depth, rounds and rate shape the trees."""

    max_rows: int = 20_000
    bins: int = 64
    depth: int = 4
    rounds: int = 80
    rate: float = 0.12
    l2: float = 2.0
    least: float = 4.0
    threshold: float = 0.3


@dataclass(frozen=True)
class Trees:
    """Flattened full binary trees: node k has children 2k+1 and 2k+2; leaves follow the inner nodes."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, cfg: TreeConfig = TreeConfig()) -> Trees:
    """Trees that minimise the logistic loss; without rows the score is one half."""
    inner, leaves = (1 << cfg.depth) - 1, 1 << cfg.depth
    mean = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, cfg.bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    total, features, cuts, values = np.full(len(y), base), [], [], []
    for _ in range(cfg.rounds):
        prob = 1 / (1 + np.exp(-total))
        grad, hess = y - prob, prob * (1 - prob)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(cfg.depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.zeros(width)
            place = np.full((width, 2), -1)
            for f in range(x.shape[1]):
                key = (node - first) * cfg.bins + binned[:, f]
                g, h = (np.bincount(key, w, width * cfg.bins).reshape(width, -1).cumsum(1) for w in (grad, hess))
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + cfg.l2) + (gt - gl) ** 2 / (ht - hl + cfg.l2) - gt**2 / (ht + cfg.l2)
                gain[(hl * 4 < cfg.least) | ((ht - hl) * 4 < cfg.least)] = 0
                gain[:, len(edges[f]) :] = 0
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best + 1e-9
                best[better] = gain[better, k[better]]
                place[better] = np.stack((np.full(width, f), k), 1)[better]
            for i in np.flatnonzero(place[:, 0] >= 0):
                feature[first + i], cut[first + i] = place[i, 0], edges[place[i, 0]][place[i, 1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        g, h = (np.bincount(node - inner, w, leaves) for w in (grad, hess))
        leaf = cfg.rate * g / (h + cfg.l2)
        total += leaf[node - inner]
        features.append(feature)
        cuts.append(cut)
        values.append(leaf)
    return Trees(base, np.array(features), np.array(cuts), np.array(values))


def _held_out(doc_id):
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(5)) == 0


def learn(docs: DataFrame, labels: DataFrame, cfg: TreeConfig = TreeConfig(), id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees from at most cfg.max_rows labelled documents, the first by a hash of the id, none of them held out."""
    C.bound_batches(docs.sparkSession)
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = own.filter(~_held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.max_rows).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = docs.select(C.quoted(id_col).cast("long").alias("doc_id"), C.quoted(text_col).cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.batches(it):
            x = [statistics(t) for t in C.text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    # A repeated doc_id counts once, so the rows stay within the bound.
    found = rows.mapInArrow(run, "doc_id long, quality int, x array<double>").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("x").alias("x"))
    found = sorted(found.collect(), key=lambda r: r["doc_id"])
    return fit(np.array([r["x"] for r in found], float).reshape(-1, len(FEATURES)), np.array([r["quality"] for r in found], float), cfg)


def score_of(trees: Trees, spark: SparkSession) -> Callable[[Column], Column]:
    """The score of a text as a column function; null counts as empty."""
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        parts = [_scores(shared.value, [b"" if t is None else t.encode() for t in text.iloc[at : at + 512]]) for at in range(0, len(text), 512)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    return of


def _scores(trees: Trees, texts: list[bytes]) -> np.ndarray:
    return trees.score(np.array([statistics(t) for t in texts], float).reshape(-1, len(FEATURES)))


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for every row; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.batches(it):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(shared.value, C.text_bytes(batch.column(1))))], ["doc_id", "score"])

    return docs.select(C.quoted(id_col).cast("long").alias("doc_id"), C.quoted(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_below(docs: DataFrame, trees: Trees, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of threshold or more, all columns."""
    return docs.filter(score_of(trees, docs.sparkSession)(C.quoted(text_col).cast("string")) >= threshold)


def classify(docs: DataFrame, labels: DataFrame, cfg: TreeConfig = TreeConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row, repeated ones too; an empty table has no rows.

    Null and empty texts get the score of a text without words. A null doc_id counts as not held out. Labels other than 0 and 1 and
    labels without doc_id are not learned from; of several for one doc_id the greatest counts. Without any, every score
    is one half. Further columns are not read.
    """
    out = score(docs, learn(docs, labels, cfg, id_col, text_col), id_col, text_col)
    held = F.coalesce(_held_out(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cfg.threshold).cast("int").alias("predicted"))
