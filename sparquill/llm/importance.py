"""Importance resampling: documents drawn towards the word statistics of a target set.

A tokenizers pre-tokeniser (a regular-expression Split, nothing trained) cuts the ASCII-lowered text into words with their
byte offsets. Windows over neighbouring offset pairs are the features, runs of one to a few words, each counted in the
bucket of its CRC-32. A bucket's gain is the log ratio of its shares in the target and in the documents; a document's
weight is the mean gain of its features, and Gumbel noise from a hash of its id turns the highest scores into a draw.

Every text is pre-tokenised once: its features' buckets are written, then counted, then looked up in the gains. Only the
histograms, one number a bucket, pass through the driver.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.places import dense_places
from . import common as C

#: What stands between words: ASCII characters other than letters and digits (the text is lower-cased before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class ImportanceConfig:
    """Runs of 1 to longest words in buckets; of the documents with least_words words, percent are drawn by noise of seed."""

    longest: int = 2
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 25
    seed: int = 7


#: Longest second part for which a CRC is joined by table; CRCs before longer ones go on byte by byte.
_SHIFTS = 48


def _shift_tables() -> np.ndarray:
    """tables[n, k, v]: what byte k of a CRC-32, of value v, becomes when n bytes follow it (joining is linear over xor)."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    values = np.arange(256, dtype=np.uint32)
    tables = np.zeros((_SHIFTS + 1, 4, 256), np.uint32)
    tables[0] = values << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(_SHIFTS):
        tables[n + 1] = one[tables[n] & 255] ^ (tables[n] >> 8)
    return tables


_FLAT = _shift_tables().ravel()
_WORD = itemgetter(0)
_SPACE = np.uint32(zlib.crc32(b" "))


def _joined(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of first parts followed by second ones, from their CRCs and the second parts' bytes (_SHIFTS at most)."""
    octets = first.astype("<u4").view(np.uint8).reshape(-1, 4)
    at = lengths * 1024
    out = second ^ _FLAT.take(at + octets[:, 0])
    for k in (1, 2, 3):
        out ^= _FLAT.take(at + 256 * k + octets[:, k])
    return out


class Words(dict):
    """The number of every word met, with its CRC, the CRC of it and a space, and its bytes; at most limit words between texts."""

    def __init__(self, limit: int = 1_000_000) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import PreTokenizedString, Regex, pre_tokenizers

        self.split, self.string, self.limit = pre_tokenizers.Split(Regex(SEPARATORS), "removed"), PreTokenizedString, limit
        self.crcs, self.spaced, self.lengths = np.zeros(1024, np.uint32), np.zeros(1024, np.uint32), np.zeros(1024, np.int64)
        self.long: dict[int, bytes] = {}

    def __missing__(self, word: str) -> int:
        number, text = len(self), word.encode()
        if number == len(self.crcs):
            self.crcs, self.spaced, self.lengths = (np.resize(x, 2 * number) for x in (self.crcs, self.spaced, self.lengths))
        self.crcs[number], self.spaced[number], self.lengths[number] = zlib.crc32(text), zlib.crc32(text + b" "), len(text)
        if len(text) > _SHIFTS:
            self.long[number] = text
        self[word] = number
        return number

    def of(self, text: bytes) -> np.ndarray:
        """The numbers of a lower-cased text's words, in the order of their offsets; long texts go block by block, cut at white space."""
        found = []
        for block in C.blocks(text):
            string = self.string(block.decode())
            self.split.pre_tokenize(string)
            words = string.get_splits("original", "byte")  # each with its offsets; neighbours are the windows of runs()
            found.append(np.fromiter(map(self.__getitem__, map(_WORD, words)), np.int64, len(words)))
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def runs(self, numbers: np.ndarray, longest: int) -> np.ndarray:
        """CRCs of all windows of 1, 2 ... longest neighbouring words, joined by one space."""
        run, spaced = self.crcs.take(numbers), self.spaced.take(numbers)
        own, lengths, out = run, self.lengths.take(numbers), [run]
        for k in range(1, longest):
            size = lengths[k:]
            run = _joined(spaced[:-1], own[k:], np.minimum(size, _SHIFTS))
            for i in np.flatnonzero(size > _SHIFTS).tolist():
                run[i] = zlib.crc32(self.long[int(numbers[i + k])], int(spaced[i]))
            out.append(run)
            if k + 1 < longest:
                spaced = _joined(run, np.full(len(run), _SPACE), np.ones(len(run), np.int64))
        return np.concatenate(out)

    def room(self) -> None:
        """Forgets all words if they are too many; between texts only."""
        if len(self) > self.limit:
            self.clear()
            self.long.clear()


def features(docs: DataFrame, cfg: ImportanceConfig = ImportanceConfig(), keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keys, n_words, n_features, buckets of every row, in a shared table: buckets are little-endian integers of 2 bytes (4 beyond 65,536 buckets), in no order that counts."""
    kind = "<u2" if cfg.buckets <= 1 << 16 else "<u4"
    rows = docs.select(*(C.quoted(k) for k in keys), C.quoted(text_col).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "n_words long, n_features long, buckets binary"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in C.batches(it):
            n, held = [], []
            for text in C.text_bytes(batch.column(len(keys))):
                numbers = words.of(text.lower())
                held.append(words.runs(numbers, cfg.longest) % np.uint32(cfg.buckets))
                n.append(len(numbers))
                words.room()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(keys))), pa.array(n, pa.int64()), pa.array([len(h) for h in held], pa.int64()), pa.array([h.astype(kind).tobytes() for h in held], pa.binary())],
                [*keys, "n_words", "n_features", "buckets"],
            )

    return C.materialize(rows.mapInArrow(run, schema), "features", compression="zstd")


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, one after the other, and the bounds of its rows."""
    parts = column.to_pylist()
    bounds = np.cumsum([0, *(len(p) // np.dtype(kind).itemsize for p in parts)])
    return np.frombuffer(b"".join(parts), kind), bounds


def histogram(found: DataFrame, cfg: ImportanceConfig = ImportanceConfig()) -> np.ndarray:
    """How many features of all rows each bucket has; each task counts its own rows and sends the buckets it met."""
    kind = "<u2" if cfg.buckets <= 1 << 16 else "<u4"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cfg.buckets, np.int64)
        for batch in C.batches(it):
            total += np.bincount(_flat(batch.column(0), kind)[0], minlength=cfg.buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    counts = found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(cfg.buckets, np.int64)
    for row in counts.collect():  # a row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of a bucket's shares), one added to every bucket of both."""
    s, t = raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weighed(found: DataFrame, gain: np.ndarray, cfg: ImportanceConfig = ImportanceConfig()) -> DataFrame:
    """found with weight, the floored mean of its features' gains (0 without any), in place of the buckets."""
    kind = "<u2" if cfg.buckets <= 1 << 16 else "<u4"
    shared = found.sparkSession.sparkContext.broadcast(gain)
    keys = [c for c in found.columns if c != "buckets"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields if f.name != "buckets")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.batches(it):
            flat, bounds = _flat(batch.column(len(keys)), kind)
            sums = np.concatenate(([0], np.cumsum(shared.value[flat])))[bounds]
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(np.diff(sums) // np.maximum(n, 1))], [*keys, "weight"])

    return found.select(*keys, "buckets").mapInArrow(run, schema + ", weight long")


def _noise(doc_id, seed: int):
    """floor(-1000 * ln(-ln(u))) of a number u in (0, 1) from a hash of the id; a null id counts as an empty one."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _ranked(docs: DataFrame, target: DataFrame, cfg: ImportanceConfig, keys: tuple[str, ...], text_col: str, target_text: str) -> DataFrame:
    found = features(docs, cfg, keys, text_col)
    gain = gains(histogram(found, cfg), histogram(features(target, cfg, (), target_text), cfg))
    scored = weighed(found, gain, cfg).withColumn("score", F.col("weight") + _noise(F.col("doc_id"), cfg.seed))
    scored = C.materialize(scored, "scored")
    able = F.col("n_words") >= cfg.least_words
    drawn = scored.filter(able).count() * cfg.percent // 100
    placed = dense_places(scored.filter(able), F.desc("score"), F.asc_nulls_last("doc_id"), F.xxhash64(*keys), name="rank")
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    return placed.withColumn("rank", rank).unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, cfg: ImportanceConfig = ImportanceConfig(), id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row.

    Words are runs of ASCII letters and digits and of all other characters outside ASCII; only A-Z are lower-cased. rank numbers
    the drawn rows from 1, by score and then the smaller doc_id (a null one last), and is null for all others: those with too few words are
    never drawn. Null texts have no words; without features a row's weight is 0. Repeated rows are documents of their own. An empty target
    leaves the shares of an even one; an empty table has no rows. Further columns are not read.
    """
    rows = docs.select(C.quoted(id_col).cast("long").alias("doc_id"), C.quoted(text_col).cast("string").alias("text"))
    return _ranked(rows, target, cfg, ("doc_id",), "text", target_text).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, cfg: ImportanceConfig = ImportanceConfig(), id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", scan: bool = False) -> DataFrame:
    """The rows of docs that resample() draws, all columns; scan as in common.placed."""
    rows, place = C.placed(docs, scan)
    few = rows.select(F.col(place).alias("row"), C.quoted(id_col).cast("long").alias("doc_id"), C.quoted(text_col).cast("string").alias("text"))
    ranked = _ranked(few, target, cfg, ("row", "doc_id"), "text", target_text).filter("rank is not null").select(F.col("row").alias("__drawn"))
    return rows.join(C.materialize(ranked, "drawn"), C.quoted(place) == F.col("__drawn"), "left_semi").drop(place)
