"""Benchmark passages in documents, by spaced seeds.

A mask looks at some of the words in a short window and ignores the others, so a hit survives
substituted words at ignored places. Hashes of all masks at all places of the benchmark's items
are joined with those of the documents, and each hit's alignment is verified word by word. A small
benchmark goes to all tasks as one table of seeds. Of a larger one only a bit filter does: the
document seeds that pass it are joined with the benchmark's as tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from . import common as C

#: Words are compared in lower case, of any script, and without ASCII marks.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 else c for c in range(256))


@dataclass(frozen=True)
class SeedConfig:
    """masks: 1 looks at a word, 0 ignores it; short_masks also apply to items shorter than window. However the
    unequal words of an overlap are placed, one of these masks hits it. An overlap is window aligned words of which matches are equal.

    An item shorter than window must match as a whole, with the same share of equal words; one of fewer than shortest
    words says too little to be looked for inside a text, and must be all of a document's words; with inside it is looked for,
    word for word, wherever it stands. block_bytes bounds the benchmark text that is sent to all tasks.
    """

    masks: tuple[str, ...] = ("11101011", "110100111", "1110001011", "1111011", "10100001111")
    short_masks: tuple[str, ...] = ("11011",)
    window: int = 13
    matches: int = 10
    shortest: int = 5
    inside: bool = False
    block_bytes: int = 4_000_000

    def places(self, n: int) -> set[tuple[int, ...]]:
        """The places that the masks of an item of n words look at; short items cut the masks to their length."""
        masks = self.masks if n >= self.window else self.masks + self.short_masks
        return {tuple(k for k in range(min(len(m), n)) if m[k] == "1") for m in masks}


def words_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return C.word_hashes((t if t.isascii() else t.decode().lower().encode()).translate(_PLAIN) for t in texts)


def _seeds(words: np.ndarray, places: tuple[int, ...], number: int) -> np.ndarray:
    """The hash of a mask's words at each of its places in words."""
    n = max(len(words) - places[-1], 0)
    sums = np.full(n, C.U64(number + 1))
    factors = C.stream(len(places), 31) | C.U64(1)
    for f, at in zip(factors, places, strict=True):
        sums += words[at : at + n] * f
    return C.mix64(sums)


def _whole(words: np.ndarray) -> int:
    """The hash of a short item, or of a document as short, as a whole."""
    return int(_seeds(words, tuple(range(len(words))), 1000 + len(words))[0])


def item_seeds(words: np.ndarray, cfg: SeedConfig, numbers: dict[tuple[int, ...], int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of an item's seeds."""
    if not len(words):
        return np.zeros(0, C.U64), np.zeros(0, np.int64)
    if len(words) < cfg.shortest:
        return np.array([_whole(words)], C.U64), np.zeros(1, np.int64)
    own = [_seeds(words, m, numbers[m]) for m in sorted(cfg.places(len(words)))]
    return np.concatenate(own), np.concatenate([np.arange(len(s)) for s in own])


def mask_numbers(cfg: SeedConfig) -> dict[tuple[int, ...], int]:
    """All masks that items of any length use, numbered."""
    return {m: k for k, m in enumerate(sorted({m for n in range(cfg.shortest, cfg.window + 1) for m in cfg.places(n)}))}


def document_seeds(words: np.ndarray, bounds: np.ndarray, cfg: SeedConfig, numbers: dict[tuple[int, ...], int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, the first word of each) of the seeds of consecutive texts, a mask at a time; seeds may reach over a text's end."""
    for places, k in numbers.items():
        seeds = _seeds(words, places, k)
        yield seeds, np.arange(len(seeds))
    if cfg.inside:
        for n in range(1, cfg.shortest):
            seeds = _seeds(words, tuple(range(n)), 1000 + n)
            yield seeds, np.arange(len(seeds))
        return
    short = [int(a) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if 0 < b - a < cfg.shortest]
    ends = dict(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if short else {}
    yield np.array([_whole(words[a : ends[a]]) for a in short], C.U64), np.array(short, np.int64)


def verified(words: np.ndarray, item: np.ndarray, shift: int, cfg: SeedConfig) -> tuple[int, int, int] | None:
    """First word, words and equal words of an item laid on a text from word shift on, if that is an overlap."""
    first, last = max(shift, 0), min(shift + len(item), len(words))
    size = min(cfg.window, len(item))
    if last - first < size or (len(item) < cfg.shortest and not cfg.inside and len(words) != len(item)):
        return None
    total = np.concatenate(([0], np.cumsum(words[first:last] == item[first - shift : last - shift])))
    if (total[size:] - total[:-size]).max() * cfg.window < size * cfg.matches:
        return None
    return first, last - first, int(total[-1])


class Benchmark:
    """Items with the table of their seeds."""

    def __init__(self, ids: list[int], texts: list[bytes], cfg: SeedConfig) -> None:
        self.cfg, self.ids, self.numbers = cfg, ids, mask_numbers(cfg)
        self.items = [words[a:b] for words, bounds in words_of(texts) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        seeds = [item_seeds(w, cfg, self.numbers) for w in self.items]
        hashes = np.concatenate([h for h, _ in seeds] or [np.zeros(0, C.U64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(seeds)), [len(h) for h, _ in seeds])[order]
        self.at = np.concatenate([a for _, a in seeds] or [np.zeros(0, np.int64)])[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> C.U64(44)).astype(np.int64)] = True

    def overlaps(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Text number, item number, first word, words and equal words of each verified alignment."""
        found: set[tuple[int, int, int]] = set()
        for seeds, at in document_seeds(words, bounds, self.cfg, self.numbers):
            hits = np.flatnonzero(self.seen[(seeds >> C.U64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hashes, seeds[hits], "left"), np.searchsorted(self.hashes, seeds[hits], "right")
            hits, lo, hi = hits[hi > lo], lo[hi > lo], hi[hi > lo]
            text = np.searchsorted(bounds, at[hits], "right") - 1
            for p, t, a, b in zip(at[hits].tolist(), text.tolist(), lo.tolist(), hi.tolist(), strict=True):
                found.update((t, i, p - q) for i, q in zip(self.item[a:b].tolist(), self.at[a:b].tolist(), strict=True))
        for t, i, shift in sorted(found):
            first = int(bounds[t])
            good = verified(words[first : bounds[t + 1]], self.items[i], shift - first, self.cfg)
            if good:
                yield t, i, *good


_FOUND = "item_id long, first_word long, n_words long, n_equal long"


def contaminated(
    docs: DataFrame, benchmark: DataFrame, cfg: SeedConfig = SeedConfig(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", scan: bool = False
) -> DataFrame:
    """doc_id, item_id, first_word, n_words, n_equal: the longest overlap of each document and item that have one.

    Of overlaps with as many equal words the one with more words counts, then the first. Null and empty texts and items overlap with
    nothing, nor does an empty table. Rows that repeat a doc_id, or have none, are searched each and count as one document;
    so do items. Further columns are not read. doc_id keeps its type. scan as in common.placed.
    """
    items = benchmark.select(C.quoted(item_col).cast("long").alias("item_id"), F.coalesce(C.quoted(item_text).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    if total <= cfg.block_bytes:
        block = items.collect()
        rows = docs.select(C.quoted(id_col).alias("doc_id"), C.quoted(text_col).cast("string").alias("text"))
        out = _against(spread(rows) if scan else rows, Benchmark([r["item_id"] for r in block], [r["text"].encode() for r in block], cfg))
    else:
        rows, place = C.placed(docs, scan)
        rows = rows.select(F.col(place).alias("place"), C.quoted(id_col).alias("doc_id"), C.quoted(text_col).cast("string").alias("text"))
        out = _by_tables(rows, items, cfg)
    best = F.max(F.struct("n_equal", "n_words", (-F.col("first_word")).alias("back")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", (-F.col("b.back")).alias("first_word"), "b.n_words", "b.n_equal")


def _against(rows: DataFrame, block: Benchmark) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in C.batches(it):
            first, out = 0, []
            for words, bounds in words_of(C.text_bytes(batch.column(1))):
                out += [(first + t, bench.ids[i], *rest) for t, i, *rest in bench.overlaps(words, bounds)]
                first += len(bounds) - 1
            ids = batch.column(0).take(pa.array([o[0] for o in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([o[k] for o in out], pa.int64()) for k in (1, 2, 3, 4))], ["doc_id", "item_id", "first_word", "n_words", "n_equal"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_FOUND}")


def _bit_places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return ((hashes >> C.U64(20)) & C.U64(bits - 1)).astype(np.int64), (C.mix64(hashes) & C.U64(bits - 1)).astype(np.int64)


def seed_bits(seeds: DataFrame, bits: int, size: int = 1 << 18) -> np.ndarray:
    """A filter of the hashes in seeds with two bits for each: every task sets its own, and the slices of all tasks are merged."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in it:
            for places in _bit_places(batch.column(0).to_numpy(zero_copy_only=False).view(C.U64), bits):
                own[places] = True
        for k in range(0, bits, size):
            if own[k : k + size].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // size], pa.int32()), pa.array([np.packbits(own[k : k + size]).tobytes()])], ["slice", "bits"])

    def merge(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size // 8, np.uint8)
        for t in tables:
            for b in t.column("bits").to_pylist():
                own = own | np.frombuffer(b, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([own.tobytes()])], ["slice", "bits"])

    found = np.zeros(bits // 8, np.uint8)
    for row in seeds.select("hash").mapInArrow(count, "slice int, bits binary").groupBy("slice").applyInArrow(merge, "slice int, bits binary").toLocalIterator():
        found[row["slice"] * size // 8 : (row["slice"] + 1) * size // 8] = np.frombuffer(row["bits"], np.uint8)
    return found


def _by_tables(rows: DataFrame, items: DataFrame, cfg: SeedConfig, salts: int = 16, few: int = 300_000, most_bits: int = 1 << 28) -> DataFrame:
    """The same for a benchmark of any size, in one scan of the documents (place, doc_id, text) for their seeds.

    The filter has 16 bits a seed, 32 MB at most. Seeds that many documents or items share are dealt over salts.
    """
    numbers = mask_numbers(cfg)
    items = C.materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")

    def of_items(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.batches(it, 256):
            texts = (words[a:b] for words, bounds in words_of(C.text_bytes(batch.column(1))) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            for item, words in zip(batch.column(0).to_pylist(), texts, strict=True):
                hashes, at = item_seeds(words, cfg, numbers)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(len(at), item, np.int64)), pa.array(at)], ["hash", "item", "at"])

    seeds = C.materialize(items.select("item", "text").mapInArrow(of_items, "hash long, item long, at long"), "seeds")
    bits = min(most_bits, max(1 << 18, 1 << (16 * seeds.count()).bit_length()))
    shared = rows.sparkSession.sparkContext.broadcast(seed_bits(seeds, bits))

    def of_documents(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in C.batches(it):
            first = 0
            for words, bounds in words_of(C.text_bytes(batch.column(1))):
                for hashes, at in document_seeds(words, bounds, cfg, numbers):
                    good = np.ones(len(hashes), bool)
                    for p in _bit_places(hashes, bits):
                        good &= (table[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 > 0
                    text = np.searchsorted(bounds, at[good], "right") - 1
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + text)), pa.array(hashes[good].view(np.int64)), pa.array(at[good] - bounds[text])], ["place", "hash", "p"])
                first += len(bounds) - 1

    hits = rows.select("place", "text").mapInArrow(of_documents, f"place {C.PLACE}, hash long, p long").withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(salts)).cast("int"))
    dealt = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = C.materialize(hits.join(dealt, ["hash", "salt"]).select("place", "item", (F.col("p") - F.col("at")).alias("shift")).distinct(), "pairs")
    n = pairs.count()
    laid = C.join_salted(pairs, items.select("item", "item_id", F.col("text").alias("item_text")), "item", n)
    laid = rows.join(F.broadcast(laid) if n <= few else laid, "place").select("doc_id", "text", "item_id", "item_text", "shift")

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, C.U64))
        for batch in C.batches(it, 64):
            out = []
            items_ = (words[a:b] for words, bounds in words_of(C.text_bytes(batch.column("item_text"))) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            for k, (text, item, shift) in enumerate(zip(C.text_bytes(batch.column("text")), items_, batch.column("shift").to_pylist(), strict=True)):
                if text != last[0]:
                    last = (text, next(words_of([text]))[0])
                good = verified(last[1], item, shift, cfg)
                if good:
                    out.append((k, *good))
            kept = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(kept), batch.column("item_id").take(kept), *(pa.array([o[k] for o in out], pa.int64()) for k in (1, 2, 3))], ["doc_id", "item_id", "first_word", "n_words", "n_equal"])

    return laid.mapInArrow(check, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_FOUND}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cfg: SeedConfig = SeedConfig(), text_col: str = "text", scan: bool = False) -> DataFrame:
    """The rows of docs without an overlap, all columns; each row by itself, whatever its doc_id."""
    rows, place = C.placed(docs, scan)
    return C.without(rows, place, contaminated(rows, benchmark, cfg, id_col=place, text_col=text_col).select("doc_id").distinct())
