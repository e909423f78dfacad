"""Token ids packed into sequences of fixed length: concatenated and cut, or best fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from . import tokens as T


def tokenize(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part, begin, n, ids: the ids of every row's text and end_id, in a shared table.

    part is the number of the task that wrote the row, begin the number of ids before it in that
    part; ids holds little-endian integers of id_width(path) bytes. Null texts count as empty.
    """
    width = T.id_width(path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, begin = T.encoder(path).encode, TaskContext.get().partitionId(), 0
        for batch in C.batches(it, 256):
            ids = [np.append(i, end_id).astype(f"<u{width}") for i in encode(C.text_bytes(batch.column(1)))]
            n = np.array([len(i) for i in ids], np.int64)
            begins = begin + np.cumsum(n) - n
            begin += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(begins), pa.array(n), pa.array([i.tobytes() for i in ids], pa.binary())],
                ["doc_id", "part", "begin", "n", "ids"],
            )

    rows = docs.select(C.quoted(id_col).cast("long").alias("doc_id"), C.quoted(text_col).cast("string").alias("text"))
    return C.materialize(rows.mapInArrow(run, "doc_id long, part int, begin long, n long, ids binary"), "tokens", compression="zstd")


def part_offsets(tokens: DataFrame, group: int = 1000) -> DataFrame:
    """part, base: the number of ids in all parts before it; prefix sums over groups of parts, then within each."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n")).withColumn("g", F.floor(F.col("part") / group))
    groups = totals.groupBy("g").agg(F.sum("n").alias("gn"))
    before = groups.select("g", (F.sum("gn").over(Window.orderBy("g")) - F.col("gn")).alias("gb"))
    within = F.sum("n").over(Window.partitionBy("g").orderBy("part")) - F.col("n")
    return totals.withColumn("w", within).join(before, "g").select("part", (F.col("gb") + F.col("w")).alias("base"))


def concat_and_cut(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in the concatenation of all, cut into windows of the given length.

    doc_id, start (its document's ids before it), length, doc_tokens, sequence_id, offset, ids (binary, as
    in tokenize). A piece that a window's boundary cuts is recorded in both windows. Every window but
    the last is full. Each input row is one document, repeated ones too; an empty text is end_id
    alone; an empty table has no pieces.
    """
    tokens = tokenize(docs, path, end_id, id_col, text_col)
    width = T.id_width(path)
    offsets = C.materialize(part_offsets(tokens), "offsets")
    small = offsets.count() <= 1_000_000  # one row a task of the first pass

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.batches(it, 256):
            out: list[tuple] = []
            for doc, base, begin, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "base", "begin", "n", "ids")), strict=True):
                at, start = base + begin, 0
                while start < n:
                    offset = (at + start) % length
                    size = min(n - start, length - offset)
                    out.append((doc, start, size, n, (at + start) // length, offset, ids[start * width : (start + size) * width]))
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 6 + [pa.binary()], strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    rows = tokens.join(F.broadcast(offsets) if small else offsets, "part")
    return rows.select("doc_id", "base", "begin", "n", "ids").mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


class CapacityTree:
    """Open bins by free capacity: a segment tree of counts finds the fullest one that still fits."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def add(self, free: int, number: int) -> None:
        self.bins.setdefault(free, []).append(number)
        self._change(free, 1)

    def _change(self, free: int, by: int) -> None:
        node = free + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (free, number) of a bin with the least free capacity of need or more."""
        node = need + self.size
        while not self.count[node]:
            while node & 1:  # a right child: nothing more under its parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.size
        self._change(free, -1)
        return free, self.bins[free].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers by bin; every size is 1 to capacity."""
    tree, bins = CapacityTree(capacity), []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[item])
        free, number = found if found else (capacity, len(bins))
        if not found:
            bins.append([])
        bins[number].append(item)
        if free > sizes[item]:
            tree.add(free - sizes[item], number)
    return bins


def pack_best_fit(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, pad_id: int = 0, block_tokens: int = 6_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each packed sequence, of whole documents where they fit.

    sequence_id, doc_ids, starts (of each segment in its document), cu_seqlens (cumulative segment lengths
    from 0), position_resets (where positions start again at 0), ids (capacity little-endian integers
    of id_width(path) bytes, padded by pad_id). Documents longer than capacity are split without loss
    into full sequences and a rest. Tasks pack blocks of about block_tokens ids each, so only a
    block's last bins stay unfilled. Null texts count as empty: end_id alone. Each input row is one document, repeated ones and
    those without doc_id too; an empty table has no sequences. Of equal sizes the first comes first. Further columns are not read.
    """
    width = T.id_width(path)

    def pack(docs_: list, ids_: list[np.ndarray], first: int) -> pa.RecordBatch:
        pieces = [(d, at, i[at : at + capacity]) for d, i in zip(docs_, ids_, strict=True) for at in range(0, len(i), capacity)]
        bins = best_fit_decreasing([len(p[2]) for p in pieces], capacity)
        matrix = np.full((len(bins), capacity), pad_id, f"<u{width}")
        cumulative = []
        for row, items in zip(matrix, bins, strict=True):
            joined = np.concatenate([pieces[i][2] for i in items])
            row[: len(joined)] = joined
            cumulative.append([0, *np.cumsum([len(pieces[i][2]) for i in items]).tolist()])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(first, first + len(bins), dtype=np.int64)),
                pa.array([[pieces[i][0] for i in items] for items in bins], pa.list_(pa.int64())),
                pa.array([[pieces[i][1] for i in items] for items in bins], pa.list_(pa.int64())),
                pa.array(cumulative, pa.list_(pa.int32())),
                pa.array([c[:-1] for c in cumulative], pa.list_(pa.int32())),
                pa.array([row.tobytes() for row in matrix], pa.binary()),
            ],
            ["sequence_id", "doc_ids", "starts", "cu_seqlens", "position_resets", "ids"],
        )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = T.encoder(path).encode, TaskContext.get().partitionId() << 40
        held_docs, held, size = [], [], 0
        for batch in C.batches(it, 256):
            held_docs += batch.column(0).to_pylist()
            held += [np.append(i, end_id).astype(f"<u{width}") for i in encode(C.text_bytes(batch.column(1)))]
            size += sum(map(len, held[-batch.num_rows :]))
            if size >= block_tokens:
                yield (out := pack(held_docs, held, first))
                first += out.num_rows
                held_docs, held, size = [], [], 0
        if held:
            yield pack(held_docs, held, first)

    rows = docs.select(C.quoted(id_col).cast("long").alias("doc_id"), C.quoted(text_col).cast("string").alias("text"))
    C.bound_batches(docs.sparkSession)
    return rows.mapInArrow(run, "sequence_id long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, position_resets array<int>, ids binary")


def crc32_of(ids: bytes, width: int) -> int:
    """The checksum of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())
