"""Exact duplicates by a two-pass Bloom filter over text hashes.

The first pass counts every text's hash in a filter of saturating two-bit counters (0, 1, 2 or
more). The second finds the hashes whose counters all reached 2: every repeated hash is among
them, and next to no other. Only their rows, ids and hashes, are shuffled and compared; the rest are
unique and pass straight through. Where one filter for all rows would be too large to send to
every task, the hashes alone are dealt into ranges, each with a filter of its own, sized to its
rows. Texts are never shuffled for the decision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Counters of a filter for each row counted, and the most that a filter sent to all tasks may have (16 MB of bits; 128 MB in the tasks that count).
COUNTERS_PER_ROW = 16
MAX_COUNTERS = 1 << 27
#: At the most, rows may have as few as this many counters each.
LEAST_PER_ROW = 8
#: Rows of a range of hashes, where the filters are dealt.
RANGE_ROWS = 1 << 20
HASHES = 4
#: Counters that are merged as one row.
SLICE = 1 << 18


def normalized(text: Column) -> Column:
    """Runs of white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), C.SPACE_RE, " ")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.encode(normalized(text), "UTF-8"), 256))


def _places(digests: list[bytes], counters: int) -> np.ndarray:
    """The HASHES counters of each 32-byte digest."""
    words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)[:, :HASHES]
    return (words & C.U64(counters - 1)).astype(np.int64)


def counters_for(rows: int) -> int:
    """A power of two of counters; more than MAX_COUNTERS only where these would be under LEAST_PER_ROW a row."""
    wanted = max(1 << 13, 1 << (COUNTERS_PER_ROW * max(rows, 1) - 1).bit_length())
    return MAX_COUNTERS if wanted > MAX_COUNTERS >= LEAST_PER_ROW * rows else wanted


class RepeatFilter:
    """Saturating counters, a power of two of them."""

    def __init__(self, counters: int) -> None:
        self.counters = counters
        self.seen = np.zeros(counters, np.uint8)

    def add(self, digests: list[bytes]) -> None:
        # A row counts once in a counter that several of its hashes share.
        places = np.sort(_places(digests, self.counters), 1)
        places = places[np.concatenate((np.ones((len(places), 1), bool), places[:, 1:] != places[:, :-1]), 1)]
        once, n = np.unique(places, return_counts=True)
        self.seen[once] = np.minimum(2, self.seen[once] + np.minimum(n, 2))

    def bits(self) -> np.ndarray:
        """A bit for each counter that reached 2."""
        return np.packbits(self.seen > 1)


def maybe_repeated(bits: np.ndarray, digests: list[bytes]) -> np.ndarray:
    """Whether all counters of a digest reached 2."""
    places = _places(digests, len(bits) * 8)
    return ((bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(1)


def repeat_bits(digests: DataFrame, column: str, counters: int) -> np.ndarray:
    """The bits of one filter for all rows: each task counts its own rows, and the slices of all tasks are merged."""
    size = min(SLICE, counters)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = RepeatFilter(counters)
        for batch in C.batches(it, 65536):
            own.add(batch.column(0).to_pylist())
        for k in range(0, counters, size):
            part = own.seen[k : k + size]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // size], pa.int32()), pa.array([np.packbits(part > 0).tobytes()]), pa.array([np.packbits(part > 1).tobytes()])], ["slice", "one", "two"])

    def merge(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = two = np.zeros(size // 8, np.uint8)
        for t in tables:
            for a, b in zip(t.column("one").to_pylist(), t.column("two").to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                one, two = one | a, two | b | (one & a)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([two.tobytes()])], ["slice", "two"])

    parts = digests.select(column).mapInArrow(count, "slice int, one binary, two binary").groupBy("slice").applyInArrow(merge, "slice int, two binary")
    bits = np.zeros(counters // 8, np.uint8)
    for row in parts.toLocalIterator():
        bits[row["slice"] * size // 8 : (row["slice"] + 1) * size // 8] = np.frombuffer(row["two"], np.uint8)
    return bits


def _repeated_in_ranges(rows: DataFrame, total: int) -> DataFrame:
    """digest of every hash that two or more rows have, and next to no other: each range of hashes has a filter of its own.

    A batch's equal hashes go out as one row (twice at most), so a hash with very many rows adds little to its range.
    """
    ranges = max(2, -(-total // RANGE_ROWS))

    def once(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = pc.value_counts(batch.column(0))
            for digests in (found.field("values"), found.field("values").filter(pc.greater(found.field("counts"), 1))):
                words = np.frombuffer(b"".join(digests.to_pylist()), ">u4").reshape(-1, 8)[:, 0].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array((words * C.U64(ranges) >> C.U64(32)).astype(np.int32)), digests], ["part", "digest"])

    def own(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [t.column("digest").to_pylist() for t in tables]
        seen = RepeatFilter(counters_for(sum(map(len, held))))
        for digests in held:
            seen.add(digests)
        bits = seen.bits()
        for digests in held:
            kept = [d for d, maybe in zip(digests, maybe_repeated(bits, digests), strict=True) if maybe]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary())], ["digest"])

    return rows.select("digest").mapInArrow(once, "part int, digest binary").groupBy("part").applyInArrow(own, "digest binary").distinct()


def _marked(rows: DataFrame) -> DataFrame:
    """row, doc_id, digest and whatever else rows has, with maybe: false only for hashes that no other row has."""
    total = rows.count()
    if counters_for(total) > MAX_COUNTERS:
        found = _repeated_in_ranges(rows, total).withColumn("maybe", F.lit(True))
        return C.materialize(C.join_salted(rows, found, "digest", total, "left").withColumn("maybe", F.coalesce("maybe", F.lit(False))), "marked")
    shared = rows.sparkSession.sparkContext.broadcast(repeat_bits(rows, "digest", counters_for(total)))

    @F.pandas_udf("boolean")
    def flag(digest: pd.Series) -> pd.Series:
        return pd.Series(maybe_repeated(shared.value, digest.tolist()))

    return C.materialize(rows.withColumn("maybe", flag("digest")), "marked")


def _decided(docs: DataFrame, place: str, id_col: str, text_col: str) -> DataFrame:
    """place, doc_id, digest, keep_id, group_size, kept for every row."""
    rows = docs.select(F.col(place).alias("place"), C.quoted(id_col).cast("long").alias("doc_id"), text_digest(C.quoted(text_col)).alias("digest"))
    marked = _marked(C.materialize(rows, "digests"))
    few = marked.filter("maybe").drop("maybe")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("f")
    groups = few.groupBy("digest").agg(first, F.count("*").alias("group_size")).select("digest", F.col("f.doc_id").alias("keep_id"), F.col("f.place").alias("stays"), "group_size")
    compared = C.join_salted(few, groups, "digest", marked.count()).withColumn("kept", F.expr("place = stays")).drop("stays")
    unique = marked.filter("not maybe").drop("maybe").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    return unique.unionByName(compared)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scan: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal after white-space runs become one space; null counts as empty. One row of a group is kept, one
    with the smallest doc_id: of rows that repeat both doc_id and text a single one, and a null doc_id only in a group without any
    other. Further columns are not read; an empty table has no rows. scan as in common.placed.
    """
    rows, place = C.placed(docs, scan)
    return _decided(rows, place, id_col, text_col).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scan: bool = False) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, all columns."""
    rows, place = C.placed(docs, scan)
    return C.without(rows, place, _decided(rows, place, id_col, text_col).filter("not kept").select("place"))
