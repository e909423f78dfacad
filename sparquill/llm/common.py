"""Helpers shared by the training-data operators: scratch tables, row places, joins, Arrow batches and word hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.scratch import scratch_path, scratch_root  # noqa: F401 (for the operators)
from ..sources.tables import spread

#: The white space of the contracts: space and the control characters 9 to 13.
SPACE_RE = r"[\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)


#: Bytes of the Arrow batches that tasks exchange with their Python workers; both hold a batch of whole texts in memory.
ARROW_BYTES = "8m"
_ARROW_KEY, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Bounds batches by ARROW_BYTES in a session that has Spark's default bound; any other setting stays. Only the size of batches depends on it, no result."""
    if spark.conf.get(_ARROW_KEY) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW_KEY, ARROW_BYTES)


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """scratch.materialize() with bounded Arrow batches."""
    bound_batches(df.sparkSession)
    return scratch.materialize(df, label, compression)


def quoted(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(columns: list[str], name: str) -> str:
    """name, or a longer one that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


#: What tells the rows of a table apart: a hash of the file's path and the row's number in the file.
PLACE = "struct<file:long,at:long>"


def placed(docs: DataFrame, scan: bool) -> tuple[DataFrame, str]:
    """docs with a column of type PLACE that no two rows share, and the column's name.

    With scan, docs is a table as it is read from Parquet files; any other table is written first. The files' own
    metadata count, whatever columns docs has.
    """
    bound_batches(docs.sparkSession)
    name = free_name(docs.columns, "place")

    def with_place(rows: DataFrame) -> DataFrame:
        meta = rows.metadataColumn("_metadata")
        return rows.select("*", F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at")).alias(name))

    if scan:
        try:
            return spread(with_place(docs)), name
        except AnalysisException:  # not read from files after all
            pass
    return spread(with_place(materialize(docs, "rows"))), name


#: Places of a file that one row of a table of bits covers: 64 numbers of 64 bits.
_SPAN = 12
#: Most bytes of such a table that are sent to all tasks, and those of a row of it.
BITS_BYTES = 64_000_000
_BITS_ROW = 640


def _bits(wanted: DataFrame) -> DataFrame:
    """file, span, bits: a bit for every place (the one column of wanted), set by partial aggregates; a place has few bytes at most, many close ones a bit each."""
    at = F.col("at.at")
    rows = wanted.toDF("at").select(F.col("at.file").alias("file"), F.shiftright(at, _SPAN).alias("span"), F.shiftright(at, 6).bitwiseAND(F.lit(63)).alias("w"), F.expr("shiftleft(1L, CAST(at.at & 63 AS INT))").alias("b"))
    words = [F.coalesce(F.bit_or(F.when(F.col("w") == k, F.col("b"))), F.lit(0).cast("long")) for k in range(64)]
    return rows.groupBy("file", "span").agg(F.array(*words).alias("bits"))


def at_places(rows: DataFrame, place: str, wanted: DataFrame, keep: bool) -> DataFrame:
    """The rows whose place is in wanted (one column), or with keep False those whose place isn't.

    wanted goes to all tasks as bits, while these have at most BITS_BYTES (some 400 million rows of a table, however many are wanted); beyond,
    rows and wanted are joined by a shuffle.
    """
    held = materialize(wanted.toDF("wanted"), "wanted")
    bits = materialize(_bits(held), "bits")
    if bits.count() * _BITS_ROW > BITS_BYTES:
        return rows.join(held, quoted(place) == F.col("wanted"), "left_semi" if keep else "left_anti")
    names = {n: free_name(rows.columns, f"__{n}") for n in ("file", "span", "bits")}
    bits = F.broadcast(bits.toDF(*names.values()))
    own, at = quoted(place), quoted(place)["at"]
    joined = rows.join(bits, (own["file"] == F.col(names["file"])) & (F.shiftright(at, _SPAN) == F.col(names["span"])), "inner" if keep else "left")
    word = F.get(F.col(names["bits"]), F.shiftright(at, 6).bitwiseAND(F.lit(63)).cast("int"))
    bit = F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    return joined.filter(F.coalesce(bit, F.lit(0)) == int(keep)).select(*map(quoted, rows.columns))


def without(rows: DataFrame, place: str, gone: DataFrame) -> DataFrame:
    """The rows whose place is not in gone (one column), without their place."""
    return at_places(rows, place, gone, False).drop(place)


def join_counted(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows with the columns of groups, which has a row for each key and the number of rows with that key as size.

    Keys with very many rows would meet in one task; they are sent to all tasks instead: 50,000 keys at
    most, as each has over 1/50,000 of the total. groups is a written table.
    """
    limit = max(1000, total // 50_000)
    hot = groups.filter(F.col(size) > limit)
    if hot.isEmpty():
        return rows.join(groups, key, how)
    own = [c for c in groups.columns if c != key]
    most = hot.select(F.col(key).alias("__key"), F.struct(*own).alias("__hot"))
    rest = groups.filter(F.col(size) <= limit).select(F.col(key).alias("__rest"), F.lit(0).alias("__none"), F.struct(*own).alias("__cold"))
    dealt = F.when(F.col("__key").isNotNull(), 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(4096)).cast("int")).otherwise(0)
    out = rows.join(F.broadcast(most), F.col(key) == F.col("__key"), "left").withColumn("__salt", dealt)
    out = out.join(rest, (F.col(key) == F.col("__rest")) & (F.col("__salt") == F.col("__none")), "left").withColumn("__own", F.coalesce("__hot", "__cold"))
    out = out.filter(F.col("__own").isNotNull()) if how == "inner" else out
    return out.select(*rows.columns, *(F.col(f"__own.{c}").alias(c) for c in own))


def join_salted(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner", share: int = 4096) -> DataFrame:
    """rows with the columns of table (a row for each key); the rows of one key are dealt into shares of about share rows where one key may have all of the total."""
    salts = total // share
    if salts < 2:
        return rows.join(table, key, how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return salted.join(salted.select(key, "__salt").distinct().join(table, key, how), [key, "__salt"], how).drop("__salt")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * _GOLDEN)


_BYTE = stream(256, 1)
_IS_SPACE = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(SPACE_BYTES, np.uint8))
_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time; a chunk's working arrays stay within the processor's cache.
CHUNK = 1 << 18
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK + 4096)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, U64(base), U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def _hash_block(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the words of one block."""
    a = np.frombuffer(text, np.uint8)
    pad = np.ones(len(a) + 2, np.int8)
    pad[1:-1] = _IS_SPACE[a]
    edges = np.flatnonzero(np.diff(pad))
    starts, ends = edges[0::2], edges[1::2]
    return starts, span_hashes(a, starts, ends)


def span_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by differences of prefix sums of a polynomial in an odd base."""
    up, down = _tables(len(a))
    sums = np.zeros(len(a) + 1, U64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def blocks(text: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """A long text in blocks of about size bytes, cut at white space."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and text[end] not in SPACE_BYTES:
            end += 1
        yield text[at:end]
        at = end


def word_hashes(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of the given texts in order: (word hashes, bounds); text i of the chunk has words bounds[i]:bounds[i + 1]."""
    held: list[bytes] = []
    size = 0

    def flush():
        starts, hashes = _hash_block(b"\n".join(held))
        at = np.cumsum([0, *(len(t) + 1 for t in held)])
        return hashes, np.searchsorted(starts, at)

    for t in texts:
        if held and size + len(t) > CHUNK:
            yield flush()
            held, size = [], 0
        if len(t) > CHUNK:
            parts = [_hash_block(b)[1] for b in blocks(t)]
            yield np.concatenate(parts), np.array([0, sum(map(len, parts))])
        else:
            held.append(t)
            size += len(t) + 1
    if held:
        yield flush()


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def batches(it: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller slices of Arrow batches, to bound a worker's memory; what earlier batches took goes back to the system."""
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        pa.default_memory_pool().release_unused()
