"""Each text's closest reference text by the cosine of word counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import words
from ..sources.scratch import materialize
from .vector import values

#: Distinct words of all reference texts, each counted once a text, up to which they are sent to all tasks.
MATRIX_ROWS = 2_000_000
#: Cells of the matrix of texts and references, and words that both have, that a task holds at once.
CELLS = 4_000_000
#: Texts whose words a task counts at once.
TEXTS = 128


def term_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, n for every word of every text; rows of one key count as one text.

    A task counts the words of few texts at a time, and no word is shuffled: no map of a task's keys and words is held. Only texts
    whose key several rows have are grouped by key and word.
    """
    repeated = _repeated(rows, key)
    if repeated is None:
        return _counted(rows, key, text)
    again = repeated.select(F.col(key).alias(f"{key}_again"))
    same = F.col(key).eqNullSafe(F.col(f"{key}_again"))
    grouped = _counted(rows.join(again, same, "left_semi"), key, text).groupBy(key, "token").agg(F.sum("n").alias("n"))
    return _counted(rows.join(again, same, "left_anti"), key, text).unionByName(grouped)


def _repeated(rows: DataFrame, key: str) -> DataFrame | None:
    """The keys that several rows have, null as well; None if there is none."""
    repeated = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
    return None if repeated.isEmpty() else materialize(repeated, "keys")


def _counted(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, n for every word of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for at in range(0, big.num_rows, TEXTS):
                batch = big.slice(at, TEXTS)
                tokens, row, code, n = _word_counts(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), tokens.take(pa.array(code)), pa.array(n)], [key, "token", "n"])

    schema = T.StructType([rows.schema[key], T.StructField("token", T.StringType()), T.StructField("n", T.LongType())])
    return rows.select(key, words(F.col(text)).alias("words")).mapInArrow(run, schema)


def _word_counts(tokens: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words; for each text and word of it, in the order of texts: the text's place, the word's, and its number there."""
    codes = tokens.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    width = max(1, len(codes.dictionary))
    pairs, n = np.unique(text * width + codes.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return codes.dictionary, pairs // width, pairs % width, n


def closest(rows: DataFrame, references: DataFrame, key: str = "doc_id", ref_key: str = "item_id", text: str = "text", threshold: float = 0.85) -> DataFrame:
    """key, ref_key, similarity, flagged for every row; null and 0 where no word is shared; ties go to the smallest ref_key.

    The references' word counts go to all tasks as a sparse matrix, and each task keeps the best of its own texts: nothing is
    shuffled. Where they are too many for that, both sides' counts join on the word. Dots and norms are whole numbers, so
    results do not depend on the order of summing.
    """
    other = term_counts(references, ref_key, text).withColumnRenamed("n", "m")
    found = _small(other)
    if found is None:
        out = _closest_by_join(rows, other, key, ref_key, text)
    else:
        out = _closest_by_matrix(rows, found, key, ref_key, text)
    return out.withColumn("flagged", F.col("similarity") > threshold)


def _small(other: DataFrame) -> pa.Table | None:
    """The references' word counts, if they are few enough for all tasks."""
    found = other.limit(MATRIX_ROWS + 1).toArrow()
    return None if found.num_rows > MATRIX_ROWS else found


class _Matrix:
    """Word counts of references: for each word its references and counts."""

    def __init__(self, found: pa.Table, ref_key: str) -> None:
        item, m = values(found.column(ref_key).combine_chunks()), found.column("m").to_numpy()
        self.items, number = np.unique(item, return_inverse=True)
        self.norms = np.bincount(number, m * m, len(self.items)) if len(m) else np.zeros(0)
        codes = found.column("token").combine_chunks().dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        order = np.argsort(codes.indices.to_numpy(), kind="stable")
        self.tokens = codes.dictionary
        self.sizes = np.bincount(codes.indices.to_numpy(), minlength=len(self.tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.number, self.m = number[order], m[order]

    def similarities(self, tokens: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
        """Blocks of texts, by the place of the first: their similarities to all items. A block has at most CELLS cells and CELLS meetings of words, or one text."""
        n_items, n_texts = len(self.items), len(tokens)
        distinct, text, code, n = _word_counts(tokens)
        own = np.bincount(text, n * n, n_texts)
        known = pc.fill_null(pc.index_in(distinct, value_set=self.tokens), -1).to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(0, int)
        token = known[code] if len(known) else np.zeros(0, int)
        text, token, n = text[token >= 0], token[token >= 0], n[token >= 0]
        cost = np.cumsum(np.maximum(np.bincount(text, self.sizes[token], n_texts), n_items))
        first = 0
        while first < n_texts:
            end = max(first + 1, int(np.searchsorted(cost, (cost[first - 1] if first else 0) + CELLS, "right")))
            part = slice(*np.searchsorted(text, (first, end)))
            size = self.sizes[token[part]]
            at = np.repeat(self.starts[token[part]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            cell = np.repeat(text[part] - first, size) * n_items + self.number[at]
            dots = np.bincount(cell, np.repeat(n[part], size) * self.m[at], (end - first) * n_items).reshape(end - first, n_items)
            with np.errstate(divide="ignore", invalid="ignore"):
                yield first, np.where(dots > 0, dots / (np.sqrt(own[first:end])[:, None] * np.sqrt(self.norms)[None, :]), 0.0)
            first = end


def _blocks(matrix: _Matrix, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Blocks of texts' keys and their similarities to all items; batches: key, words."""
    for big in batches:
        for at in range(0, big.num_rows, TEXTS):
            batch = big.slice(at, TEXTS)
            for first, similar in matrix.similarities(batch.column(1)):
                yield batch.column(0).slice(first, len(similar)), similar


def _closest_by_matrix(rows: DataFrame, found: pa.Table, key: str, ref_key: str, text: str) -> DataFrame:
    kind, ref_kind = rows.schema[key].dataType.simpleString(), found.schema.field(ref_key).type
    ref_sql = "string" if pa.types.is_string(ref_kind) else "long"
    ref_kind = ref_kind if ref_sql == "string" else pa.int64()
    if not found.num_rows:
        return rows.select(key, F.lit(None).cast(ref_sql).alias(ref_key), F.lit(0.0).alias("similarity"))
    shared = rows.sparkSession.sparkContext.broadcast(_Matrix(found, ref_key))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        for keys, similar in _blocks(matrix, it):
            best = similar.argmax(1)
            top = similar[np.arange(len(best)), best]
            yield pa.RecordBatch.from_arrays([keys, pa.array(matrix.items[best].tolist(), ref_kind, mask=top <= 0), pa.array(top)], [key, ref_key, "similarity"])

    return rows.select(key, words(F.col(text)).alias("words")).mapInArrow(run, f"{key} {kind}, {ref_key} {ref_sql}, similarity double")


def _closest_by_join(rows: DataFrame, other: DataFrame, key: str, ref_key: str, text: str) -> DataFrame:
    own = materialize(term_counts(rows, key, text), "words")
    norms = own.groupBy(key).agg(F.sum(F.col("n") * F.col("n")).alias("own_norm"))
    ref_norms = other.groupBy(ref_key).agg(F.sum(F.col("m") * F.col("m")).alias("ref_norm"))
    dots = own.join(other, "token").groupBy(key, ref_key).agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    scored = dots.join(norms, key).join(ref_norms, ref_key).withColumn("s", F.col("dot") / (F.sqrt("own_norm") * F.sqrt("ref_norm")))
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("s")).alias("s"), F.col(ref_key).alias("r"))).alias("b"))
    return rows.select(key).join(best, key, "left").select(key, F.col("b.r").alias(ref_key), F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("similarity"))


def _prefixes(terms: DataFrame, key: str, n: str, order: DataFrame, rest: float) -> DataFrame:
    """key, token, n, df, norm (squared), tail, last: each text's rarest words, up to where the rest has less than rest of its norm.

    tail is the share of the norm after a word, last the word and frequency that end the prefix, and its own tail. A window
    covers one text's distinct words.
    """
    norms = terms.groupBy(key).agg(F.sum(F.col(n) * F.col(n)).alias("norm"))
    known = terms.join(order, "token").join(norms, key)
    square = F.col(n) * F.col(n)
    own = Window.partitionBy(key)
    up_to = F.sum(square).over(own.orderBy("df", "token").rowsBetween(Window.unboundedPreceding, 0))
    after = known.withColumn("after", F.sum(square).over(own) - up_to)
    kept = after.filter((F.col("after") + square) >= F.lit(rest * rest * (1 - 1e-12)) * F.col("norm"))
    tail = F.sqrt(F.col("after") / F.col("norm"))
    kept = kept.select(key, "token", n, "df", "norm", tail.alias("tail"))
    return kept.withColumn("last", F.max(F.struct("df", "token", "tail")).over(own))


def candidates(own: DataFrame, other: DataFrame, key: str, ref_key: str, threshold: float, rest: float | None = None) -> DataFrame:
    """key, ref_key of all pairs that may be closer than threshold, and few others; own: key, token, n; other: ref_key, token, m.

    Words are ordered from rare to frequent. Two texts that close share a word of both their prefixes: shared words that are in
    but one prefix lie after its end, where the rest of that text is too short. Only prefixes join, so frequent words, which
    few texts need in theirs, meet nowhere. A pair stays if the words its prefixes share, and the most that what follows can add, reach the threshold.
    A prefix ends where what follows has less than rest of the text's norm: the threshold, if not less; less makes longer prefixes and fewer candidates.
    """
    rest = threshold if rest is None else rest
    if not 0 < rest <= threshold:
        raise ValueError("rest must be above 0 and at most the threshold")
    shared = other.groupBy("token").agg(F.count("*").alias("k")).join(own.groupBy("token").agg(F.count("*").alias("j")), "token")
    order = shared.select("token", (F.col("k") + F.col("j")).alias("df"))
    left = _prefixes(own, key, "n", order, rest).select(key, "token", "df", "n", F.col("norm").alias("a"), F.col("tail").alias("tail_a"), F.col("last").alias("last_a"))
    right = _prefixes(other, ref_key, "m", order, rest).select(ref_key, "token", "m", F.col("norm").alias("c"), F.col("tail").alias("tail_c"), F.col("last").alias("last_c"))
    met = left.join(right, "token").groupBy(key, ref_key).agg(
        (F.sum(F.col("n") * F.col("m")) / (F.sqrt(F.first("a")) * F.sqrt(F.first("c")))).alias("part"),
        F.max(F.struct("df", "token", "tail_a", "tail_c")).alias("at"),
        F.first("last_a").alias("x"), F.first("last_c").alias("y"),
    )
    # What the prefixes don't share lies after the end of the one that ends first.
    first = F.struct("x.df", "x.token") <= F.struct("y.df", "y.token")
    more = F.least(F.col("at.tail_a") * F.col("at.tail_c"), F.when(first, F.col("x.tail") * F.col("at.tail_c")).otherwise(F.col("at.tail_a") * F.col("y.tail")))
    return met.filter(F.col("part") + more > threshold - 1e-9).select(key, ref_key)


def similar_pairs(rows: DataFrame, references: DataFrame, key: str = "doc_id", ref_key: str = "item_id", text: str = "text", threshold: float = 0.85, rest: float | None = None) -> DataFrame:
    """key, ref_key, similarity of all pairs with a cosine of word counts above threshold.

    Up to MATRIX_ROWS word counts of references go to all tasks, as in closest(), and no word of rows is shuffled or written.
    Beyond, or where rest is given, both sides may be of any size: prefixes of rare words join. Rows of one key count as one
    text; those of keys that several rows have take the join.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    rows = rows.filter(F.col(key).isNotNull())
    other = term_counts(references.filter(F.col(ref_key).isNotNull()), ref_key, text).withColumnRenamed("n", "m")
    small = _small(other) if rest is None and isinstance(references.schema[ref_key].dataType, (T.StringType, T.IntegralType)) else None
    if small is None:
        return _pairs_by_prefix(rows, other, key, ref_key, text, threshold, rest)
    repeated = _repeated(rows, key)
    if repeated is None:
        return _pairs_by_matrix(rows, small, references, key, ref_key, text, threshold)
    joined = _pairs_by_prefix(rows.join(repeated, key, "left_semi"), other, key, ref_key, text, threshold, rest)
    return _pairs_by_matrix(rows.join(repeated, key, "left_anti"), small, references, key, ref_key, text, threshold).unionByName(joined)


def _pairs_by_matrix(rows: DataFrame, found: pa.Table, references: DataFrame, key: str, ref_key: str, text: str, threshold: float) -> DataFrame:
    ref_type = references.schema[ref_key].dataType
    ref_sql, ref_kind = ("string", pa.string()) if isinstance(ref_type, T.StringType) else ("long", pa.int64())
    shared = rows.sparkSession.sparkContext.broadcast(_Matrix(found, ref_key)) if found.num_rows else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared is None:
            return
        matrix = shared.value
        for keys, similar in _blocks(matrix, it):
            own, item = np.nonzero(similar > threshold)
            if len(own):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(own)), pa.array(matrix.items[item].tolist(), ref_kind), pa.array(similar[own, item])], [key, ref_key, "similarity"])

    out = rows.select(key, words(F.col(text)).alias("words")).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {ref_key} {ref_sql}, similarity double")
    return out.withColumn(ref_key, F.col(ref_key).cast(ref_type))


def _pairs_by_prefix(rows: DataFrame, other: DataFrame, key: str, ref_key: str, text: str, threshold: float, rest: float | None) -> DataFrame:
    """candidates() are joined with all words of the two texts, and the exact similarity decides."""
    own, other = materialize(term_counts(rows, key, text), "words"), materialize(other, "words")
    found = materialize(candidates(own, other, key, ref_key, threshold, rest), "pairs")
    norms = own.join(found.select(key).distinct(), key).groupBy(key).agg(F.sum(F.col("n") * F.col("n")).alias("a"))
    ref_norms = other.groupBy(ref_key).agg(F.sum(F.col("m") * F.col("m")).alias("c"))
    dots = found.join(own, key).join(other, [ref_key, "token"]).groupBy(key, ref_key).agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    scored = dots.join(norms, key).join(ref_norms, ref_key).withColumn("similarity", F.col("dot") / (F.sqrt("a") * F.sqrt("c")))
    return scored.filter(F.col("similarity") > threshold).select(key, ref_key, "similarity")


def flags(rows: DataFrame, references: DataFrame, key: str = "doc_id", ref_key: str = "item_id", text: str = "text", threshold: float = 0.85) -> DataFrame:
    """key, n_close, flagged for every row: the number of references closer than threshold, as closest() flags it."""
    close = similar_pairs(rows, references, key, ref_key, text, threshold).groupBy(key).agg(F.count("*").alias("n_close"))
    return rows.select(key).join(close, key, "left").select(key, F.coalesce("n_close", F.lit(0)).alias("n_close"), F.col("n_close").isNotNull().alias("flagged"))
