"""Exact nearest vectors of a query set, in blocks, and scores of what is found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries sent to the tasks at once.
QUERY_BLOCK = 4096
#: Queries and rows of the blocks that a larger query set is dealt into, in the mean three quarters of it.
BLOCK = 8192
#: Rows of a batch that are multiplied at once.
ROWS = 4096


def values(column: pa.Array) -> np.ndarray:
    """Ids or labels as an array whose order is that of SQL: numbers, or texts by code points; nulls only where the column is all null."""
    if pa.types.is_null(column.type) or column.null_count == len(column):
        return np.zeros(len(column), np.int64)
    return np.array(column.to_pylist(), dtype=str) if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)


def matrix_of(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best_of(sims: np.ndarray, found: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k best by similarity, ties to the smallest id."""
    order = np.lexsort((found, -sims))[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in (sims, found, labels))


def hits_batch(own: np.ndarray, sims: np.ndarray, found: np.ndarray, labels: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """The best of every query as rows; what is -inf is none."""
    good = sims.ravel() > -np.inf
    columns = {"query": np.repeat(own, sims.shape[1]), "id": found.ravel(), "label": labels.ravel(), "sim": sims.ravel()}
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name][good].tolist(), f.type) for f in schema], schema=schema)


def hit_schema(index: DataFrame, queries: DataFrame) -> tuple[str, pa.Schema]:
    """The columns of hits, as Spark and Arrow name them; ids are long or string, a label is there if index has one."""
    of = {"query": (queries, "id"), "id": (index, "id"), **({"label": (index, "label")} if "label" in index.columns else {})}
    kinds = {name: "string" if df.schema[c].dataType.simpleString() == "string" else "long" for name, (df, c) in of.items()}
    kinds["sim"] = "double"
    arrow = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    return ", ".join(f"{n} {k}" for n, k in kinds.items()), pa.schema([(n, arrow[k]) for n, k in kinds.items()])


def prepared(rows: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """id, v and, if there is such a column, label: ids and labels that are texts stay so, all others become long. Rows without a vector go."""

    def plain(name: str):
        return F.col(name) if rows.schema[name].dataType.simpleString() == "string" else F.col(name).cast("long")

    label = [plain(label_col).alias("label")] if label_col and label_col in rows.columns else []
    return rows.filter(F.col(vector_col).isNotNull()).select(plain(id_col).alias("id"), *label, F.col(vector_col).cast("array<double>").alias("v"))


def _labels(table, rows: int) -> np.ndarray:
    return values(table.column("label") if isinstance(table, pa.RecordBatch) else table.column("label").combine_chunks()) if "label" in table.schema.names else np.zeros(rows, np.int64)


def _best(index: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, skip_self: bool, ddl: str, schema: pa.Schema) -> DataFrame:
    """query, id, label, sim: each task's k best of every query of the block."""
    shared = index.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries = shared.value
        sims = found = labels = None
        for big in it:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                new = np.round(queries @ matrix_of(batch.column("v")).T, 9)
                row_ids, row_labels = values(batch.column("id")), _labels(batch, batch.num_rows)
                if skip_self:
                    new[own[:, None] == row_ids[None, :]] = -np.inf
                parts = [new, np.broadcast_to(row_ids, new.shape), np.broadcast_to(row_labels, new.shape)]
                if sims is not None:
                    parts = [np.concatenate((a, b), 1) for a, b in zip((sims, found, labels), parts, strict=True)]
                sims, found, labels = best_of(*parts, k)
        if sims is not None:
            yield hits_batch(own, sims, found, labels, schema)

    return index.mapInArrow(run, ddl)


def top_k(index: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", skip_self: bool = True) -> DataFrame:
    """query, id, label, sim, rank: the k nearest rows of index by dot product, or all if it has fewer; ties go to the smallest id.

    Ids are whole numbers or texts, as in an index file; without a column label_col the hits have no label. A query set of one block is sent
    to all tasks. A larger one is dealt, as the index is, into blocks: each block of queries meets each block of the index once, and the best
    of every meeting are merged. Rows without a vector are not found.
    Similarities are in double precision, rounded to nine places before they are ranked.
    """
    rows, own = prepared(index, id_col, vector_col, label_col), prepared(queries, id_col, vector_col)
    ddl, schema = hit_schema(rows, own)
    block = own.limit(QUERY_BLOCK + 1).toArrow()
    if block.num_rows <= QUERY_BLOCK:
        empty = rows.limit(0).select(F.col("id").alias("query"), "id", *(["label"] if "label" in rows.columns else []), F.lit(0.0).alias("sim"))
        out = _best(rows, values(block.column("id").combine_chunks()), matrix_of(block.column("v")), k, skip_self, ddl, schema) if block.num_rows else empty
    else:
        out = _meetings(rows, own, k, skip_self, ddl, schema)
    return ranked(out, k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def meeting(asked: pa.Table, there: pa.Table, k: int, skip_self: bool, schema: pa.Schema) -> pa.Table:
    """The k best of every row of asked in there, 256 of them at a time."""
    if not asked.num_rows or not there.num_rows:
        return schema.empty_table()
    a, b = (values(t.column("id").combine_chunks()) for t in (asked, there))
    x, y = matrix_of(asked.column("v")), matrix_of(there.column("v"))
    labels, out = _labels(there, len(b)), []
    for at in range(0, len(a), 256):
        sims = np.round(x[at : at + 256] @ y.T, 9)
        if skip_self:
            sims[a[at : at + 256, None] == b[None, :]] = -np.inf
        best = best_of(sims, np.broadcast_to(b, sims.shape), np.broadcast_to(labels, sims.shape), k)
        out.append(hits_batch(a[at : at + 256], *best, schema))
    return pa.Table.from_batches(out, schema)


def _meetings(rows: DataFrame, own: DataFrame, k: int, skip_self: bool, ddl: str, schema: pa.Schema) -> DataFrame:
    """query, id, label, sim: the k best of every query in every block of the index."""
    n_own, n_rows = (max(1, -(-df.count() // (BLOCK * 3 // 4))) for df in (own, rows))
    left = own.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("r"))
    right = rows.select("*", F.pmod(F.xxhash64("id"), F.lit(n_rows)).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(n_own - 1))).alias("q"))
    return left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(lambda asked, there: meeting(asked, there, k, skip_self, schema), ddl)


def retrieval_summary(hits: DataFrame, gold: DataFrame, k: int = 50) -> DataFrame:
    """query, top1_id, recall, mean_sim, retrieval_score; gold: query and the label that counts as a hit."""
    joined = hits.join(gold, "query")
    out = joined.groupBy("query").agg(
        F.min_by("id", "rank").alias("top1_id"),
        F.max((F.col("label") == F.col("gold_label")).cast("double")).alias("recall"),
        F.round(F.avg("sim"), 4).alias("mean_sim"),
    )
    return out.withColumn("retrieval_score", F.round(0.5 * F.col("recall") + 0.5 * F.col("mean_sim"), 6))


def gold_recall(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """query, rank, recall: the place of each query's gold id among its hits, null and recall 0 where it is not there; gold: query, gold_id."""
    found = hits.select("query", F.col("id").alias("gold_id"), "rank").join(gold, ["query", "gold_id"], "right")
    return found.select("query", "rank", F.col("rank").isNotNull().cast("double").alias("recall"))


def reward_similarity(hits: DataFrame, size: int, k: int = 50) -> DataFrame:
    """query, mean_sim over the k nearest of an index of the given size, of all but one at most."""
    most = min(k, max(1, size - 1))
    return hits.filter(F.col("rank") <= most).groupBy("query").agg(F.avg("sim").alias("mean_sim"))


def judge_summary(hits: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    """query, max_score, mean_score of a judge (scores: query, id, score; none counts as 0) over the k nearest, rounded to four places."""
    rows = hits.filter(F.col("rank") <= k).join(scores.select("query", "id", "score"), ["query", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return rows.groupBy("query").agg(F.round(F.max("score"), 4).alias("max_score"), F.round(F.avg("score"), 4).alias("mean_score"))
