"""Nearest vectors by an inverted file: coarse centroids, a list of rows for each, and the lists nearest to a query searched exactly.

The centroids are fitted by k-means on a sample of stated size; every row of the index goes into the list of its nearest
centroid. A search looks at the rows of a few lists only, and ranks what it finds by exact similarities. How many lists a
wanted recall takes depends on the vectors: calibrated() measures it against the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from . import vector as V

#: Rows of a list and queries of one block in a meeting, in the mean three quarters of it.
BLOCK = 8192


@dataclass(frozen=True)
class Index:
    """centroids: a row a list; rows: id, list, v and, if there is one, label."""

    centroids: np.ndarray
    rows: DataFrame


def fitted(sample: np.ndarray, n_lists: int, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """Centroids of a sample by k-means; starts far apart from each other, and a centroid without rows moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    n_lists = min(n_lists, len(sample))
    chosen = [int(rng.integers(len(sample)))]
    far = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < n_lists:
        weight = far + 1e-12
        chosen.append(int(rng.choice(len(sample), p=weight / weight.sum())))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centers = sample[chosen].copy()
    for _ in range(rounds):
        own, distance = _nearest(sample, centers)
        size = np.bincount(own, minlength=n_lists)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        new = sums / np.maximum(size, 1)[:, None]
        for i in np.flatnonzero(size == 0):
            worst = int(distance.argmax())
            new[i], distance[worst] = sample[worst], 0
        if np.allclose(new, centers):
            break
        centers = new
    return centers


def _distances(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (rows**2).sum(1)[:, None] - 2 * rows @ centers.T + (centers**2).sum(1)[None, :]


def _nearest(rows: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = _distances(rows, centers)
    own = d.argmin(1)
    return own, d[np.arange(len(rows)), own]


def build(index: DataFrame, n_lists: int, sample: int = 65_536, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", rounds: int = 20) -> Index:
    """An index of all rows with a vector. Centroids are fitted on at most sample rows, those with the smallest hashes of their ids; an empty table has no lists."""
    rows = V.prepared(index, id_col, vector_col, label_col)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    if not some.num_rows:
        return Index(np.zeros((0, 0)), rows.withColumn("list", F.lit(0)))
    centers = fitted(V.matrix_of(some.column("v")), n_lists, rounds)
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for at in range(0, big.num_rows, V.ROWS):
                batch = big.slice(at, V.ROWS)
                own, _ = _nearest(V.matrix_of(batch.column("v")), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], [*batch.schema.names, "list"])

    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), "list int"])
    return Index(centers, materialize(rows.mapInArrow(run, ddl), "lists"))


def write(index: Index, path: str) -> None:
    """Rows in a folder a list, so that a search reads those it probes, and the centroids."""
    spark = index.rows.sparkSession
    index.rows.repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.centroids)], "list int, v array<double>").write.mode("overwrite").parquet(f"{path}/centroids")


def read(spark: SparkSession, path: str) -> Index:
    centers = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["list"])
    return Index(np.array([r["v"] for r in centers], float).reshape(len(centers), -1), spark.read.parquet(f"{path}/rows"))


def _probes(asked: np.ndarray, centers: np.ndarray, probes: int) -> np.ndarray:
    """The nearest lists of every query, nearest first."""
    return np.argsort(_distances(asked, centers), axis=1, kind="stable")[:, :probes]


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", skip_self: bool = True) -> DataFrame:
    """query, id, label, sim, rank: the k best rows by dot product among those of each query's nearest lists, ties to the smallest id.

    A query set of one block is sent to all tasks, and only the lists that some query probes are read. A larger one is dealt to
    its lists, which meet the queries in blocks, so that a list with very many rows or queries is the work of many tasks.
    A query finds fewer than k rows where its lists have fewer.
    """
    own = V.prepared(queries, id_col, vector_col)
    ddl, schema = V.hit_schema(index.rows, own)
    block = own.limit(V.QUERY_BLOCK + 1).toArrow()
    if not block.num_rows or not len(index.centroids):
        return V.ranked(index.rows.sparkSession.createDataFrame([], ddl), k)
    if block.num_rows > V.QUERY_BLOCK:
        return V.ranked(_meetings(index, own, k, probes, skip_self, ddl, schema), k)
    ids, asked = V.values(block.column("id").combine_chunks()), V.matrix_of(block.column("v"))
    near = _probes(asked, index.centroids, probes)
    by_list = {int(n): np.flatnonzero((near == n).any(1)) for n in np.unique(near)}
    shared = index.rows.sparkSession.sparkContext.broadcast((ids, asked, by_list))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, vectors, members = shared.value
        best: dict[int, list[np.ndarray]] = {}
        for big in it:
            for at in range(0, big.num_rows, V.ROWS):
                batch = big.slice(at, V.ROWS)
                rows, lists = V.matrix_of(batch.column("v")), batch.column("list").to_numpy()
                row_ids, labels = V.values(batch.column("id")), V._labels(batch, batch.num_rows)
                for number in np.unique(lists).tolist():
                    here, who = np.flatnonzero(lists == number), members[number]
                    sims = np.round(vectors[who] @ rows[here].T, 9)
                    if skip_self:
                        sims[own_ids[who][:, None] == row_ids[here][None, :]] = -np.inf
                    new = [sims, np.broadcast_to(row_ids[here], sims.shape), np.broadcast_to(labels[here], sims.shape)]
                    if number in best:
                        new = [np.concatenate((a, b), 1) for a, b in zip(best[number], new, strict=True)]
                    best[number] = list(V.best_of(*new, k))
        for number, found in best.items():
            yield V.hits_batch(own_ids[members[number]], *found, schema)

    # A list of numbers, at most one for each centroid: it prunes the folders of an index that was written.
    return V.ranked(index.rows.filter(F.col("list").isin(list(by_list))).mapInArrow(run, ddl), k)


def _meetings(index: Index, own: DataFrame, k: int, probes: int, skip_self: bool, ddl: str, schema: pa.Schema) -> DataFrame:
    """Each probed list's blocks of rows with its blocks of queries."""
    spark = own.sparkSession
    shared = spark.sparkContext.broadcast(index.centroids)
    kind = own.schema["id"].dataType.simpleString()

    def dealt(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for at in range(0, big.num_rows, V.ROWS):
                batch = big.slice(at, V.ROWS)
                near = _probes(V.matrix_of(batch.column("v")), shared.value, probes)
                take = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("v").take(take), pa.array(near.ravel().astype(np.int32))], ["id", "v", "list"])

    asked = materialize(own.select("id", "v").mapInArrow(dealt, f"id {kind}, v array<double>, list int"), "probes")
    size = BLOCK * 3 // 4
    # A row a list: their number is that of the centroids.
    blocks = (
        index.rows.groupBy("list").agg(F.ceil(F.count("*") / size).alias("n_r"))
        .join(asked.groupBy("list").agg(F.ceil(F.count("*") / size).alias("n_q")), "list")
    )
    blocks = F.broadcast(materialize(blocks, "blocks"))

    def block(n: str):
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    left = asked.join(blocks, "list").select("id", "v", "list", block("n_q").alias("q"), F.explode(F.sequence(F.lit(0), (F.col("n_r") - 1).cast("int"))).alias("r"))
    right = index.rows.join(blocks, "list").select(*index.rows.columns, block("n_r").alias("r"), F.explode(F.sequence(F.lit(0), (F.col("n_q") - 1).cast("int"))).alias("q"))
    keys = ("list", "q", "r")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: V.meeting(a, b, k, skip_self, schema), ddl)


def multiplied(index: Index, queries: DataFrame, probes: int, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The share of the index that a query's lists hold, in the mean over at most 4,096 queries."""
    block = V.prepared(queries, id_col, vector_col).limit(V.QUERY_BLOCK).toArrow()
    sizes = np.zeros(len(index.centroids))
    for row in index.rows.groupBy("list").count().collect():  # a row a list
        sizes[row["list"]] = row["count"]
    return float(sizes[_probes(V.matrix_of(block.column("v")), index.centroids, probes)].sum(1).mean() / sizes.sum()) if block.num_rows else 0.0


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact hits (query, id) that were found."""
    both = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0


def calibrated(index: Index, queries: DataFrame, k: int = 10, target: float = 0.9, sample: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", margin: float = 0.02) -> int:
    """The fewest probes whose recall over a sample of queries, against the exact search, is target and margin or more.

    sample bounds the queries it is measured with, those with the smallest hashes of their ids; every one is held against all rows.
    """
    if not len(index.centroids):
        return 1
    asked = V.prepared(queries, id_col, vector_col).orderBy(F.xxhash64("id"), "id").limit(sample)
    held = asked.toArrow()
    exact = V.top_k(index.rows, asked, k, "id", "v", None)
    lists = index.rows.select("id", "list").join(exact.select("query", "id"), "id").select("query", "list").toArrow()
    if not lists.num_rows:
        return 1
    near = _probes(V.matrix_of(held.column("v")), index.centroids, len(index.centroids))
    at = {q: i for i, q in enumerate(held.column("id").to_pylist())}
    place = np.argsort(near, 1)
    ranks = place[[at[q] for q in lists.column("query").to_pylist()], lists.column("list").to_numpy()]
    share = np.cumsum(np.bincount(ranks, minlength=len(index.centroids))) / len(ranks)
    return int(np.searchsorted(share, min(1.0, target + margin))) + 1
