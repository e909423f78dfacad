"""Resolved references kept up to date: only keys that a change touches are computed again, and only their files replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import discard, materialize
from .relational import resolved_references


def changed_keys(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """The keys whose rows differ between two states of a table, by the number of times that each row is there.

    A partial aggregate over both states, for tables that come without a list of changes. Columns must be comparable (no maps).
    """
    rows = before.withColumn("__d", F.lit(-1)).unionByName(now.withColumn("__d", F.lit(1)))
    return rows.groupBy(*before.columns).agg(F.sum("__d").alias("__d")).filter("__d <> 0").select(key).distinct()


def touched_keys(edges: DataFrame, edge_keys: DataFrame, paper_ids: DataFrame, key: str, ref: str) -> DataFrame:
    """key: those with changed edges (edge_keys, also of edges that are gone) and those with an edge to a changed paper (paper_ids: id)."""
    through = edges.join(paper_ids.select(F.col("id").alias(ref)), ref, "left_semi").select(key)
    return edge_keys.select(key).unionByName(through).filter(F.col(key).isNotNull()).distinct()


def recomputed(touched: DataFrame, edges: DataFrame, papers: DataFrame, key: str, ref: str, order: str, least: int = 0) -> DataFrame:
    """resolved_references() of the touched keys alone. edges and papers are the tables as they are now.

    Only papers that such edges name take part, so that few touched keys move few papers.
    """
    own = edges.join(touched, key, "left_semi")
    asked = papers.join(own.select(F.col(ref).alias("id")).distinct(), "id", "left_semi")
    return resolved_references(own, asked, key, ref, order, least)


def refreshed(current: DataFrame, touched: DataFrame, edges: DataFrame, papers: DataFrame, key: str, ref: str, order: str, least: int = 0) -> DataFrame:
    """What resolved_references() gives for edges and papers, from its former result: other keys keep their rows as they are."""
    new = recomputed(touched, edges, papers, key, ref, order, least)
    return current.join(touched, key, "left_anti").select(*new.columns).unionByName(new)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(rows: DataFrame, path: str, key: str, buckets: int = 256) -> None:
    """A table of rows by key in folders bucket=0 to buckets - 1, for replace_keys(). Rows without a key are left out."""
    kept = rows.filter(F.col(key).isNotNull()).withColumn("bucket", bucket_of(key, buckets))
    kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col(key).isNotNull()).drop("bucket")


def replace_keys(spark: SparkSession, path: str, touched: DataFrame, new: DataFrame, key: str, buckets: int = 256) -> None:
    """Replaces the rows of the touched keys of a table of write_buckets() by those of new; other buckets' files stay as they are.

    The buckets are written to scratch first and then moved over the old ones. A bucket that loses its last row keeps a row without a
    key, which readers leave out. If it fails half-way, the same call again brings the table to the same state. One writer at a time.
    """
    places = materialize(touched.select(key, bucket_of(key, buckets).alias("bucket")).distinct(), "touched")
    hit = sorted(r["bucket"] for r in places.select("bucket").distinct().collect())  # at most one a bucket
    if not hit:
        discard(places)
        return
    own = T.StructType([*new.schema.fields, T.StructField("bucket", T.IntegerType())])
    old = spark.read.schema(own).parquet(path).filter(F.col("bucket").isin(hit) & F.col(key).isNotNull())
    kept = old.join(places.select(key), key, "left_anti").select(*own.names)
    fresh = new.join(places.select(key), key, "left_semi").withColumn("bucket", bucket_of(key, buckets)).select(*own.names)
    marks = places.select("bucket").distinct().select(*(F.col("bucket") if f.name == "bucket" else F.lit(None).cast(f.dataType).alias(f.name) for f in own))
    whole = materialize(kept.unionByName(fresh).unionByName(marks), "buckets")
    whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    discard(whole)
    discard(places)
