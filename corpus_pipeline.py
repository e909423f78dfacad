"""Documents to training sequences: quality, exact and near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), docs being what the stage before wrote, and all but the last
return the columns of documents. Stages decide about rows, not ids: a row without a doc_id, or with one that other
rows have too, is a document of its own. Any further columns, whatever their names, come out unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparquill.llm import common, decontaminate, exact, minhash, packing, quality, tokens
from sparquill.sources.scratch import discard
from sparquill.sources.tables import spread


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier predicts to be good, or is given no labels to doubt."""
    cfg = quality.TreeConfig()
    trees = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), cfg)
    return quality.drop_below(docs, trees, cfg.threshold)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact.drop_exact_duplicates(docs, scan=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group stays."""
    return minhash.drop_near_duplicates(docs, scan=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scan=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids (as in packing.concat_and_cut), in sequences of 2048 tokens."""
    return packing.concat_and_cut(docs, tokens.default_path())


STAGES = [
    ("quality", drop_low_quality),
    ("exact_dedup", drop_copies),
    ("minhash", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

#: A learned classifier and a tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again; a stage's input goes once its output is there."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    held = None
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage_{name}")
        if held is not None:
            discard(held)
        held = docs
    return docs
