"""Growing record folders as streams: first writes of a cache, and the latest state of each key."""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def records(spark: SparkSession, path: str, schema: str, files: int = 100, form: str = "json") -> DataFrame:
    """New files of a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(path)


def first_writes(stream: DataFrame, time: str, delay: str = "1 hour", key: str = "key") -> DataFrame:
    """Each key once, as long as repeats come within the delay; state older than that is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


#: A folder of a batch with this file holds the newest row of every key, not only of those that changed.
_FULL = "_full"


def _files(spark: SparkSession, path: str) -> tuple[JavaObject, Callable[[str], JavaObject]]:
    """The file system of a folder, and its paths by name."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _batches(spark: SparkSession, path: str) -> list[int]:
    fs, make = _files(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(make(path))] if fs.exists(make(path)) else []
    return sorted(int(n[6:]) for n in names if re.fullmatch(r"batch=\d+", n))


def latest_state(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, compact: int = 0) -> StreamingQuery:
    """Keeps the row of the highest order for each key: the state store holds it, and every batch adds the keys that changed under path/batch=N.

    A batch that runs again writes the same folder again. latest_table() reads the newest. Storage grows with the changes; with compact,
    every so many batches write the newest row of all keys instead, and the folders before the last but one of these are deleted. A
    reader's folders thus stay until compact further batches have passed, and a batch that runs again finds all it read before.
    No column may be called batch.
    """
    if "batch" in (c.lower() for c in stream.columns):
        raise ValueError("a column called batch")
    rest = [c for c in stream.columns if c != key]
    newest = stream.groupBy(key).agg(F.max(F.struct(F.col(order).alias("__o"), F.struct(*rest).alias("r"))).alias("b"))

    def add(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, f"{path}/batch={number}"
        changed = batch.select(key, *(F.col(f"b.r.{c}").alias(c) for c in rest))
        fs, make = _files(spark, path)
        # Batches below this one are done, so nothing asks again for what came before the last full one but one.
        before = [k for k in _batches(spark, path) if k < number]
        full = [k for k in before if fs.exists(make(f"{path}/batch={k}/{_FULL}"))]
        for k in before:
            if len(full) > 1 and k < full[-2]:
                fs.delete(make(f"{path}/batch={k}"), True)
        wanted = [k for k in before if not full or k >= full[-1]]
        if not compact or len(wanted) < compact:
            changed.write.mode("overwrite").parquet(folder)
            return
        older = spark.read.schema(StructType([*changed.schema, StructField("batch", LongType())])).option("basePath", path).parquet(*(f"{path}/batch={k}" for k in wanted))
        _newest(older.unionByName(changed.withColumn("batch", F.lit(number).cast("long"))), key).write.mode("overwrite").parquet(folder)
        fs.create(make(f"{folder}/{_FULL}"), True).close()

    return newest.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(rows: DataFrame, key: str) -> DataFrame:
    """Each key's row of the highest batch."""
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, *(f"r.{c}" for c in rest))


def latest_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row of each key of latest_state()."""
    return _newest(spark.read.parquet(path), key)


def windowed_counts(stream: DataFrame, time: str, key: str, size: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts of each key and window of event time; late rows count until the watermark passes."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"))
