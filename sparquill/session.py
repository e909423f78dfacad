"""A SparkSession with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(name: str = "sparquill", master: str | None = None, **conf: str) -> SparkSession:
    """AQE, ANSI mode and UTC; further settings by keyword, with __ for a dot."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    own = {"spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for key, value in {**own, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
