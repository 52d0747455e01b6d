"""A session with the settings that the library counts on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf) -> SparkSession:
    """UTC, adaptive execution and microsecond timestamps; local shuffles are kept narrow."""
    b = SparkSession.builder.appName("hourline")
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS"}
    if master and master.startswith("local"):
        settings["spark.sql.shuffle.partitions"] = "8"
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written to the folder in spark.checkpoint.dir that all executors share; an error on a cluster that names none."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
