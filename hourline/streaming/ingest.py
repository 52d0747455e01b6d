"""Incremental ingestion: new files only, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourline.sources.sinks import write_new_partitions


def ingest_new(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, day: str) -> None:
    """Reads the Parquet files that came since the last run into partitions of year, day and file (src, a hash of its path).

    A file that comes late adds to its day, and a batch that is run again after a crash replaces what it wrote of the same files.
    """

    def put(batch: DataFrame, _: int) -> None:
        write_new_partitions(batch.withColumn("year", F.year(day)), target, ["year", day, "src"])

    stream = spark.readStream.schema(schema).parquet(source)
    named = stream.select("*", F.hex(F.xxhash64("_metadata.file_path")).alias("src"))
    named.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def hourly_means(stream: DataFrame, ts: str, value: str, late: str = "2 hours") -> DataFrame:
    """Event-time hourly means of a stream; rows later than late are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour")).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "mean", "n")
