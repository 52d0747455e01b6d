"""Writers: year partitions, single files, reports and stages that skip finished work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourline.operators.quality import document, profile
from hourline.operators.reports import table_profile


def write_by_year(df: DataFrame, path: str, sort: str, ts: str | None = None) -> None:
    """One sorted file a year."""
    out = df if "year" in df.columns else df.withColumn("year", F.year(ts or sort))
    out.repartition("year").sortWithinPartitions("year", sort).write.mode("overwrite").option("compression", "snappy").partitionBy("year").parquet(path)


def write_new_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that df has."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_single(df: DataFrame, path: str) -> None:
    """One file, for small tables."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    df.coalesce(1).write.mode("overwrite").format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)


def write_reported(df: DataFrame, path: str, write: Callable[[DataFrame, str], None], ts: tuple[str, ...] = ("timestamp", "ts", "date", "day"), source: str | None = None, **extra) -> None:
    """Writes a table and beside it, at path with _quality behind, a JSON report of what was written: source, rows, columns (type, nulls), time range, files and bytes, and extra facts."""
    write(df, path)
    out = df.sparkSession.read.parquet(path)
    sizes = {c: F.col(c) for c in table_profile(out, ts).columns}
    facts = table_profile(out, ts).select(*[c.cast("string").alias(n) if "time" in n else c.alias(n) for n, c in sizes.items()])
    columns = document(profile(out), source or path.rstrip("/").rsplit("/", 1)[-1]).drop("row_count")
    report = columns.crossJoin(facts).withColumns({k: F.lit(v) for k, v in extra.items()})  # a row each
    write_report(report, f"{path.rstrip('/')}_quality")


def write_results(results: dict[str, DataFrame], folder: str, name: str = "results") -> None:
    """Each variant's small table of results as CSV and JSON, and all of them in one CSV with their variant."""
    every = None
    for variant, df in results.items():
        for kind in ("csv", "json"):
            write_report(df, f"{folder}/{name}_{variant}.{kind}", kind)
        own = df.select(F.lit(variant).alias("variant"), "*")
        every = own if every is None else every.unionByName(own, allowMissingColumns=True)
    if every is not None:
        write_report(every, f"{folder}/{name}_all.csv", "csv")


def done(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], write: Callable[[DataFrame, str], None], force: bool = False) -> bool:
    """Makes and writes a table unless its success marker is there; True if it did."""
    if done(spark, path) and not force:
        return False
    write(make(), path)
    return True
