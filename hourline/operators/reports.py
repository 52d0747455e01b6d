"""Reports over whole tables, and guards by their size; each is one or two aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.functions.clean import safe_div, year_hours
from hourline.operators.quality import missing_years


def table_profile(df: DataFrame, ts: tuple[str, ...] = (), files: bool = True) -> DataFrame:
    """row_count, column_count, first_time and last_time of the first of the columns ts that df has, and, if df is read from files, files and bytes."""
    time = next((c for c in ts if c in df.columns), None)
    aggs = [F.count("*").alias("row_count"), F.lit(len(df.columns)).alias("column_count")]
    aggs += [f(time).alias(n) if time else F.lit(None).cast("timestamp_ntz").alias(n) for f, n in ((F.min, "first_time"), (F.max, "last_time"))]
    if not files:
        return df.agg(*aggs)
    # sizes count once a file, so files are grouped first; partial results meet, never rows
    per_file = [F.count("*").alias("n"), F.max("_metadata.file_size").alias("bytes")]
    per_file += [f(time).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))] if time else []
    each = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(*per_file)
    times = [F.min("low").alias("first_time"), F.max("high").alias("last_time")] if time else aggs[2:]
    return each.agg(F.sum("n").alias("row_count"), aggs[1], *times, F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def ingest_report(df: DataFrame, coords: list[str], value: str) -> DataFrame:
    """Of a table read from files: files, rows, the rows of the smallest and the largest file, the range of each coordinate and the share of nulls of value."""
    ranges = [f(c).alias(f"{c}_{n}") for c in coords for f, n in ((F.min, "min"), (F.max, "max"))]
    each = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("nulls"), *ranges)
    total = [(F.min if n == "min" else F.max)(f"{c}_{n}").alias(f"{c}_{n}") for c in coords for n in ("min", "max")]
    pct = F.round(100 * F.sum("nulls") / F.sum("n"), 2).alias("null_pct")
    return each.agg(F.count("*").alias("files"), F.sum("n").alias("rows"), F.min("n").alias("least_rows"), F.max("n").alias("most_rows"), *total, pct)


def load_report(df: DataFrame, ts: str, v: str) -> DataFrame:
    """Of each year: hours seen and expected, their share, and low, high, mean and std of v."""
    stats = [F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")]
    out = df.groupBy(F.year(ts).alias("year")).agg(F.count_distinct(F.date_trunc("hour", ts)).alias("hours"), *stats)
    expected = year_hours(F.col("year"))
    return out.withColumn("expected", expected.cast("long")).withColumn("pct", F.round(100 * F.col("hours") / expected, 2))


def variable_report(df: DataFrame, ts: str, by: str, v: str) -> DataFrame:
    """Of each variable: share of nulls, low, high, mean, hours seen, and hours and share of the span of its own first to last hour."""
    hour = F.date_trunc("hour", ts)
    stats = [F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.min(hour).alias("first"), F.max(hour).alias("last")]
    out = df.groupBy(F.col(by).alias("variable")).agg(F.round(100 * F.count_if(F.col(v).isNull()) / F.count("*"), 2).alias("null_pct"), F.count_distinct(hour).alias("hours"), *stats)
    span = F.expr("timestampdiff(HOUR, first, last) + 1")
    return out.withColumn("expected", span).withColumn("pct", F.round(100 * F.col("hours") / span, 2)).drop("first", "last")


def monthly_report(df: DataFrame, year: str, month: str) -> DataFrame:
    """first_year, last_year, months and missing (the years between that have no row) of a monthly table."""
    seen = df.agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_distinct(F.col(year) * 12 + F.col(month)).alias("months"))
    gone = missing_years(df, year).agg(F.array_join(F.sort_array(F.collect_list(F.col(year).cast("string"))), ",").alias("missing"))
    return seen.crossJoin(gone)  # a row each


def violations(df: DataFrame, key: str, parts: list[str], expected: int) -> DataFrame:
    """Keys whose parts don't add up to what is expected, with the sum and by how much it differs."""
    seen = sum((F.col(c) for c in parts), F.lit(0)).cast("long")
    return df.select(key, seen.alias("seen"), (seen - expected).alias("off")).where("off <> 0")


def coverage_report(df: DataFrame, cols: list[str], warn_below: float = 85.0) -> DataFrame:
    """column, rows, present, pct, mean, std and status (a warning below the threshold) of columns on a spine."""
    m = F.array(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("present"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")) for c in cols])
    out = df.agg(F.count("*").alias("rows"), m.alias("m")).select("rows", F.inline("m"))
    pct = 100 * safe_div(F.col("present"), F.col("rows"))
    return out.select("column", "rows", "present", F.round(pct, 2).alias("pct"), "mean", "std", F.when(pct < warn_below, "warning").otherwise("ok").alias("status"))


def enough(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The rows of the groups that have at least so many rows; for statistics that mean nothing on fewer."""
    big = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return df.join(big, keys, "left_semi")
