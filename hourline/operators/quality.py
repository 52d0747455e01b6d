"""Profiles, coverage and gap reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourline.functions.clean import year_hours
from hourline.operators.align import key_diff
from hourline.operators.windows import gap_ranges


def profile(df: DataFrame) -> DataFrame:
    """column, dtype, null_count, null_pct and row_count of each column, from one aggregate."""
    kinds = dict(df.dtypes)
    nulls = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.count_if(F.col(c).isNull()).alias("null_count")) for c in df.columns])
    out = df.agg(F.count("*").alias("row_count"), nulls.alias("m")).select("row_count", F.inline("m"))
    return out.select("column", "dtype", "null_count", F.round(100 * F.col("null_count") / F.nullif(F.col("row_count"), F.lit(0)), 2).alias("null_pct"), "row_count")


def basic_stats(df: DataFrame, v: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"))


def year_coverage(df: DataFrame, ts: str) -> DataFrame:
    """Distinct hours of each year against the hours it has."""
    out = df.groupBy(F.year(ts).alias("year")).agg(F.count_distinct(F.date_trunc("hour", ts)).alias("hours"))
    expected = year_hours(F.col("year"))
    return out.withColumn("expected", expected).withColumn("pct", F.round(100 * F.col("hours") / expected, 2))


def missing_years(df: DataFrame, year: str) -> DataFrame:
    span = df.agg(F.min(year).alias("a"), F.max(year).alias("b")).where("a is not null")
    return span.select(F.explode(F.sequence("a", "b")).alias(year)).join(df.select(year).distinct(), year, "left_anti")


def source_coverage(df: DataFrame, cols: list[str], warn_below: float = 85.0) -> DataFrame:
    """column, present, pct and status on the spine df."""
    m = F.array(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("present")) for c in cols])
    out = df.agg(F.count("*").alias("rows"), m.alias("m")).select("rows", F.inline("m"))
    pct = 100 * F.col("present") / F.nullif(F.col("rows"), F.lit(0))
    return out.select("column", "present", F.round(pct, 2).alias("pct"), F.when(pct < warn_below, "warning").otherwise("ok").alias("status"))


def gap_report(df: DataFrame, ts: str, unit: str, first: int = 50) -> DataFrame:
    """The first gap ranges, numbered, with the number of ranges and of missing keys in all."""
    gaps = gap_ranges(df, ts, unit)
    every = gaps.agg(F.count("*").alias("ranges"), F.sum("length").alias("missing"))
    top = gaps.orderBy("gap_start").limit(first)
    return top.withColumn("n", F.row_number().over(W.orderBy("gap_start"))).crossJoin(every)  # first rows at most, and one row


def alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of only one of two products."""
    return key_diff(a, b, key).withColumn("only_in", F.lit("a")).unionByName(key_diff(b, a, key).withColumn("only_in", F.lit("b")))


def document(profile_df: DataFrame, source: str) -> DataFrame:
    """A profile as one nested row, to be written as JSON."""
    entry = F.struct("column", F.struct("dtype", "null_count", "null_pct").alias("p"))
    return profile_df.agg(F.lit(source).alias("source"), F.max("row_count").alias("row_count"), F.map_from_entries(F.collect_list(entry)).alias("columns"))
