"""Aggregates of pixels, stations and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourline.functions.clean import classify
from hourline.operators.quantiles import quantiles
from hourline.operators.segments import meet


def daily_quality_agg(df: DataFrame, day: str, value: str, quality: str, fill: str, total: int | None = None, min_cov: float = 0.1, selective: bool = True) -> DataFrame:
    """Mean and sum over observed (or all valid) pixels and counts per day; statistics are null below int(min_cov * total) pixels."""
    observed, imputed, filled = classify(F.col(quality), F.col(fill))
    used = observed if selective else ~filled
    n = lambda c: F.count_if(c).cast("int")
    out = df.groupBy(day).agg(F.avg(F.when(used, F.col(value))).alias("mean"), F.sum(F.when(used, F.col(value))).alias("sum"), n(observed).alias("valid_count"), n(filled).alias("fill_count"), n(imputed).alias("invalid_count"))
    if total:
        had = F.col("valid_count") if selective else F.col("valid_count") + F.col("invalid_count")
        enough = had >= int(min_cov * total)
        out = out.withColumns({c: F.when(enough, F.col(c)) for c in ("mean", "sum")})
    return out.withColumn("year", F.year(day))


def station_mean(df: DataFrame, ts: str, variables: list[str], count_var: str) -> DataFrame:
    """Mean over stations without nulls and the number of stations that have count_var."""
    return df.groupBy(ts).agg(*[F.avg(v).alias(v) for v in variables], F.count(count_var).cast("int").alias("station_count"))


def box_summary(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """Quartiles, and the outermost values within 1.5 interquartile ranges of them."""
    q = quantiles(df.select(*by, v), by, [v], [0.25, 0.5, 0.75])
    q = q.select(*by, *[F.get(v, i).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = meet(df, q, by).where(F.col(v).between(low, high))
    return inside.groupBy(*by, "q1", "median", "q3").agg(F.min(v).alias("whisker_low"), F.max(v).alias("whisker_high"))


def heatmap(df: DataFrame, row: str, col: str, values: list, fn: Column) -> DataFrame:
    return df.groupBy(row).pivot(col, values).agg(fn)


def binned_mean(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """Mean of y in equal right-closed bins of x; the lowest edge is stretched by a thousandth of the range."""
    span = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.greatest(F.ceil((F.col(x) - F.col("lo")) / width), F.lit(1)).cast("int")
    rows = df.select(x, y).dropna().join(F.broadcast(span)).withColumn("bin", F.least(at, F.lit(bins))).withColumn("width", width)
    left = F.col("lo") + (F.col("bin") - 1) * F.col("width") - F.when(F.col("bin") == 1, 0.001 * (F.col("hi") - F.col("lo"))).otherwise(0)
    return rows.groupBy("bin").agg(F.avg(y).alias("mean"), F.count("*").alias("n"), F.first((left + F.col("lo") + F.col("bin") * F.col("width")) / 2).alias("centre"))


def ratio_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    """Statistics of a / b and a - b of two aligned series."""
    r, d = F.col(a) / F.nullif(F.col(b), F.lit(0)), F.col(a) - F.col(b)
    return df.agg(F.avg(r).alias("ratio_mean"), F.median(r).alias("ratio_median"), F.stddev_samp(r).alias("ratio_std"), F.max(F.abs(d)).alias("max_abs_diff"), F.avg(d).alias("diff_mean"))
