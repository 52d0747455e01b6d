"""Joins that align series of different granularity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefixed(df: DataFrame, keys: list[str], prefix: str | None) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}" if prefix else c) for c in df.columns if c not in keys])


def join_on_hour(spine: DataFrame, df: DataFrame, ts: str = "timestamp", prefix: str | None = None) -> DataFrame:
    return spine.join(prefixed(df, [ts], prefix), ts, "left")


def join_on_day(spine: DataFrame, df: DataFrame, ts: str = "timestamp", prefix: str | None = None) -> DataFrame:
    """A day's values to each of its hours; df has a date column."""
    return spine.withColumn("date", F.to_date(ts)).join(prefixed(df, ["date"], prefix), "date", "left").drop("date")


def join_on_month(spine: DataFrame, df: DataFrame, prefix: str | None = None) -> DataFrame:
    """A month's values to each of its hours; both have year and month."""
    return spine.join(prefixed(df, ["year", "month"], prefix), ["year", "month"], "left")


def outer_chain(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of all frames; keys are merged."""
    return reduce(lambda a, b: a.join(b, keys, "outer"), frames)


def version_splice(old: DataFrame, new: DataFrame, last_old_year: int, year: str = "year") -> DataFrame:
    """Old rows up to a year and new rows after it, columns aligned by name."""
    return old.where(F.col(year) <= last_old_year).unionByName(new.where(F.col(year) > last_old_year), allowMissingColumns=True)


def match_suffix(df: DataFrame, col: str, names: DataFrame) -> DataFrame:
    """name of the first (priority) of names' suffixes that the text ends with; names: priority, suffix, name.

    A text meets the names by its own endings, one of each length that a suffix has, so any number of names will do.
    """
    lengths = F.array_distinct(F.collect_list(F.length("suffix")))
    ends = df.select(F.col(col)).distinct().join(names.agg(lengths.alias("_l"))).withColumn("_n", F.explode("_l")).where(F.length(col) >= F.col("_n"))  # one row
    ends = ends.select(col, F.right(F.col(col), F.col("_n")).alias("suffix"))
    hits = ends.join(names, "suffix")
    return df.join(hits.groupBy(col).agg(F.min_by("name", "priority").alias("name")), col, "left")


def key_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of a that b lacks."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def lookup(df: DataFrame, other: DataFrame, keys: list[str], suffix: str, cols: list[str] | None = None) -> DataFrame:
    """df with other's columns (or cols of them), null where it lacks the key; names that df has take the suffix. Of several rows of a key each makes a row."""
    cols = [c for c in other.columns if c not in keys] if cols is None else cols
    have = {c.lower() for c in df.columns}
    return df.join(other.select(*keys, *[F.col(c).alias(f"{c}{suffix}" if c.lower() in have else c) for c in cols]), keys, "left")
