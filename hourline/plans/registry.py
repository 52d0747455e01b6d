"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers f(t), t giving a table by name, under its name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        if f.__name__ in QUERIES:
            raise ValueError(f"there is a query {f.__name__} already")
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 4, nudge: float = 0.0) -> DataFrame:
    """nudge moves means of cents off the ties that engines round differently."""
    return df.withColumns({c: F.round(F.col(c) + nudge if nudge else F.col(c), digits) for c in cols})


def hourly(events: DataFrame, gaps: bool = True) -> DataFrame:
    """The load series of events: ts (hour) and load; every 37th hour of the series is missing if gaps."""
    out = events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.round(F.sum("value"), 2).alias("load"))
    n = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return out.where(n % 37 != 0) if gaps else out


def daily(orders: DataFrame) -> DataFrame:
    """The daily series of orders: day and total."""
    return orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


def pixels(lineitem: DataFrame) -> DataFrame:
    """lineitem seen as pixels: day, value, quality, fill."""
    return lineitem.select(F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("value"), (F.col("l_linenumber") % 4).alias("quality"), ((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O")).alias("fill"))


#: The same series in SQL.
HOURLY = "h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, round(sum(value), 2) AS load FROM events GROUP BY 1 HAVING date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)::TIMESTAMP) % 37 <> 0)"
FULL_HOURLY = "h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, round(sum(value), 2) AS load FROM events GROUP BY 1)"
DAILY = "d AS (SELECT o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)"
PIXELS = "p AS (SELECT l_shipdate::DATE AS day, l_extendedprice AS value, l_linenumber % 4 AS quality, l_returnflag = 'A' AND l_linestatus = 'O' AS fill FROM lineitem)"
