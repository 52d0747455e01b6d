"""Guards by size, lookups, maps, design matrices, and reports beside outputs."""

import csv
import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hourline import schema, session
from hourline.functions import clean
from hourline.operators import align, features, stats, windows
from hourline.sources import sinks


def hours(spark, sizes):
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i % 5) + i / 100, float(i * i % 7)) for k, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, x double, y double")


def test_too_few_rows(spark):
    df = hours(spark, {"few": 11, "enough": 12, "many": 80})
    keys = lambda d: {r.k for r in d.select("k").distinct().collect()}
    assert keys(stats.acf(df, "x", "ts", 6, ["k"])) == {"enough", "many"}
    assert keys(stats.pacf(stats.acf(df, "x", "ts", 6, ["k"]), ["k"])) == {"enough", "many"}
    assert keys(stats.ccf(df, "x", "y", "ts", 4, ["k"])) == {"enough", "many"} and keys(stats.ccf(df, "x", "y", "ts", 4, ["k"], least=13)) == {"many"}
    assert keys(windows.decompose(df, "x", "ts", 24, ["k"])) == {"many"} and keys(windows.decompose(df, "x", "ts", 4, ["k"])) == {"enough", "many"}
    assert windows.decompose(df.where("k = 'few'"), "x", "ts", 24).count() == 0
    assert stats.vif(df, ["x", "y"]).count() == 2 and stats.vif(df.where("k = 'few'"), ["x", "y"]).count() == 0


def test_lookup_and_map(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    other = spark.createDataFrame([(1, "x", 1.0), (3, "z", None)], "k int, V string, w double")
    got = align.lookup(df, other, ["k"], "_old")
    assert got.columns == ["k", "v", "V_old", "w"]
    assert sorted((r.k, r.v, r.V_old, r.w) for r in got.collect()) == [(1, "a", "x", 1.0), (2, "b", None, None), (3, None, "z", None)]
    said = df.select(clean.mapped(F.concat(F.lit(" "), F.upper("v"), F.lit(" ")), {"A": "first", "c": "third"}).alias("m"), clean.is_entity(F.col("v"), "a").alias("e")).collect()
    assert [(r.m, r.e) for r in said] == [("first", True), (None, False), (None, False)]
    assert df.select(clean.mapped(F.col("v"), {})).first()[0] is None


def test_design(spark):
    df = spark.createDataFrame([(1, None, 2, 5.0), (2, 1.5, None, None)], "t int, trend double, lag int, y double")
    got = features.design(df, "t", ["trend", "holidays"], ["lag"], "y", missing=("holidays",))
    assert got.columns == ["t", "trend", "holidays", "lag", "y"]
    assert [tuple(r) for r in got.orderBy("t").collect()] == [(1, 0.0, 0.0, 2.0, 5.0), (2, 1.5, 0.0, 0.0, None)]
    with pytest.raises(ValueError):
        features.design(df, "t", ["weekly"], [], "y")


def test_recent(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 31),), (dt.date(2021, 6, 1),), (dt.date(2025, 1, 31),), (None,)], "d date")
    assert {r.d.year for r in windows.recent(df, "d", 60).collect()} == {2021, 2025}


def test_report_beside_output(spark, tmp_path):
    df = hours(spark, {"a": 30}).withColumn("z", F.when(F.col("x") > 1, 1.0)).coalesce(1)
    path = str(tmp_path / "out")
    sinks.write_reported(df, path, lambda d, p: sinks.write_by_year(d, p, "ts"), stage="aggregate")
    (part,) = Path(f"{path}_quality").glob("part-*.json")
    said = json.loads(part.read_text())
    assert (said["source"], said["row_count"], said["column_count"], said["files"], said["stage"]) == ("out", 30, 6, 1, "aggregate")
    assert said["columns"]["z"]["null_count"] == 6 and said["columns"]["ts"]["dtype"] == "timestamp_ntz" and said["first_time"].startswith("2024-01-01")
    assert said["bytes"] == sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_results_of_variants(spark, tmp_path):
    one = spark.createDataFrame([(0, 1.5), (1, None)], "fold int, rmse double")
    sinks.write_results({"a": one, "b": one.withColumn("r", F.lit("x"))}, str(tmp_path))
    (part,) = (tmp_path / "results_all.csv").glob("part-*")
    rows = list(csv.DictReader(part.open()))
    assert len(rows) == 4 and {(r["variant"], r["fold"], r["r"]) for r in rows} == {("a", "0", ""), ("a", "1", ""), ("b", "0", "x"), ("b", "1", "x")}
    assert (tmp_path / "results_a.json").exists() and (tmp_path / "results_b.csv").exists()


def test_rows_that_a_hash_picks(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one, two = (sorted(r.k for r in stats.sample_n(d, "k", 50).collect()) for d in (df, df.repartition(7)))
    assert one == two and len(set(one)) == 50 and one != sorted(r.k for r in stats.sample_n(df, "k", 50, seed=1).collect())


def test_columns_that_are_there(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b2 int, b1 int, c int")
    assert schema.keep_present(df, ["c", "none", "a"]).columns == ["c", "a"]
    assert schema.order_columns(df, ["c", "none"], ["b"], ["a"]).columns == ["c", "b1", "b2", "a"]
    assert schema.drop_like(df, ("b",), ("c",)).columns == ["a"]
    assert session.session("local[1]").conf.get("spark.sql.session.timeZone") == "UTC"
