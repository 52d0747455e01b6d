"""Folds, their training statistics and the linear forecast, against plain numpy."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourline.operators import align, evaluate, features


def days(spark, n=1500):
    rng = random.Random(3)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), None if rng.random() < 0.1 else rng.gauss(5, 2), None if rng.random() < 0.1 else i % 7 + rng.random()) for i in range(n)]
    return spark.createDataFrame(rows, "day date, y double, a double").repartition(4), rows


def fold_rows(spark, df):
    folds = features.rocv_folds(df, "day", 2, 1, [30, 90])
    return folds, [(r.fold, r.cutoff, r.horizon_days) for r in folds.collect()]


def test_split(spark):
    df, rows = days(spark)
    folds, plain = fold_rows(spark, df)
    want = {(f, h, d, "train" if d < c else "test") for f, c, h in plain for d, *_ in rows if d < c + dt.timedelta(days=h)}
    for parts in (("train", "test"), ("train",), ("test",)):
        out = features.split(df, folds, "day", parts)
        assert {(r.fold, r.horizon_days, r.day, r.part) for r in out.collect()} == {w for w in want if w[3] in parts}
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert features.split(df, folds.limit(0), "day").count() == 0


def test_train_stats(spark):
    df, rows = days(spark)
    folds, plain = fold_rows(spark, df)
    got = {r.fold: r for r in features.train_stats(df, folds, "day", ["y", "a"]).collect()}
    for fold, cutoff, _ in plain:
        y = np.array([v for d, v, _ in rows if d < cutoff and v is not None])
        r = got[fold]
        assert (r.n_y, r.low_y, r.high_y) == (len(y), y.min(), y.max()) and r.mean_y == pytest.approx(y.mean())


def test_linear_forecast(spark):
    df, rows = days(spark)
    folds, plain = fold_rows(spark, df)
    df = df.withColumn("b", F.col("a") * 1000.0 + F.dayofmonth("day"))
    got = {(r.fold, r.horizon_days, r.day): r.yhat for r in evaluate.forecast_linear(df, "y", ["a", "b"], folds, "day").collect()}
    x = {d: [1.0, a or 0.0, 0.0 if a is None else a * 1000.0 + d.day] for d, _, a in rows}
    want = {}
    for fold, cutoff, horizon in plain:
        train = [(x[d], y) for d, y, _ in rows if d < cutoff and y is not None]
        b = np.linalg.lstsq(np.array([p for p, _ in train]), np.array([y for _, y in train]), rcond=None)[0]
        want |= {(fold, horizon, d): float(np.dot(x[d], b)) for d, *_ in rows if cutoff <= d < cutoff + dt.timedelta(days=horizon)}
    assert got == pytest.approx(want)


def test_linear_forecast_of_dependent_features(spark):
    df, _ = days(spark, 900)
    folds, _ = fold_rows(spark, df)
    twice = df.withColumn("b", F.col("a") * 2).withColumn("none", F.lit(0.0))
    one = evaluate.forecast_linear(df, "y", ["a"], folds, "day").select("day", "fold", "horizon_days", F.round("yhat", 6).alias("yhat"))
    two = evaluate.forecast_linear(twice, "y", ["a", "b", "none"], folds, "day").select("day", "fold", "horizon_days", F.round("yhat", 6).alias("yhat"))
    assert one.count() and one.exceptAll(two).count() == 0


def test_suffixes(spark):
    df = spark.createDataFrame([("abc",), ("xbc",), ("c",), ("",), (None,), ("zz",)], "t string")
    names = spark.createDataFrame([(2, "bc", "second"), (1, "abc", "first"), (3, "c", "third")], "priority int, suffix string, name string")
    got = {r.t: r.name for r in align.match_suffix(df, "t", names).collect()}
    assert got == {"abc": "first", "xbc": "second", "c": "third", "": None, None: None, "zz": None}
