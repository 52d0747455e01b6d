"""Edge rows, parity with pandas and numpy, and properties."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourline.functions import clean
from hourline.operators import aggregate, evaluate, features, quality, reshape, spatial, stats, windows
from hourline.sources import readers, sinks
from hourline.streaming.ingest import ingest_new


@pytest.mark.parametrize(
    "label, lang, want",
    [("2022 March", "en", (2022, "month", 3)), ("2026 March*", "en", (2026, "month", 3)), ("2025", "en", (2025, "year", None)), ("abc", "en", None), ("2022 Foo", "en", None), ("1996 januari", "nl", (1996, "month", 1)), ("2025 december*", "nl", (2025, "month", 12)), ("2015 1st quarter", "en", (2015, "quarter", 1)), ("2023 3rd quarter*", "en", (2023, "quarter", 3)), ("2009 1st semester", "en", (2009, "semester", 1)), ("2025 2nd Semester*", "en", (2025, "semester", 2)), (None, "en", None)],
)
def test_period(spark, label, lang, want):
    got = spark.createDataFrame([(label,)], "x string").select(clean.parse_period(F.col("x"), lang).alias("p")).first()["p"]
    assert (None if got is None else tuple(got)) == want


def test_numbers_and_flags(spark):
    df = spark.createDataFrame([("42,06",), (".",), ("",), ("n/a",), (None,)], "x string")
    assert [r[0] for r in df.select(clean.to_double(F.col("x"), True)).collect()] == [42.06, None, None, None, None]
    s = spark.createDataFrame([(-999.9,), (-999.85,), (-1000.0,), (-999.7,)], "x double")
    assert [r[0] for r in s.select(clean.sentinel_to_null(F.col("x"), -999.9)).collect()] == [None, None, None, -999.7]
    b = spark.createDataFrame([(0b0111,), (0b0100,)], "x int")
    assert [r[0] for r in b.select(clean.bits(F.col("x"), 0, 2)).collect()] == [3, 0]
    t = spark.createDataFrame([(2022, None, 1.0), (2023, None, 0.1), (2023, 1.0, None), (2022, 1.0, 2.0)], "y int, levy double, tax double")
    assert [r[0] for r in t.select(clean.conditional_total(F.col("y"), F.col("levy"), F.col("tax"), 2022)).collect()] == [None, 0.1, None, 3.0]


def test_clock(spark):
    rows = [("2012-03-25 02:00:00", None), ("2012-10-28 02:00:00", None), ("2012-10-28 01:00:00", "2012-10-27 23:00:00"), ("2012-10-28 03:00:00", "2012-10-28 02:00:00")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "t string").select(clean.local_to_utc(F.col("t").cast("timestamp_ntz"), "CET").cast("string"))
    assert [r[0] for r in df.collect()] == [b for _, b in rows]
    days = spark.createDataFrame([(2016, 366), (2015, 1)], "y int, d int").select(clean.day_of_year(F.col("y"), F.col("d")))
    assert [r[0] for r in days.collect()] == [dt.date(2016, 12, 31), dt.date(2015, 1, 1)]


def test_coverage(spark):
    df = spark.createDataFrame([("d", 1.0, 0, False)] * 9 + [("e", 1.0, 0, False)] * 10, "day string, v double, q int, f boolean").withColumn("day", F.when(F.col("day") == "d", F.lit("2020-01-01")).otherwise("2020-01-02").cast("date"))
    got = {str(r["day"]): r["mean"] for r in aggregate.daily_quality_agg(df, "day", "v", "q", "f", total=100).collect()}
    assert got == {"2020-01-01": None, "2020-01-02": 1.0}


def hours(spark, values, start="2024-01-01"):
    t0 = dt.datetime.fromisoformat(start)
    return spark.createDataFrame([(t0 + dt.timedelta(hours=i), v) for i, v in enumerate(values)], "ts timestamp_ntz, x double")


def test_gaps(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0 + dt.timedelta(hours=h),) for h in (0, 1, 4, 5, 9)], "ts timestamp_ntz")
    got = [(r.gap_start.hour, r.gap_end.hour, r.length) for r in windows.gap_ranges(df, "ts", "hour").orderBy("gap_start").collect()]
    assert got == [(2, 3, 2), (6, 8, 3)]


@pytest.mark.parametrize("values, limit", [([0.0, None, None, None, 4.0], 2), ([None, 1.0, None, None], 7), ([None, 5.0, None, 2.0, None, None, None], 2)])
def test_interpolate(spark, values, limit):
    got = [r.x for r in windows.interpolate(hours(spark, values), "x", "ts", limit).orderBy("ts").collect()]
    want = pd.Series(values, dtype=float).interpolate(limit=limit)
    assert np.allclose(np.array(got, dtype=float), want, equal_nan=True)


def test_rolling(spark):
    v = [float(x * x % 17) for x in range(12)]
    got = [r.m for r in windows.rolling_centered(hours(spark, v), "x", "ts", 6, "m").orderBy("ts").collect()]
    want = pd.Series(v).rolling(6, center=True).mean()
    assert np.allclose(np.array(got, dtype=float), want, equal_nan=True)
    assert [i for i, x in enumerate(got) if x is None] == [0, 1, 2, 10, 11]


def test_lags(spark):
    df = hours(spark, [1.0, 2.0, 3.0, 4.0]).where("x <> 2")
    a = [r.l for r in windows.lag_rows(df, "x", "ts", 1, "l").orderBy("ts").collect()]
    b = [r.l for r in windows.lag_time(df, "x", "ts", "1 hour", "l").orderBy("ts").collect()]
    assert a == [None, 1.0, 3.0] and b == [None, None, 3.0]


def test_autocorrelation(spark):
    rng = np.random.default_rng(1)
    v = np.cumsum(rng.normal(size=80))
    z = v - v.mean()
    got = {r.lag: r.acf for r in stats.acf(hours(spark, v.tolist()), "x", "ts", 6).collect()}
    assert all(abs(got[k] - (z[k:] @ z[: len(z) - k]) / (z @ z)) < 1e-9 for k in range(7)) and abs(got[0] - 1) < 1e-12
    p = {r.lag: r.pacf for r in stats.pacf(stats.acf(hours(spark, v.tolist()), "x", "ts", 6)).collect()}
    r = [got[k] for k in range(7)]
    m = np.array([[r[abs(i - j)] for j in range(4)] for i in range(4)])
    assert abs(p[4] - np.linalg.solve(m, r[1:5])[-1]) < 1e-9
    df = hours(spark, v.tolist()).withColumn("y", F.col("x") * F.col("x"))
    a = {x.lag: x.ccf for x in stats.ccf(df, "x", "y", "ts", 5).collect()}
    b = {x.lag: x.ccf for x in stats.ccf(df, "y", "x", "ts", 5).collect()}
    assert all(abs(a[k] - b[-k]) < 1e-9 for k in range(-5, 6))


def test_vif(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    x[:, 2] += x[:, 0]
    got = {r.name: r.vif for r in stats.vif(spark.createDataFrame(x.tolist(), "a double, b double, c double"), ["a", "b", "c"]).collect()}
    for j, n in enumerate("abc"):
        rest = np.delete(x, j, 1)
        e = x[:, j] - rest @ np.linalg.lstsq(rest, x[:, j], rcond=None)[0]
        assert abs(got[n] - (x[:, j] @ x[:, j]) / (e @ e)) < 1e-6


def test_binned(spark):
    x = np.linspace(0, 10, 101)
    df = spark.createDataFrame([(float(a), float(a * a)) for a in x], "x double, y double")
    got = {r.bin: r["mean"] for r in aggregate.binned_mean(df, "x", "y", 7).collect()}
    want = pd.Series(x * x).groupby(pd.cut(pd.Series(x), 7)).mean()
    assert np.allclose([got[i] for i in range(1, 8)], want.to_numpy())


def test_fitting_on_train_only(spark):
    df = spark.createDataFrame([("train", 1.0, None), ("train", 3.0, None), ("train", 5.0, None), ("test", 100.0, 7.0), ("test", None, None)], "part string, a double, b double").withColumn("f", F.lit(0))
    imp = features.impute_mean(df, ["f"], ["a", "b"])
    assert sorted(r.a for r in imp.collect()) == [1.0, 3.0, 3.0, 5.0, 100.0] and sorted(r.b for r in imp.collect()) == [0.0, 0.0, 0.0, 0.0, 7.0]
    back = features.scale(imp, ["f"], ["a", "b"], keep_bounds=True)
    assert sorted(r.b for r in back.collect()) == [0.0] * 5
    assert sorted(r[0] for r in back.select(features.unscale("a")).collect()) == [1.0, 3.0, 3.0, 5.0, 100.0]


def test_scores(spark):
    df = spark.createDataFrame([(0.5, 1.5), (10.0, 11.0), (20.0, 18.0), (None, 3.0), (1.0, float("nan"))], "y double, p double").withColumn("m", F.lit("m"))
    r = evaluate.score(df, "y", "p", ["m"]).first()
    assert r.n_samples == 3 and abs(r.mape_pct - 10.0) < 1e-9 and abs(r.rmse - np.sqrt(2)) < 1e-9
    flat = spark.createDataFrame([("m", 1.0, 2.0), ("m", 1.0, 3.0), ("n", None, None)], "m string, y double, p double")
    got = {x.m: x for x in evaluate.score(flat, "y", "p", ["m"]).collect()}
    assert got["m"].pearson_r is None and got["n"].n_samples == 0 and got["n"].rmse is None


def test_folds(spark):
    df = spark.createDataFrame([(dt.date(1995, 1, 1),), (dt.date(2001, 8, 1),)], "day date")
    f = features.rocv_folds(df, "day", 2, 1, [60, 180])
    assert sorted({r.cutoff.year for r in f.collect()}) == [1997, 1998, 1999, 2000, 2001]
    s = features.split(spark.sql("select explode(sequence(date'1995-01-01', date'2001-08-01', interval 1 day)) as day"), f, "day")
    assert s.groupBy("fold", "horizon_days", "day").count().where("count > 1").count() == 0


def test_calendar_and_polygon(spark):
    c = {str(r.ts)[:10]: r for r in reshape.calendar_features(hours(spark, [0.0] * 48, "2024-01-06"), "ts").collect()}
    assert (c["2024-01-06"].day_of_week, c["2024-01-06"].is_weekend, c["2024-01-07"].day_of_week) == (7, 1, 1)
    assert reshape.hourly_spine(spark, "2012-01-01", "2025-12-31").count() == 122_736
    square = spark.createDataFrame([('{"type":"MultiPolygon","coordinates":[[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[3,1],[3,3],[1,3],[1,1]]]]}',)], "g string")
    grid = spark.range(50).select((F.col("id") % 5 + 0.0).alias("x"), (F.floor(F.col("id") / 5) / 2).alias("y"))
    got = {(r.x, r.y) for r in spatial.mask_points(grid, spatial.polygon_edges(square, "g"), "x", "y").collect()}
    want = {(float(x), y / 2) for x in range(5) for y in range(10) if 0 < x < 4 and 0 < y / 2 < 4 and not (1 <= x <= 3 and 1 <= y / 2 <= 3)}
    assert got == want


def test_files(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("Title\nPeriod;A\n\n2022 March;1,5\n2022 Foo;2\n2023;3,5*\nSource: x\n")
    rows = readers.read_messy_csv(spark, str(p), ["period_raw", "a"]).collect()
    assert [(r.period.year, r.period.n, r.a) for r in rows] == [(2022, 3, "1,5"), (2023, None, "3,5*")]
    w = tmp_path / "w.csv"
    w.write_text('"Preamble"\nTopic;Periods;2022 1st quarter;2022 2nd quarter;2022 1st quarter;2022 2nd quarter\nGDP;x;1;2;3;4\nSource: y;;;;;\n')
    got = sorted((r.metric, r.period, r.value) for r in readers.read_wide_periods(spark, str(w)).collect())
    assert got == [("qq", "2022 1st quarter", "3"), ("qq", "2022 2nd quarter", "4"), ("yy", "2022 1st quarter", "1"), ("yy", "2022 2nd quarter", "2")]
    df = hours(spark, [1.0, 2.0], "2024-12-31T23:00:00")
    out = str(tmp_path / "by_year")
    assert sinks.stage(spark, out, lambda: df, lambda d, q: sinks.write_by_year(d, q, "ts"))
    assert not sinks.stage(spark, out, lambda: df, lambda d, q: sinks.write_by_year(d, q, "ts"))
    assert spark.read.parquet(out).groupBy("year").count().count() == 2
    assert readers.file_inventory(spark, str(tmp_path), "*.csv").count() == 2
    assert readers.optional(spark, str(tmp_path / "no"), "a int").count() == 0
    assert readers.layout(spark.createDataFrame([(1,) * 25], ["Country", *map(str, range(24))])) == "wide"
    doc = quality.document(quality.profile(df), "s").first()
    assert doc["columns"]["x"]["null_count"] == 0


def test_ingest_is_incremental(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    day = lambda d, v: spark.createDataFrame([(dt.date(2024, 1, d), v)], "day date, v int")
    day(1, 1).write.parquet(f"{src}/a")
    for n in (1, 1, 2):
        if n == 2:
            day(2, 2).write.parquet(f"{src}/b")
        ingest_new(spark, f"{src}/*", out, ck, "day date, v int", "day")
        assert spark.read.parquet(out).count() == n
