"""Work on one long series by many tasks, against pandas and numpy."""

import datetime as dt
import json
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourline.operators import features, reshape, segments, spatial, stats, windows

DAY = 86400


def series(spark, n=400, seed=1, hole=0.5, keys=("a", "b", None)):
    """Hours of some series, in disorder, with nulls and a stretch without values."""
    rng = random.Random(seed)
    rows = []
    for k in keys:
        t = dt.datetime(2024, 1, 1)
        for i in range(n):
            t += dt.timedelta(hours=rng.choice([1, 1, 1, 2, 30]))
            rows.append((k, t, None if rng.random() < hole or 100 < i < 250 else rng.gauss(0, 1), "same"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, x double, n string").repartition(5), rows


def by_key(rows):
    out = {}
    for k, t, x, *_ in sorted(rows, key=lambda r: r[1]):
        out.setdefault(k, []).append((t, x))
    return out


@pytest.mark.parametrize("width", [DAY, 7 * DAY, 10_000 * DAY])
def test_fill_and_interpolate(spark, width):
    df, rows = series(spark)
    for what, f in (("ffill", lambda s: s.ffill()), ("interpolate", lambda s: s.interpolate(limit=7))):
        got = windows.ffill(df, ["x"], "ts", ["k"], width) if what == "ffill" else windows.interpolate(df, "x", "ts", 7, ["k"], width)
        assert got.columns == df.columns
        got = by_key((r.k, r.ts, r.x) for r in got.collect())
        for k, own in by_key(rows).items():
            want = f(pd.Series([x for _, x in own], dtype=float))
            assert [t for t, _ in got[k]] == [t for t, _ in own]
            assert np.allclose(np.array([x for _, x in got[k]], dtype=float), want, equal_nan=True), (what, k)


def test_rows_without_time_come_first(spark):
    df = spark.createDataFrame([(None, 1.0), (3, None), (90, None), (91, 2.0)], "ts long, x double")
    assert sorted(r.x for r in windows.ffill(df, ["x"], "ts", width=10).collect()) == [1.0, 1.0, 1.0, 2.0]
    assert windows.ffill(df.where("false"), ["x"], "ts").count() == 0


@pytest.mark.parametrize("unit, step", [("hour", dt.timedelta(hours=1)), ("day", dt.timedelta(days=1))])
def test_gaps(spark, unit, step):
    rng = random.Random(2)
    rows = [(k, dt.datetime(2024, 1, 1 + i) + step * n) for i, k in enumerate(["a", None]) for n in sorted(rng.sample(range(900), 300)) for _ in range(rng.choice([1, 2]))]
    off = [("a", dt.datetime(2024, 1, 3, 0, 7))]
    df = spark.createDataFrame(rows + off, "k string, ts timestamp_ntz").repartition(4)
    got = {(r.k, r.gap_start, r.gap_end, r.length) for r in windows.gap_ranges(df, "ts", unit, ["k"], 5 * DAY).collect()}
    want = set()
    for k in ("a", None):
        own = sorted({t for x, t in rows if x == k})
        want |= {(k, a + step, b - step, round((b - a) / step) - 1) for a, b in zip(own, own[1:]) if b - a > step}
    assert got == want
    slots = reshape.expected_keys(df.where("k = 'a'"), "ts", unit, slots=64)
    assert [r.ts for r in slots.orderBy("ts").collect()] == [min(t for k, t in rows if k == "a") + step * i for i in range(slots.count())]


def test_no_task_orders_a_whole_series(spark):
    df, _ = series(spark, 50, keys=("a",))
    for out in (windows.ffill(df, ["x"], "ts"), windows.interpolate(df, "x", "ts", 7), windows.gap_ranges(df, "ts", "hour"), stats.acf(df, "x", "ts", 5), windows.lag_rows(df, "x", "ts", 3, "l"), windows.rolling_centered(df, "x", "ts", 5, "m"), features.lag_design(df, "x", ["x"], "ts", 1, 3, (0, 2))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        specs = re.findall(r"windowspecdefinition\((\w+)#", plan)
        assert specs and set(specs) <= {segments.SEG, "_block"}


@pytest.mark.parametrize("block", [1, 9, 5000])
def test_correlations(spark, block):
    df, rows = series(spark, 300, hole=0.2)
    df = df.withColumn("y", F.sin(F.col("x") * 3) + F.hour("ts") / 24)
    acf = {(r.k, r.lag): r.acf for r in stats.acf(df, "x", "ts", 12, ["k"], block).collect()}
    ccf = {(r.k, r.lag): r.ccf for r in stats.ccf(df, "x", "y", "ts", 12, ["k"], block).collect()}
    for k, own in by_key(rows).items():
        x = np.array([v for _, v in own if v is not None])
        y = np.array([math.sin(v * 3) + t.hour / 24 for t, v in own if v is not None])
        zx, zy, n = (x - x.mean()) / x.std(), (y - y.mean()) / y.std(), len(x)
        for lag in range(13):
            assert acf[k, lag] == pytest.approx(zx[lag:] @ zx[: n - lag] / n)
            assert ccf[k, lag] == pytest.approx(zx[lag:] @ zy[: n - lag] / n)
            assert ccf[k, -lag] == pytest.approx(zy[lag:] @ zx[: n - lag] / n)


def test_correlations_of_short_and_flat_series(spark):
    df = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 3.0), ("f", 1, 5.0), ("f", 2, 5.0), ("f", 3, 5.0)], "k string, ts long, x double")
    got = {(r.k, r.lag): r.acf for r in stats.acf(df, "x", "ts", 9, ["k"], least=1).collect()}
    assert got == {("s", 0): pytest.approx(1.0), ("s", 1): pytest.approx(-0.5), ("f", 0): None, ("f", 1): None, ("f", 2): None}


def test_lags_cost_no_shuffle(spark):
    df, _ = series(spark, 50)
    moves = {n: stats.acf(df, "x", "ts", n)._jdf.queryExecution().executedPlan().toString().count("Exchange ") for n in (1, 30)}
    assert moves[1] == moves[30]


def ring(n, radius, wobble, at=(0.0, 0.0)):
    rng = random.Random(n)
    points = [(at[0] + math.cos(a) * r, at[1] + math.sin(a) * r) for a, r in ((2 * math.pi * i / n, radius + rng.uniform(-wobble, wobble)) for i in range(n))]
    return [*points, points[0]]


def test_polygons(spark):
    rings = [[ring(700, 10, 2), ring(50, 3, 1)], [ring(9, 2, 0.5, (14, 3))]]
    shape = spark.createDataFrame([(json.dumps({"type": "MultiPolygon", "coordinates": rings}),)], "g string")
    edges = spatial.polygon_edges(shape, "g")
    rng = random.Random(7)
    points = [(rng.uniform(-13, 17), rng.uniform(-13, 13), i) for i in range(2000)] + [(None, 1.0, -1), (1.0, None, -2)]
    grid = spark.createDataFrame(points, "x double, y double, id int")

    def odd(x, y):
        n = 0
        for r in (r for p in rings for r in p):
            for (x1, y1), (x2, y2) in zip(r, r[1:]):
                n += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        return n % 2 == 1

    want = {i for x, y, i in points if x is not None and y is not None and odd(x, y)}
    sent, joined = spatial.inside(grid, edges, "x", "y"), spatial.inside(grid, edges, "x", "y", most=10)
    assert {r.id for r in sent.collect()} == {r.id for r in joined.collect()} == want
    assert "Exchange hashpartitioning" not in sent._jdf.queryExecution().executedPlan().toString()
    assert spatial.inside(grid, edges.limit(0), "x", "y").count() == 0
    flat = spark.createDataFrame([(0.0, 1.0, 5.0, 1.0)], "x1 double, y1 double, x2 double, y2 double")
    assert spatial.inside(grid, flat, "x", "y").count() == 0


@pytest.mark.parametrize("block", [1, 10, 5000])
def test_blocks(spark, block):
    df, rows = series(spark, 120, hole=0.1)
    lag = by_key((r.k, r.ts, r.v) for r in windows.lag_rows(df, "x", "ts", 7, "v", ["k"], block).collect())
    mean = by_key((r.k, r.ts, r.v) for r in windows.rolling_centered(df, "x", "ts", 6, "v", 2, ["k"], block).collect())
    odd = by_key((r.k, r.ts, r.trend) for r in windows.decompose(df, "x", "ts", 5, ["k"], block=block).collect())
    even = by_key((r.k, r.ts, r.trend) for r in windows.decompose(df, "x", "ts", 4, ["k"], block=block).collect())
    plain = lambda own: np.array([x for _, x in own], dtype=float)
    for k, own in by_key(rows).items():
        x = pd.Series(plain(own))
        assert np.allclose(plain(lag[k]), x.shift(7), equal_nan=True)
        assert np.allclose(plain(mean[k]), x.rolling(6, center=True, min_periods=2).mean(), equal_nan=True)
        assert np.allclose(plain(odd[k]), x.rolling(5, center=True).mean(), equal_nan=True)
        assert np.allclose(plain(even[k]), (x.rolling(5, center=True).sum() + x.rolling(3, center=True).sum()) / 8, equal_nan=True)
    ends = windows.trim(df, "ts", 2, 3, ["k"]), windows.last_rows(df, "ts", 4, ["k"])
    for out, cut in zip(ends, (slice(2, -3), slice(-4, None))):
        got = by_key((r.k, r.ts, r.x) for r in out.collect())
        assert all(got[k] == own[cut] for k, own in by_key(rows).items())
