"""Queries over folds, fitted preparation, forecasts and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourline.operators import evaluate, features, windows
from hourline.plans.registry import DAILY, daily, query, rounded

HORIZONS = [60, 180]
_FOLDS = """s AS (SELECT min(day) AS a, max(day) AS b FROM d), c AS (SELECT i::INTEGER AS fold, (a + to_years((2 + i)::INTEGER))::DATE AS cutoff, b FROM s, range(0, 40) AS r(i)),
f AS (SELECT fold, cutoff, h::INTEGER AS horizon_days FROM c, unnest([60, 180]) AS u(h) WHERE cutoff <= b - 180)"""
_SPLIT = f"WITH {DAILY}, {_FOLDS}, x AS (SELECT fold, cutoff, horizon_days, day, total, CASE WHEN day < cutoff THEN 'train' ELSE 'test' END AS part FROM d JOIN f ON day < cutoff + horizon_days)"


def _folds(t):
    return features.rocv_folds(daily(t("orders")), "day", 2, 1, HORIZONS)


def _split(t):
    return features.split(daily(t("orders")), _folds(t), "day")


@query(f"WITH {DAILY}, {_FOLDS} SELECT fold, cutoff, horizon_days FROM f")
def rocv_folds(t):
    return _folds(t)


@query(f"{_SPLIT} SELECT fold, horizon_days, part, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM x GROUP BY 1, 2, 3")
def rocv_split(t):
    return _split(t).groupBy("fold", "horizon_days", "part").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


_IQR = f"{_SPLIT}, q AS (SELECT fold, horizon_days, quantile_cont(total, 0.25) AS lo, quantile_cont(total, 0.75) AS hi FROM x WHERE part = 'train' GROUP BY 1, 2), y AS (SELECT x.* EXCLUDE (total), CASE WHEN part <> 'train' OR total BETWEEN lo - 0.5 * (hi - lo) AND hi + 0.5 * (hi - lo) THEN total END AS total FROM x JOIN q USING (fold, horizon_days))"
_KEYS = ["fold", "horizon_days"]


def _clipped(t):
    return features.iqr_to_null(_split(t), _KEYS, ["total"], 0.5)


@query(f"{_IQR} SELECT fold, horizon_days, part, count(*) - count(total) AS clipped, round(sum(total), 2) AS sum FROM y GROUP BY 1, 2, 3")
def iqr_clip(t):
    return _clipped(t).groupBy("fold", "horizon_days", "part").agg((F.count("*") - F.count("total")).alias("clipped"), F.round(F.sum("total"), 2).alias("sum"))


_IMP = f"{_IQR}, m AS (SELECT fold, horizon_days, avg(total) AS mean FROM y WHERE part = 'train' GROUP BY 1, 2), z AS (SELECT y.* EXCLUDE (total), coalesce(total, mean, 0.0) AS total FROM y JOIN m USING (fold, horizon_days))"


@query(f"{_IMP} SELECT fold, horizon_days, part, count(total) AS n, round(avg(total), 4) AS mean FROM z GROUP BY 1, 2, 3")
def mean_impute(t):
    return rounded(features.impute_mean(_clipped(t), _KEYS, ["total"]).groupBy("fold", "horizon_days", "part").agg(F.count("total").alias("n"), F.avg("total").alias("mean")), "mean")


_SC = f"{_IMP}, b AS (SELECT fold, horizon_days, min(total) AS lo, max(total) AS hi FROM z WHERE part = 'train' GROUP BY 1, 2), w AS (SELECT z.*, coalesce((total - lo) / nullif(hi - lo, 0), 0) AS scaled, lo, hi FROM z JOIN b USING (fold, horizon_days))"


def _scaled(t):
    return features.scale(features.impute_mean(_clipped(t), _KEYS, ["total"]), _KEYS, ["total"], keep_bounds=True)


@query(f"{_SC} SELECT fold, horizon_days, day, round(scaled, 6) AS scaled FROM w WHERE part = 'test'")
def minmax_scale(t):
    return _scaled(t).where("part = 'test'").select("fold", "horizon_days", "day", F.round("total", 6).alias("scaled"))


@query(f"{_SC} SELECT fold, horizon_days, day, round(scaled * (hi - lo) + lo, 2) AS total FROM w WHERE part = 'test'")
def minmax_inverse(t):
    return _scaled(t).where("part = 'test'").select("fold", "horizon_days", "day", F.round(features.unscale("total"), 2).alias("total"))


_LAGS = f"WITH {DAILY}, l AS (SELECT day, total, row_number() OVER o AS n, lag(total, 60) OVER o AS total_lag, lag(total, 60) OVER o AS total_lag_0, lag(total, 67) OVER o AS total_lag_7 FROM d WINDOW o AS (ORDER BY day)) SELECT day, total, total_lag, total_lag_0, total_lag_7 FROM l WHERE n > 67"


@query(_LAGS)
def lag_design(t):
    return features.lag_design(daily(t("orders")), "total", ["total"], "day", 60, per_day=1, extra=(0, 7))


@query(f"SELECT day, round(sin(2 * pi() * date_diff('day', DATE '1970-01-01', day) / 7), 6) + 0.0 AS week_sin1, total_lag, total_lag_7, total FROM ({_LAGS}) q")
def design_matrix(t):
    df, _ = evaluate.fourier(lag_design(t), "day", {"week": 7.0}, 1)
    return features.design(df, "day", ["week_sin1"], ["total_lag", "total_lag_7"], "total").withColumn("week_sin1", F.round("week_sin1", 6) + 0.0)


_NAIVE = f"""{_SPLIT}, g AS (SELECT day, lag(total, 60) OVER (ORDER BY day) AS lag_60, lag(total, 364) OVER (ORDER BY day) AS lag_364 FROM d), p AS (SELECT fold, horizon_days, total AS y, m AS model, CASE m WHEN 'lag_60' THEN lag_60 ELSE lag_364 END AS yhat FROM x JOIN g USING (day), unnest(['lag_60', 'lag_364']) AS u(m) WHERE part = 'test'),
k AS (SELECT model, fold, horizon_days, sqrt(avg((yhat - y) * (yhat - y))) AS rmse, avg(abs(yhat - y)) AS mae, 100 * avg(CASE WHEN abs(y) > 1 THEN abs((yhat - y) / y) END) AS mape_pct, corr(y, yhat) AS pearson_r, count(yhat - y) AS n_samples FROM p GROUP BY 1, 2, 3)"""


def _naive(t):
    d = daily(t("orders"))
    lags = windows.lag_many(d, {"lag_60": ("total", 60), "lag_364": ("total", 364)}, "day").drop("total")
    return _split(t).where("part = 'test'").join(lags, "day").withColumnRenamed("total", "y").unpivot(["fold", "horizon_days", "y"], ["lag_60", "lag_364"], "model", "yhat")


def _scores(t):
    return evaluate.score(_naive(t), "y", "yhat", ["model", "fold", "horizon_days"])


@query(f"{_NAIVE} SELECT model, fold, horizon_days, round(rmse + 1e-6, 3) AS rmse, round(mae + 1e-6, 3) AS mae, round(mape_pct + 1e-6, 3) AS mape_pct, round(pearson_r, 5) AS pearson_r, n_samples FROM k")
def forecast_naive_scores(t):
    return rounded(rounded(_scores(t), "rmse", "mae", "mape_pct", digits=3, nudge=1e-6), "pearson_r", digits=5)


@query(f"{_NAIVE} SELECT model, fold, round(rmse, 3) AS rmse FROM k WHERE horizon_days = 60")
def score_selected_horizon(t):
    return rounded(_scores(t).where("horizon_days = 60").select("model", "fold", "rmse"), "rmse", digits=3)


@query(f"{_NAIVE} SELECT model, horizon_days, round(avg(rmse), 3) AS rmse_mean, round(stddev_samp(rmse), 3) AS rmse_std, round(avg(mae), 3) AS mae_mean, round(avg(mape_pct), 3) AS mape_mean, round(avg(pearson_r), 5) AS r_mean, count(*) AS folds FROM k GROUP BY 1, 2")
def fold_summary(t):
    s = evaluate.summarise(_scores(t), ["model", "horizon_days"])
    return rounded(rounded(s, "rmse_mean", "rmse_std", "mae_mean", "mape_mean", digits=3), "r_mean", digits=5)


@query(f"{_NAIVE} SELECT model, {', '.join(f'round(avg(CASE WHEN y - yhat >= 0 THEN {q} * (y - yhat) ELSE ({q} - 1) * (y - yhat) END), 3) AS pinball_{int(100 * q):02d}' for q in (0.05, 0.5, 0.95))} FROM p GROUP BY 1")
def pinball(t):
    out = evaluate.pinball(_naive(t), "y", "yhat", [0.05, 0.5, 0.95], ["model"])
    return rounded(out, *out.columns[1:], digits=3)


_DAYS = "date_diff('day', DATE '1970-01-01', day)"
_X = ", ".join(["1.0", f"{_DAYS} / 365.25", *[f"{f}({_DAYS} * (2 * pi() * {k} / {p}))" for p in ("7.0", "365.25") for k in (1, 2) for f in ("sin", "cos")], "coalesce(lag(total, 180) OVER (ORDER BY day), 0.0)"])
_K = 11
#: The normal equations of each fold, solved by elimination, a column a step.
_LINEAR = f"""WITH RECURSIVE {DAILY}, {_FOLDS}, v AS (SELECT day, total, [{_X}] AS x FROM d), u AS (SELECT DISTINCT fold, cutoff FROM f),
g AS (SELECT fold, i, j, sum(x[i] * list_append(x, total)[j]) AS v FROM v JOIN u ON day < cutoff, range(1, {_K + 1}) AS a(i), range(1, {_K + 2}) AS b(j) GROUP BY ALL),
r AS (SELECT fold, i, list(v ORDER BY j) AS r FROM g GROUP BY ALL), m AS (SELECT fold, list(r ORDER BY i) AS m FROM r GROUP BY fold),
e AS (SELECT fold, 1 AS p, m FROM m UNION ALL
  SELECT fold, p + 1, list_transform(m, lambda r, i: CASE WHEN i = p THEN list_transform(r, lambda z: z / m[p][p]) ELSE list_transform(r, lambda z, q: z - r[p] / m[p][p] * m[p][q]) END) FROM e WHERE p <= {_K}),
co AS (SELECT fold, list_transform(m, lambda r: r[{_K + 1}]) AS b FROM e WHERE p = {_K + 1}),
p AS (SELECT f.fold, horizon_days, total AS y, list_dot_product(x, b) AS yhat FROM v JOIN f ON day >= cutoff AND day < cutoff + horizon_days JOIN co ON co.fold = f.fold)"""


@query(f"""{_LINEAR} SELECT fold, horizon_days, round(sqrt(avg((yhat - y) * (yhat - y))), 2) AS rmse, round(avg(abs(yhat - y)), 2) AS mae, round(100 * avg(CASE WHEN abs(y) > 1 THEN abs((yhat - y) / y) END), 3) AS mape_pct, round(corr(y, yhat), 5) AS pearson_r, count(yhat - y) AS n_samples FROM p GROUP BY 1, 2""")
def forecast_linear(t):
    d, cols = evaluate.fourier(daily(t("orders")), "day", {"week": 7.0, "year": 365.25})
    d = windows.lag_rows(d, "total", "day", 180, "lag_180")
    done = evaluate.forecast_linear(d, "total", [*cols, "lag_180"], _folds(t), "day")
    scores = rounded(evaluate.score(done, "total", "yhat", ["fold", "horizon_days"]), "rmse", "mae", digits=2)
    return rounded(rounded(scores, "mape_pct", digits=3), "pearson_r", digits=5)


@query(f"WITH {DAILY}, {_FOLDS} SELECT fold, count(total) AS n_total, round(avg(total), 3) AS mean_total, min(total) AS low_total, max(total) AS high_total FROM (SELECT DISTINCT fold, cutoff FROM f) u JOIN d ON day < cutoff GROUP BY 1")
def rocv_train_stats(t):
    return rounded(features.train_stats(daily(t("orders")), _folds(t), "day", ["total"]), "mean_total", digits=3)


@query(f"WITH {DAILY} SELECT day, (day BETWEEN DATE '1997-01-01' AND DATE '1998-06-30')::INTEGER AS crisis FROM d")
def indicator_window(t):
    return daily(t("orders")).select("day", features.in_window(F.col("day"), "1997-01-01", "1998-06-30").alias("crisis"))


@query("""WITH e(y, d) AS (VALUES (1995, DATE '1995-04-16'), (1996, DATE '1996-04-07'), (1997, DATE '1997-03-30'), (1998, DATE '1998-04-12'), (1999, DATE '1999-04-04'), (2000, DATE '2000-04-23'), (2001, DATE '2001-04-15')), o AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)
SELECT day, (strftime(day, '%m-%d') IN ('01-01', '12-25', '12-26') OR (day - d) IN (0, 1, 39, 49, 50))::INTEGER AS holiday FROM o JOIN e ON y = year(day)""")
def holiday_flag(t):
    return daily(t("orders")).select("day", features.holiday_flag(F.col("day")).alias("holiday"))
