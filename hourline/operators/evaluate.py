"""Forecast scores, fold summaries and a linear baseline."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.operators.features import cutoffs, sliced, split
from hourline.operators.stats import pearson


def score(df: DataFrame, y: str, yhat: str, by: list[str]) -> DataFrame:
    """rmse, mae, mape_pct (|y| > 1), pearson_r (null for a constant) and n over finite pairs."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    ok = finite(y) & finite(yhat)
    e = F.when(ok, F.col(yhat) - F.col(y))
    a, b = F.when(ok, F.col(y)), F.when(ok, F.col(yhat))
    return df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (100 * F.avg(F.abs(e) / F.when(F.abs(a) > 1, F.abs(a)))).alias("mape_pct"), pearson(a, b).alias("pearson_r"), F.count(e).alias("n_samples"))


def summarise(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("rmse").alias("rmse_mean"), F.stddev_samp("rmse").alias("rmse_std"), F.avg("mae").alias("mae_mean"), F.avg("mape_pct").alias("mape_mean"), F.avg("pearson_r").alias("r_mean"), F.count("*").alias("folds"))


def pinball(df: DataFrame, y: str, yhat: str, taus: list[float], by: list[str] = ()) -> DataFrame:
    d = F.col(y) - F.col(yhat)
    return df.groupBy(*by).agg(*[F.avg(F.when(d >= 0, t * d).otherwise((t - 1) * d)).alias(f"pinball_{round(100 * t):02d}") for t in taus])


def fourier(df: DataFrame, ts: str, periods: dict[str, float], order: int = 2) -> tuple[DataFrame, list[str]]:
    """Trend and sine and cosine columns of a time; periods in days."""
    days = F.unix_seconds(F.col(ts).cast("timestamp")) / 86400.0
    cols = {"trend": days / 365.25}
    for name, p in periods.items():
        for k in range(1, order + 1):
            cols |= {f"{name}_sin{k}": F.sin(days * (2 * math.pi * k / p)), f"{name}_cos{k}": F.cos(days * (2 * math.pi * k / p))}
    return df.withColumns(cols), list(cols)


def forecast_linear(df: DataFrame, target: str, features: list[str], folds: DataFrame, ts: str) -> DataFrame:
    """Test rows of each fold and horizon with yhat of a least-squares fit on the rows before the fold's cutoff; null features count as 0.

    The sums of products that a fit needs are taken once, by the slices of time between cutoffs. Added up from the
    first slice on, they are those of each fold, so no row is read once a fold. k squared sums a slice come to the driver, which solves
    one small system a fold.
    """
    x = df.na.fill(0.0, features).withColumn("_one", F.lit(1.0))
    names = ["_one", *features]
    known = sliced(x, folds, ts).where(F.col(target).isNotNull())
    every = [*names, target]
    pairs = [(i, j) for i in range(len(every)) for j in range(i, len(every))]
    sums = known.groupBy("slice").agg(*[F.sum(F.col(every[i]).cast("double") * F.col(every[j])).alias(f"s{i}_{j}") for i, j in pairs]).collect()  # a row a fold and one
    cuts = cutoffs(folds)
    gram = np.zeros((len(cuts) + 1, len(every), len(every)))
    for r in sums:
        for i, j in pairs:
            gram[r["slice"], i, j] = gram[r["slice"], j, i] = r[f"s{i}_{j}"] or 0.0
    gram = gram.cumsum(axis=0)
    fits = []
    for at, (fold, _) in enumerate(cuts):
        g, k = gram[at], len(names)
        scale = np.sqrt(np.maximum(np.diag(g)[:k], 1e-300))
        b = np.linalg.lstsq(g[:k, :k] / np.outer(scale, scale), g[:k, k] / scale, rcond=1e-12)[0] / scale
        fits.append((fold, *map(float, b)))
    coefficients = df.sparkSession.createDataFrame(fits, ", ".join(["fold int", *[f"_b{i} double" for i in range(len(names))]]))
    yhat = sum((F.col(f"_b{i}") * F.col(n) for i, n in enumerate(names)), F.lit(0.0))
    test = split(x, folds, ts, ("test",)).join(coefficients, "fold")
    return test.withColumn("yhat", yhat).drop("_one", *[f"_b{i}" for i in range(len(names))])
