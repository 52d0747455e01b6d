"""Correlation, inflation factors, autocorrelation, top-k and samples."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourline.operators import segments


def pearson(a: Column, b: Column) -> Column:
    """Pearson r over pairs that have both; null where either is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def corr_matrix(df: DataFrame, cols: list[str], min_rows: int = 0) -> DataFrame:
    """a, b, r and n of every pair, over rows that have both; null r below min_rows."""
    aggs = []
    for a, b in combinations(cols, 2):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        r, n = pearson(F.col(a), F.col(b)), F.count_if(both)
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(n >= min_rows, r).alias("r"), n.alias("n")))
    return df.agg(F.array(*aggs).alias("m")).select(F.inline("m"))


def vif(df: DataFrame, cols: list[str], least: int = 36) -> DataFrame:
    """Inflation factors by the Gram matrix of complete rows, of which least are needed (else there are none); only k x k sums come to the driver."""
    full = df.select(*[F.col(c).cast("double") for c in cols]).dropna()
    sums = full.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j], F.count("*").alias("rows")).first()
    if sums["rows"] < least:
        return df.sparkSession.createDataFrame([], "name string, vif double")
    k = len(cols)
    g = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    try:
        out = np.diag(np.linalg.inv(g / np.outer(scale, scale)))
    except np.linalg.LinAlgError:
        out = [None] * k
    return df.sparkSession.createDataFrame([(c, None if v is None else float(v)) for c, v in zip(cols, out)], "name string, vif double")


def acf(df: DataFrame, col: str, ts: str, nlags: int, keys=(), block: int = segments.BLOCK, least: int | None = None) -> DataFrame:
    """lag and acf, lag 0 to nlags, with denominator n and one mean; rows with null values are left out first.

    A series of fewer than least rows (nlags + 6 unless given) has no rows.
    """
    return _products(df, col, col, ts, range(nlags + 1), keys, block, nlags + 6 if least is None else least).withColumnRenamed("r", "acf")


def ccf(df: DataFrame, x: str, y: str, ts: str, max_lag: int, keys=(), block: int = segments.BLOCK, least: int | None = None) -> DataFrame:
    """lag and ccf from -max_lag to max_lag: r(k) = sum x[t + k] y[t]; k > 0: x follows y.

    A series that has both values in fewer than least rows (three times max_lag unless given) has no rows.
    """
    return _products(df, x, y, ts, range(-max_lag, max_lag + 1), keys, block, 3 * max_lag if least is None else least).withColumnRenamed("r", "ccf")


def _products(df: DataFrame, x: str, y: str, ts: str, lags, keys, block: int, least: int) -> DataFrame:
    """lag and r of a series of numbered rows, all lags from one aggregate.

    Rows are dealt out in blocks; the rows that end a block go to the next one too, as far back as the longest lag, so
    that each finds its partners there. What is shuffled doesn't depend on the number of lags but for this edge.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, ts, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    facts = both.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))], F.count("*").alias("rows")).where(F.col("rows") >= least)
    z = lambda c: F.coalesce((F.col(c) - F.col(f"mean_{c}")) / F.nullif(F.col(f"std_{c}"), F.lit(0.0)), F.lit(float("nan")))  # noqa: E731  NaN in flat series, as lists leave nulls out
    rows = segments.meet(both, facts, keys).select(*keys, ts, "rows", z("x").alias("zx"), z("y").alias("zy"))
    longest = max(map(abs, lags))
    dealt, order = segments.haloed(rows, ts, longest, 0, keys, block)
    w = order.rowsBetween(-longest, 0)

    def products(z: str, past: str, sign: int) -> Column:
        """lag and product of a row with each of those before it in its frame, for the lags of a sign that are asked for."""
        every = F.transform(F.reverse(F.col(past)), lambda v, i: F.struct((i * sign).alias("lag"), (v * F.col(z)).alias("p")))
        return F.filter(every, lambda e: e["lag"].between(min(lags), max(lags)) & (e["lag"] * sign >= (0 if sign > 0 else 1)))

    framed = dealt.withColumn("py", F.collect_list("zy").over(w)).withColumn("px", F.collect_list("zx").over(w)).where("_block = _own")
    each = F.concat(products("zx", "py", 1), products("zy", "px", -1)) if min(lags) < 0 else products("zx", "py", 1)
    # products are summed where they are made, so what moves is a row a lag and task
    return framed.select(*keys, "rows", F.inline(each)).groupBy(*keys, "lag").agg(F.nanvl(F.sum("p") / F.max("rows"), F.lit(None).cast("double")).alias("r"))


def pacf(acf_df: DataFrame, keys: list[str] = (), lag: str = "lag", col: str = "acf") -> DataFrame:
    """Partial autocorrelation from the autocorrelation of each series, by Durbin and Levinson's recursion."""
    kind = ", ".join([f"{k} {acf_df.schema[k].dataType.simpleString()}" for k in keys] + [f"{lag} int", "pacf double"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(lag)
        r = pdf[col].to_numpy()
        out, phi = [1.0], np.zeros(0)
        for k in range(1, len(r)):
            last = (r[k] - phi @ r[k - 1 : 0 : -1]) / (1 - phi @ r[1:k]) if k > 1 else r[1]
            phi = np.append(phi - last * phi[::-1], last)
            out.append(last)
        return pd.DataFrame({**{k: pdf[k].to_numpy() for k in keys}, lag: pdf[lag].to_numpy(), "pacf": out})

    return acf_df.withColumn("_one", F.lit(1)).groupBy(*keys or ["_one"]).applyInPandas(lambda p: one(p), kind)


def top_k(df: DataFrame, by, k: int) -> DataFrame:
    return df.orderBy(by).limit(k)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows that a hash of the key picks; reruns agree."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
