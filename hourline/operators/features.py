"""Leakage-safe feature preparation: lags, folds, outliers, imputation, scaling. All is fitted on training rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourline.operators import segments
from hourline.operators.quantiles import quantiles


def lag_design(df: DataFrame, target: str, predictors: list[str], ts: str, horizon_days: int, per_day: int = 24, extra: tuple[int, ...] = (0, 24, 168, 8760), keys=()) -> DataFrame:
    """Every predictor and four target lags, shifted by the horizon in rows; the first rows without lags are dropped."""
    h = horizon_days * per_day
    rows, w = segments.haloed(df.where(F.col(target).isNotNull()), ts, h + max(extra), 0, keys)
    lags = {f"{p}_lag": F.lag(p, h).over(w) for p in predictors} | {f"{target}_lag_{n}": F.lag(target, h + n).over(w) for n in extra}
    out = rows.select(*keys, ts, target, "_n", "_own", "_block", *[c.alias(n) for n, c in lags.items()])
    return out.where("_block = _own").where(F.col("_n") > h + max(extra)).drop("_n", "_own", "_block")


def design(df: DataFrame, ts: str, components: list[str], predictors: list[str], target: str, missing: tuple[str, ...] = ()) -> DataFrame:
    """ts, components, predictors and the target last; null predictors and components count as 0, and those named in missing, which df need not have, are 0 where it lacks them."""
    have = {*df.columns}
    unknown = [c for c in [*components, *predictors] if c not in have and c not in missing]
    if unknown:
        raise ValueError(f"{unknown} are no columns of {df.columns}")
    value = lambda c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c)
    return df.select(ts, *[value(c) for c in dict.fromkeys([*components, *predictors])], target)


def rocv_folds(df: DataFrame, ts: str, min_train_years: int, step_years: int, horizons: list[int]) -> DataFrame:
    """fold, cutoff and horizon_days; a cutoff must leave the longest horizon, so all horizons share their folds."""
    span = df.agg(F.min(F.to_date(ts)).alias("a"), F.max(F.to_date(ts)).alias("b")).where("a is not null")
    first = F.add_months("a", 12 * min_train_years)
    last = F.date_sub("b", max(horizons))
    cuts = span.where(first <= last).select(F.posexplode(F.sequence(first, last, F.expr(f"interval {step_years} year"))).alias("fold", "cutoff"))
    return cuts.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))


def cutoffs(folds: DataFrame) -> list[tuple]:
    """(fold, cutoff) in the order of time; folds are few."""
    return sorted({(r["fold"], r["cutoff"]) for r in folds.select("fold", "cutoff").collect()}, key=lambda x: (x[1], x[0]))


def sliced(df: DataFrame, folds: DataFrame, ts: str) -> DataFrame:
    """df with slice, the place (from 0, in the order of cutoffs) of the first fold that trains on a row; all later folds do, too."""
    at = F.lit(0)
    for _, cutoff in cutoffs(folds):
        at = at + (F.col(ts) >= F.lit(cutoff)).cast("int")
    return df.withColumn("slice", at)


def split(df: DataFrame, folds: DataFrame, ts: str, parts: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """Rows of each fold with part train (before the cutoff) or test (up to the horizon), or those of one part.

    The few folds are a constant array that each row is held against, so nothing is joined.
    """
    rows = folds.select("fold", "cutoff", "horizon_days").collect()
    if not rows:
        return df.where("false").join(folds.limit(0)).withColumn("part", F.lit(""))
    every = F.array(*[F.struct(*[F.lit(r[c]).cast(folds.schema[c].dataType).alias(c) for c in ("fold", "cutoff", "horizon_days")]) for r in rows])
    t = F.col(ts)
    train = lambda f: t < f["cutoff"]
    ahead = lambda f: t < F.date_add(f["cutoff"], f["horizon_days"])
    asked = {("train", "test"): ahead, ("test", "train"): ahead, ("train",): train, ("test",): lambda f: ~train(f) & ahead(f)}[tuple(parts)]
    out = df.withColumn("_f", F.explode(F.filter(every, asked)))
    return out.select(*df.columns, "_f.*").withColumn("part", F.when(t < F.col("cutoff"), "train").otherwise("test"))


def train_stats(df: DataFrame, folds: DataFrame, ts: str, cols: list[str]) -> DataFrame:
    """fold, and n, mean, low and high of each column over the training rows of the fold; one aggregate by slices, no row is counted twice."""
    parts = [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("n", F.count), ("sum", F.sum), ("low", F.min), ("high", F.max))]
    every = sliced(df, folds, ts).groupBy("slice").agg(*parts)  # a row a fold and one
    places = df.sparkSession.createDataFrame([(f, i) for i, (f, _) in enumerate(cutoffs(folds))], "fold int, at int")
    whole = places.join(every, F.col("slice") <= F.col("at"), "left").groupBy("fold")
    out = whole.agg(*[f(f"{n}_{c}").alias(f"{n}_{c}") for c in cols for n, f in (("n", F.sum), ("sum", F.sum), ("low", F.min), ("high", F.max))])
    return out.select("fold", *[x for c in cols for x in (F.coalesce(f"n_{c}", F.lit(0)).alias(f"n_{c}"), (F.col(f"sum_{c}") / F.nullif(F.col(f"n_{c}"), F.lit(0))).alias(f"mean_{c}"), F.col(f"low_{c}"), F.col(f"high_{c}"))])


def _fitted(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    return df.where("part = 'train'").groupBy(*keys).agg(*aggs)


def iqr_to_null(df: DataFrame, keys: list[str], cols: list[str], k: float = 1.5) -> DataFrame:
    """Training values beyond k interquartile ranges become null; test rows stay."""
    q = quantiles(df.where("part = 'train'").select(*keys, *cols), keys, cols, [0.25, 0.75]).withColumnsRenamed({c: f"_{c}" for c in cols})
    out = df.join(q, keys, "left")
    for c in cols:
        lo, hi = F.get(f"_{c}", 0), F.get(f"_{c}", 1)
        inside = F.col(c).between(lo - k * (hi - lo), hi + k * (hi - lo))
        out = out.withColumn(c, F.when((F.col("part") != "train") | inside, F.col(c)))
    return out.drop(*[f"_{c}" for c in cols])


def impute_mean(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Nulls of both parts become the training mean, 0.0 where there is none."""
    m = _fitted(df, keys, [F.avg(c).alias(f"_{c}") for c in cols])
    out = df.join(m, keys, "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}", F.lit(0.0)) for c in cols}).drop(*[f"_{c}" for c in cols])


def scale(df: DataFrame, keys: list[str], cols: list[str], keep_bounds: bool = False) -> DataFrame:
    """To 0..1 by the training range, nulls counting as 0; a constant column becomes 0. Bounds stay as lo_ and hi_ if asked for."""
    zero = df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in cols})
    b = _fitted(zero, keys, [f(c).alias(f"{n}_{c}") for c in cols for f, n in ((F.min, "lo"), (F.max, "hi"))])
    out = zero.join(b, keys, "left")
    out = out.withColumns({c: F.coalesce((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)), F.lit(0.0)) for c in cols})
    return out if keep_bounds else out.drop(*[f"{n}_{c}" for c in cols for n in ("lo", "hi")])


def unscale(c: str) -> Column:
    return F.col(c) * (F.col(f"hi_{c}") - F.col(f"lo_{c}")) + F.col(f"lo_{c}")


def in_window(ts: Column, start: str, end: str) -> Column:
    return ts.between(F.lit(start).cast("date"), F.lit(end).cast("date")).cast("int")


def easter(year: Column) -> Column:
    """Easter Sunday by the Gregorian rule, in integer arithmetic."""
    div = lambda a, n: F.floor(a / n)
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    x = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * x, 451)
    n = h + x - 7 * m + 114
    return F.make_date(year, div(n, 31).cast("int"), (n % 31 + 1).cast("int"))


def holiday_flag(date: Column, fixed: tuple[str, ...] = ("01-01", "12-25", "12-26"), from_easter: tuple[int, ...] = (0, 1, 39, 49, 50)) -> Column:
    """1 on fixed days and on days a given distance after Easter."""
    gap = F.datediff(date, easter(F.year(date)))
    return (F.date_format(date, "MM-dd").isin(*fixed) | gap.isin(*from_easter)).cast("int")
