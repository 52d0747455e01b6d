"""From cleaned sources to one hourly table and to forecast scores, in stages.

    python -m hourline aggregate --source DIR --target DIR
    python -m hourline merge --target DIR --start 2012-01-01 --end 2025-12-31
    python -m hourline evaluate --target DIR --load load

Sources are Parquet tables below one folder: ``load`` (timestamp and measures, an hour a row), ``pixels`` (date, value,
quality, fill), ``stations`` (timestamp, station and variables) and any number of ``monthly_*`` (year, month and measures). All
but ``load`` may be absent. Each stage's tables are written with a report beside them and left as they are when they are complete,
so a run that broke goes on where it stopped.
"""

from __future__ import annotations

import argparse
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourline.operators import aggregate, align, evaluate, features, modelling, reshape, windows
from hourline.schema import order_columns
from hourline.session import session
from hourline.sources import sinks

#: What the columns of a source are called in the merged table.
PREFIX = {"pixels": "px_", "stations": "st_", "monthly": "mo_"}


def aggregated(sources: dict[str, DataFrame], total: int | None = None) -> dict[str, DataFrame]:
    """A table an hour, day or month of each source: of hours met twice the row that is last in all its columns stays."""
    out = {}
    for name, df in sources.items():
        if name == "pixels":
            out[name] = aggregate.daily_quality_agg(df, "date", "value", "quality", "fill", total)
        elif name == "stations":
            variables = [c for c in df.columns if c not in ("timestamp", "station")]
            out[name] = aggregate.station_mean(df, "timestamp", variables, variables[0])
        elif name == "load":
            out[name] = windows.dedupe_last(df, ["timestamp"], [c for c in df.columns if c != "timestamp"] or ["timestamp"])
    months = {n: df for n, df in sources.items() if n.startswith("monthly")}
    if months:
        named = [df.select("year", "month", *[F.col(c).alias(f"{n.removeprefix('monthly').strip('_')}_{c}".strip("_")) for c in df.columns if c not in ("year", "month")]) for n, df in sorted(months.items())]
        out["monthly"] = align.outer_chain(named, ["year", "month"])
    return out


def merged(spine: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """The spine (timestamp) with its calendar and what each part has for its hour, day or month, in a fixed order of columns."""
    out = reshape.calendar_features(spine, "timestamp")
    if "load" in parts:
        out = align.join_on_hour(out, parts["load"])
    if "stations" in parts:
        out = align.join_on_hour(out, parts["stations"], prefix=PREFIX["stations"])
    if "pixels" in parts:
        out = align.join_on_day(out, parts["pixels"].drop("year"), prefix=PREFIX["pixels"])
    if "monthly" in parts:
        out = align.join_on_month(out, parts["monthly"], PREFIX["monthly"])
    load = [c for c in parts["load"].columns if c != "timestamp"] if "load" in parts else []
    calendar = [c for c in modelling.CALENDAR if c in out.columns]
    return order_columns(out, ["timestamp", *load], [*PREFIX.values()], calendar)


def evaluated(table: DataFrame, target: str, horizons: tuple[int, ...] = (60,), per_day: int = 24, min_train_years: int = 2, step_years: int = 1, lags: tuple[int, ...] = (0, 24, 168), ts: str = "timestamp") -> DataFrame:
    """model, fold, cutoff, horizon_days and scores of a linear model (trend, day, week, year and lags) and of the value a horizon before.

    Predictors are the columns of the sources, filled forward and lagged by the horizon, so nothing of the time forecast is known.
    """
    fill = [c for c in table.columns if c.startswith(tuple(PREFIX.values()))]
    clean = modelling.modelling_table(table, ts, target, {}, fill, drop=(), drop_parts=("count",))
    predictors = [c for c in fill if c in clean.columns]
    folds = features.rocv_folds(clean.select(F.to_date(ts).alias("day")), "day", min_train_years, step_years, list(horizons))
    out = None
    for horizon in horizons:  # few; each has lags of its own
        rows = features.lag_design(clean, target, predictors, ts, horizon, per_day, lags)
        rows, cycle = evaluate.fourier(rows, ts, {"day": 1.0, "week": 7.0, "year": 365.25})
        inputs = [c for c in rows.columns if c.endswith("_lag") or c.startswith(f"{target}_lag_")]
        own = features.design(rows, ts, cycle, inputs, target).withColumn("day", F.to_date(ts))
        said = evaluate.forecast_linear(own, target, [*cycle, *inputs], folds.where(F.col("horizon_days") == horizon), "day")
        both = said.select("fold", "cutoff", "horizon_days", target, F.col("yhat").alias("linear"), F.col(f"{target}_lag_{lags[0]}").alias("naive"))
        out = both if out is None else out.unionByName(both)
    long = out.unpivot(["fold", "cutoff", "horizon_days", target], ["linear", "naive"], "model", "yhat")
    return evaluate.score(long, target, "yhat", ["model", "fold", "cutoff", "horizon_days"])


def _tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The Parquet tables below a folder, by name; those that have no success marker are not complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(f.getPath().getName() for f in found if f.isDirectory())
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names if not n.endswith("_quality") and sinks.done(spark, f"{folder}/{n}")}


def run_aggregate(spark: SparkSession, source: str, target: str, total: int | None = None, force: bool = False) -> list[str]:
    """Writes the aggregated tables below target/aggregated; the names of those that it made."""
    made = []
    for name, df in aggregated(_tables(spark, source), total).items():
        ts = {"pixels": "date", "monthly": "month"}.get(name, "timestamp")
        write = partial(sinks.write_by_year, sort=ts) if name != "monthly" else sinks.write_single
        kept = partial(sinks.write_reported, write=write, source=name, stage="aggregate")
        if sinks.stage(spark, f"{target}/aggregated/{name}", lambda df=df: df, lambda d, p, kept=kept: kept(d, p), force):
            made.append(name)
    return made


def run_merge(spark: SparkSession, target: str, start: str, end: str, force: bool = False) -> bool:
    """Writes target/merged, by year."""
    parts = {n: df.drop("year") if n not in ("monthly",) else df for n, df in _tables(spark, f"{target}/aggregated").items()}
    write = partial(sinks.write_reported, write=partial(sinks.write_by_year, sort="timestamp"), source="merged", stage="merge")
    return sinks.stage(spark, f"{target}/merged", lambda: merged(reshape.hourly_spine(spark, start, end), parts), lambda d, p: write(d, p), force)


def run_evaluate(spark: SparkSession, target: str, load: str, horizons: tuple[int, ...] = (60,)) -> None:
    """Writes scores a fold, and their summary, below target/scores."""
    scores = evaluated(spark.read.parquet(f"{target}/merged"), load, horizons)
    sinks.write_results({"folds": scores, "summary": evaluate.summarise(scores, ["model", "horizon_days"])}, f"{target}/scores")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m hourline", description=__doc__.split("\n")[0])
    p.add_argument("stage", choices=["aggregate", "merge", "evaluate"])
    p.add_argument("--source", help="folder of the sources (aggregate)")
    p.add_argument("--target", required=True, help="folder of all that is written")
    p.add_argument("--pixels", type=int, help="pixels of a complete day; days with too few have no mean")
    p.add_argument("--start", default="2012-01-01")
    p.add_argument("--end", default="2025-12-31")
    p.add_argument("--load", default="load", help="the column to forecast")
    p.add_argument("--horizons", type=int, nargs="+", default=[60], help="days")
    p.add_argument("--force", action="store_true", help="make tables again that are complete")
    p.add_argument("--master", help="the Spark master, where spark-submit doesn't give one")
    a = p.parse_args(argv)
    spark = session(a.master)
    if a.stage == "aggregate":
        if not a.source:
            p.error("aggregate needs --source")
        run_aggregate(spark, a.source, a.target, a.pixels, a.force)
    elif a.stage == "merge":
        run_merge(spark, a.target, a.start, a.end, a.force)
    else:
        run_evaluate(spark, a.target, a.load, tuple(a.horizons))
