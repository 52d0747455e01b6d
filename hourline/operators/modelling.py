"""The modelling table and its predictors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.operators.windows import ffill
from hourline.schema import drop_like

CALENDAR = ("year", "month", "day", "hour", "quarter", "week_of_year", "day_of_week", "day_of_year", "is_weekend")


def modelling_table(df: DataFrame, ts: str, target: str, weather: dict[str, tuple[str, str]], fill: list[str], drop: tuple[str, ...] = ("ntl_",), drop_parts: tuple[str, ...] = ("station_count",), keys=()) -> DataFrame:
    """df without the columns of dropped prefixes and parts, with merged, filled predictors and only rows that have a target.

    weather: a new name for each (preferred, fallback) pair, whose columns go; it and the columns in fill are filled
    forward in the order of ts. A missing target column is an error.
    """
    if target not in df.columns:
        raise ValueError(f"{target} is not a column of {df.columns}")
    df = drop_like(df, drop, drop_parts)
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    merged = df.withColumns({n: F.coalesce(has(a), has(b)) for n, (a, b) in weather.items()})
    merged = merged.drop(*[c for pair in weather.values() for c in pair])
    return ffill(merged, [*weather, *[c for c in fill if c in merged.columns]], ts, keys).where(F.col(target).isNotNull())


def predictors(df: DataFrame, target: str, ts: str, calendar: tuple[str, ...] = CALENDAR) -> list[str]:
    """All columns but the target, the time and those of calendar prefixes, sorted."""
    return sorted(c for c in df.columns if c not in (target, ts) and not c.startswith(tuple(calendar)))
