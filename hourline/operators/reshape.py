"""Unpivots, pivots, period expansion and generated keys."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT_MONTHS = {"quarter": 3, "semester": 6, "year": 12}


def hours_to_long(df: DataFrame, ids: list[str]) -> DataFrame:
    """Columns named 0 to 23 (or 0.0 ...) to rows of hour and value."""
    hours = [c for c in df.columns if re.fullmatch(r"\d+(\.0)?", c)]
    long = df.select(*ids, *[F.col(f"`{c}`").alias(str(int(float(c)))) for c in hours]).unpivot(ids, [str(int(float(c))) for c in hours], "hour", "value")
    return long.withColumn("hour", F.col("hour").cast("int"))


def pivot_first(df: DataFrame, keys: list[str], col: str, value: str, names: list[str], order: str | None = None) -> DataFrame:
    """One column a name; of several values of a cell the first non-null one by order, else the least, so that reruns agree."""
    first = F.min(value) if order is None else F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    return df.groupBy(*keys).pivot(col, names).agg(first)


def grid_to_rows(df: DataFrame, keys: list[str], variables: dict[str, str]) -> DataFrame:
    """Arrays over stations to a row a station: keys, station (from 0) and a column for each name of variables (name -> array column).

    NaN becomes null; a variable whose column df lacks, or whose array is shorter than others, is null.
    """
    have = {n: c for n, c in variables.items() if c in df.columns}
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in have.items()])
    rows = df.select(*keys, F.posexplode(zipped).alias("station", "v"))
    value = lambda n: F.nanvl(F.col("v")[n].cast("double"), F.lit(None).cast("double")) if n in have else F.lit(None).cast("double")
    return rows.select(*keys, "station", *[value(n).alias(n) for n in variables])


def expand_period(df: DataFrame, unit: str, year: str = "year", n: str | None = None) -> DataFrame:
    """Repeats a quarter, semester or year for each of its months."""
    months = UNIT_MONTHS[unit]
    first = (F.col(n) - 1) * months + 1 if n else F.lit(1)
    return df.withColumn("month", F.explode(F.sequence(first.cast("int"), (first + months - 1).cast("int"))))


def bands_to_wide(df: DataFrame, keys: list[str], bands: list[str], component: str, prefix: str, components: list[str]) -> DataFrame:
    """Band columns to rows named prefix_band_component and back to one column a name."""
    long = df.unpivot([*keys, component], bands, "band", "value").withColumn("name", F.concat_ws("_", F.lit(prefix), "band", component))
    return pivot_first(long, keys, "name", "value", [f"{prefix}_{b}_{c}" for b in bands for c in components])


def hourly_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every hour from start 00:00 to end 23:00."""
    return spark.sql(f"SELECT explode(sequence(timestamp_ntz'{start} 00:00:00', timestamp_ntz'{end} 23:00:00', interval 1 hour)) AS timestamp")


#: Slots that one task makes at once.
SLOTS = 1 << 14


def expected_keys(df: DataFrame, ts: str, unit: str, keys: list[str] = (), slots: int = SLOTS) -> DataFrame:
    """Every hour, day or month between the first and the last of df (of each series); long spans are made by many tasks."""
    span = df.groupBy(*keys).agg(F.min(ts).alias("a"), F.max(ts).alias("b")).where("a is not null")
    if unit.lower().rstrip("s") == "month":  # months count from the first one, and are few
        return span.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias(ts))
    parts = span.select(*keys, "b", F.explode(F.sequence("a", "b", F.expr(f"interval {slots} {unit}"))).alias("a")).repartition("a")
    last = F.least(F.col("b"), (F.col("a") + F.expr(f"interval {slots - 1} {unit}")).cast(df.schema[ts].dataType))
    return parts.select(*keys, F.explode(F.sequence(F.col("a"), last, F.expr(f"interval 1 {unit}"))).alias(ts))


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    c = F.col(ts)
    out = {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "hour": F.hour(c), "day_of_week": F.dayofweek(c), "is_weekend": F.dayofweek(c).isin(1, 7).cast("int"), "day_of_year": F.dayofyear(c), "week_of_year": F.weekofyear(c), "quarter": F.quarter(c)}
    return df.withColumns(out)


def explode_raster(df: DataFrame, band: str, quality: str | None = None, keys: list[str] = ()) -> DataFrame:
    """Rows of a band (array<array>) and its quality band to one row a cell."""
    both = F.arrays_zip(F.col(band).alias("band"), F.col(quality).alias("q")) if quality else F.transform(F.col(band), lambda r: F.struct(r.alias("band"), F.lit(None).cast("array<int>").alias("q")))
    rows = df.select(*keys, F.posexplode(both).alias("row_idx", "r"))
    cells = rows.select(*keys, "row_idx", F.posexplode(F.arrays_zip(F.col("r.band").alias("value"), F.coalesce("r.q", F.array().cast("array<int>")).alias("quality"))).alias("col_idx", "c"))
    return cells.select(*keys, "row_idx", "col_idx", F.col("c.value").alias("value"), F.col("c.quality").alias("quality"))


def axis_range(axis: Column, low: float, high: float) -> Column:
    """struct(first, n): where a sorted axis, rising or falling, lies within bounds."""
    at = F.filter(F.transform(axis, lambda v, i: F.when(v.between(low, high), i)), lambda i: i.isNotNull())
    return F.struct(F.coalesce(F.array_min(at), F.lit(0)).alias("first"), F.size(at).alias("n"))


def crop_raster(df: DataFrame, band: str, lat: str, lon: str, box: tuple[float, float, float, float], quality: str | None = None, keys: list[str] = ()) -> DataFrame:
    """Cells within a box (west, south, east, north) with their places in the whole raster and their coordinates.

    lat and lon are columns of sorted axes beside the band (array<array>, a row a latitude). The bounds are looked up in the axes
    and the arrays cut to them before they are taken apart, so cells outside are never made. A granule without a cell inside, or
    with a null band, gives none; cells that a band's row lacks are null.
    """
    west, south, east, north = box
    # a lambda's parameter is computed once a granule, however often it is used
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    cut = lambda a, r: F.slice(a, r["first"] + 1, r["n"])
    none = F.lit(None).cast("array<array<int>>")
    marks = F.col(quality) if quality else none

    def rows_of(r: Column) -> Column:
        both = F.arrays_zip(cut(F.col(lat), r["rows"]).alias("lat"), cut(F.col(band), r["rows"]).alias("band"), F.coalesce(cut(marks, r["rows"]), F.array()).alias("q"))
        lons = cut(F.col(lon), r["cols"])
        return F.transform(both, lambda x, i: F.struct((r["rows"]["first"] + i).alias("row_idx"), r["cols"]["first"].alias("left"), x["lat"].alias("lat"), F.arrays_zip(lons.alias("lon"), F.coalesce(cut(x["band"], r["cols"]), F.array()).alias("value"), F.coalesce(cut(x["q"], r["cols"]), F.array()).alias("quality")).alias("cells")))

    ranges = F.struct(axis_range(F.col(lat), south, north).alias("rows"), axis_range(F.col(lon), west, east).alias("cols"))
    rows = df.where(F.col(band).isNotNull()).select(*keys, F.explode(once(ranges, rows_of)).alias("r"))
    cells = rows.select(*keys, "r.row_idx", "r.left", "r.lat", F.posexplode("r.cells").alias("i", "c"))
    return cells.select(*keys, "row_idx", (F.col("left") + F.col("i")).alias("col_idx"), "lat", "c.lon", "c.value", "c.quality")
