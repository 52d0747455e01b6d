"""Boxes, polygons and masks over grids of points."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GEOMETRY = "type string, coordinates array<array<array<array<double>>>>"


def bbox(df: DataFrame, x: str, y: str, west: float, south: float, east: float, north: float) -> DataFrame:
    return df.where(F.col(x).between(west, east) & F.col(y).between(south, north))


def polygon_edges(rows: DataFrame, geojson: str) -> DataFrame:
    """x1, y1, x2, y2 of all rings of MultiPolygon geometries given as JSON text."""
    rings = rows.select(F.explode(F.flatten(F.from_json(geojson, GEOMETRY)["coordinates"])).alias("ring"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("ring") - 1), lambda i: F.struct(F.get("ring", i - 1).alias("a"), F.get("ring", i).alias("b")))
    edges = rings.where(F.size("ring") > 1).select(F.explode(pairs).alias("e"))
    return edges.select(F.get("e.a", 0).alias("x1"), F.get("e.a", 1).alias("y1"), F.get("e.b", 0).alias("x2"), F.get("e.b", 1).alias("y2"))


#: Edges that are sent to all tasks at most, as four numbers each; beyond, points and edges are dealt to bands.
EDGES = 100_000


def _crosses(px: Column, py: Column, e) -> tuple[Column, Column]:
    """Whether a ray to the right of a point crosses an edge, and whether the point lies on it."""
    x1, y1, x2, y2 = (e(c) for c in ("x1", "y1", "x2", "y2"))
    cross = (y1 != y2) & ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)
    turn = (px - x1) * (y2 - y1) - (py - y1) * (x2 - x1)
    return cross, (turn == 0) & px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))


def inside(df: DataFrame, edges: DataFrame, x: str, y: str, most: int = EDGES) -> DataFrame:
    """Rows of df whose point is inside the rings, by the even-odd rule over all of them; points on an edge are outside.

    The edges are sorted into bands of y, a row's point meets those of its own band only. They go along with each task as one small array,
    so no point is moved; with more than most edges, points and edges meet by a join on the band.
    """
    few = edges.select("x1", "y1", "x2", "y2").dropna().limit(most + 1).collect()
    if not few:
        return df.where(F.lit(False))
    lo, hi = min(min(e[1], e[3]) for e in few), max(max(e[1], e[3]) for e in few)
    if len(few) > most:
        whole = edges.agg(F.min(F.least("y1", "y2")).alias("lo"), F.max(F.greatest("y1", "y2")).alias("hi")).first()
        lo, hi = whole["lo"], whole["hi"]
    bands, span = max(1, min(len(few), 1 << 14)), float(hi - lo)
    band = lambda c: F.least(F.floor((c.cast("double") - lo) / span * bands) if span else F.lit(0), F.lit(bands - 1)).cast("int")
    near = df.where(F.col(y).between(lo, hi))
    if len(few) > most:
        return near.join(_banded(near, edges, x, y, band), [x, y], "left_semi")
    index: list[list] = [[] for _ in range(bands)]
    at = lambda v: min(math.floor((v - lo) / span * bands), bands - 1) if span else 0
    for e in few:
        for i in range(at(min(e[1], e[3])), at(max(e[1], e[3])) + 1):
            index[i].append(dict(zip(("x1", "y1", "x2", "y2"), map(float, e))))
    # a constant of the plan: it is read once and goes along with the tasks
    held = F.from_json(F.lit(json.dumps(index)), "array<array<struct<x1:double,y1:double,x2:double,y2:double>>>")
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    start = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("on"))

    def meet(s: Column, e: Column) -> Column:
        cross, on = _crosses(px, py, lambda c: e[c])
        return F.struct((s["odd"] != cross).alias("odd"), (s["on"] | on).alias("on"))

    return near.where(F.aggregate(F.get(held, band(F.col(y))), start, meet, lambda s: s["odd"] & ~s["on"]))


def mask_points(grid: DataFrame, edges: DataFrame, x: str, y: str, most: int = EDGES) -> DataFrame:
    """Distinct points of grid inside the rings; a mask that is made once and joined to the grids of many days."""
    return inside(grid.select(x, y), edges, x, y, most).distinct()


def _banded(points: DataFrame, edges: DataFrame, x: str, y: str, band) -> DataFrame:
    """Distinct points inside the rings, points and edges being dealt to bands."""
    dealt = edges.withColumn("_band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    both = points.select(x, y).distinct().withColumn("_band", band(F.col(y))).join(dealt, "_band")
    cross, on = _crosses(F.col(x).cast("double"), F.col(y).cast("double"), F.col)
    return both.groupBy(x, y).agg(F.count_if(cross).alias("n"), F.max(on).alias("on")).where("n % 2 = 1 and not on").select(x, y)
