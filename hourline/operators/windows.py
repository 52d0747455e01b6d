"""Window operators over series. keys names the series; without keys there is one.

Many tasks share one series: fills and gaps run over segments of time, lags, rolling means and decompositions over blocks of
rows that also hold what is looked for of the blocks beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourline.operators import segments
from hourline.operators.reshape import expected_keys
from hourline.operators.segments import BLOCK, SEG, WIDTH


def dedupe_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in order."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def lag_rows(df: DataFrame, col: str, ts: str, n: int, name: str, keys=(), block: int = BLOCK) -> DataFrame:
    """The value n rows before."""
    return lag_many(df, {name: (col, n)}, ts, keys, block)


def lag_many(df: DataFrame, lags: dict[str, tuple[str, int]], ts: str, keys=(), block: int = BLOCK) -> DataFrame:
    """A column for each name: the value of a column so many rows before."""
    rows, w = segments.haloed(df, ts, max(n for _, n in lags.values()), 0, keys, block)
    return _own(rows.withColumns({name: F.lag(c, n).over(w) for name, (c, n) in lags.items()}))


def _own(rows: DataFrame) -> DataFrame:
    return rows.where("_block = _own").drop("_n", "_own", "_block")


def lag_time(df: DataFrame, col: str, ts: str, interval: str, name: str, keys=()) -> DataFrame:
    """The value exactly an interval before; null where that time is missing."""
    past = df.select(*keys, (F.col(ts) + F.expr(f"interval {interval}")).alias(ts), F.col(col).alias(name))
    return df.join(past, [*keys, ts], "left")


def ffill(df: DataFrame, cols: list[str], ts: str, keys=(), width: float = WIDTH) -> DataFrame:
    """Nulls become the last value before them; those before the first value stay."""
    rows = segments.cut(df, ts, width)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(ts))).alias(f"v{i}") for i, c in enumerate(cols)]
    none = F.struct(*[F.lit(None).cast(df.schema[c].dataType).alias(f"v{i}") for i, c in enumerate(cols)])
    step = lambda s, x: F.struct(*[F.coalesce(x[f"v{i}"], s[f"v{i}"]).alias(f"v{i}") for i in range(len(cols))])
    before = segments.scan(rows.groupBy(*keys, SEG).agg(*last), keys, ("_before", none, step, False))
    w = segments.window(ts, keys).rowsBetween(W.unboundedPreceding, 0)
    inside = rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    filled = segments.back(inside, before, keys).withColumns({c: F.coalesce(c, F.col("_before")[f"v{i}"]) for i, c in enumerate(cols)})
    return filled.select(*df.columns)


def interpolate(df: DataFrame, col: str, ts: str, limit: int, keys=(), width: float = WIDTH) -> DataFrame:
    """Straight lines over gaps, of which the first limit rows are filled; the last value goes on for limit rows."""
    w = segments.window(ts, keys)
    rows = segments.cut(df, ts, width).withColumn("_p", F.row_number().over(w).cast("long"))
    rows = rows.withColumn("_h", F.when(F.col(col).isNotNull(), F.struct(F.col("_p").alias("p"), F.col(col).alias("v"))))
    ends = rows.groupBy(*keys, SEG).agg(F.max("_p").alias("n"), F.min("_h").alias("first"), F.max("_h").alias("last"))
    kind = df.schema[col].dataType
    none = F.struct(F.lit(None).cast("long").alias("p"), F.lit(None).cast(kind).alias("v"))
    moved = lambda h, by: F.struct((h["p"] + by).alias("p"), h["v"].alias("v"))
    known = lambda h, other: F.when(h.isNotNull(), h).otherwise(other)
    ahead = lambda s, x: F.struct((s["n"] + x["n"]).alias("n"), F.when(x["last"].isNotNull(), moved(x["last"], s["n"])).otherwise(s["h"]).alias("h"))
    # what follows a segment is counted from its own first row: rows of segments between are added on the way
    behind = lambda s, x: moved(known(x["first"], F.when(s["p"].isNotNull(), moved(s, x["n"])).otherwise(none)), F.lit(0))
    states = segments.scan(ends, keys, ("_a", F.struct(F.lit(0).cast("long").alias("n"), none.alias("h")), ahead, False), ("_b", none, behind, True))
    out = rows.withColumn("_l", F.last("_h", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_r", F.first("_h", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))).withColumn("_n", F.count("*").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    out = segments.back(out, states, keys)
    left, right = known(F.col("_l"), moved(F.col("_a.h"), -F.col("_a.n"))), known(F.col("_r"), moved(F.col("_b"), F.col("_n")))
    d = F.col("_p") - left["p"]
    line = left["v"] + (right["v"] - left["v"]) * d / F.nullif(right["p"] - left["p"], F.lit(0))
    return out.withColumn(col, F.coalesce(F.col(col), F.when(d <= limit, F.coalesce(line, left["v"])))).select(*df.columns)


def rolling_centered(df: DataFrame, col: str, ts: str, w: int, name: str, min_periods: int | None = None, keys=(), block: int = BLOCK) -> DataFrame:
    """Mean of w rows around each row; for even w one more before than after. Null with fewer than min_periods values."""
    back, ahead = w // 2, w - w // 2 - 1
    rows, order = segments.haloed(df, ts, back, ahead, keys, block)
    over = order.rowsBetween(-back, ahead)
    return _own(rows.withColumn(name, F.when(F.count(col).over(over) >= (min_periods or w), F.avg(col).over(over))))


def regularise(df: DataFrame, ts: str, unit: str, keys=()) -> DataFrame:
    """Every slot between the first and the last row; missing ones are null."""
    return expected_keys(df, ts, unit, keys).join(df, [*keys, ts], "left")


def gap_ranges(df: DataFrame, ts: str, unit: str, keys=(), width: float = WIDTH) -> DataFrame:
    """start, end and length of each run of missing hours, days or months between a series' first and last row; rows off the slots that its first row begins don't count."""
    kind = df.schema[ts].dataType
    first = df.groupBy(*keys).agg(F.min(ts).alias("_first"))
    seen = df.where(F.col(ts).isNotNull()).select(*keys, ts).distinct()
    slot = F.expr(f"timestampadd({unit}, timestampdiff({unit}, _first, `{ts}`), _first)").cast(kind)
    rows = segments.cut(segments.meet(seen, first, keys).where(slot == F.col(ts)), ts, width)
    ends = rows.groupBy(*keys, SEG).agg(F.max(ts).alias("t"))
    before = segments.scan(ends, keys, ("_before", F.lit(None).cast(kind), lambda s, x: x["t"], False))
    rows = segments.back(rows.withColumn("_last", F.lag(ts).over(segments.window(ts, keys))), before, keys).withColumn("_last", F.coalesce("_last", "_before"))
    n, step = F.expr(f"timestampdiff({unit}, _last, `{ts}`)"), F.expr(f"interval 1 {unit}")
    gaps = rows.where(n > 1)
    return gaps.select(*keys, (F.col("_last") + step).cast(kind).alias("gap_start"), (F.col(ts) - step).cast(kind).alias("gap_end"), (n - 1).alias("length"))


def decompose(df: DataFrame, col: str, ts: str, period: int, keys=(), least: int | None = None, block: int = BLOCK) -> DataFrame:
    """Classical additive decomposition: centred moving average, phase means of the rest (centred), residual.

    A series of fewer than least rows (three periods unless given) has no rows.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= (3 * period if least is None else least))
    half = period // 2
    rows, w = segments.haloed(segments.meet(df, sizes, keys).drop("_rows"), ts, half, half, keys, block)
    wide, inner = w.rowsBetween(-half, half), w.rowsBetween(-half + 1, half - 1)
    if period % 2:
        trend, full = F.sum(col).over(wide) / period, F.count(col).over(wide) == period
    else:
        trend, full = (F.sum(col).over(wide) + F.sum(col).over(inner)) / (2 * period), F.count(col).over(wide) == period + 1
    out = rows.withColumn("trend", F.when(full, trend)).withColumn("_phase", (F.col("_n") - 1) % period)
    out = _own(out)
    phase = out.groupBy(*keys, "_phase").agg(F.avg(F.col(col) - F.col("trend")).alias("_s"))
    phase = phase.withColumn("seasonal", F.col("_s") - F.avg("_s").over(W.partitionBy(*keys))).drop("_s")  # a row a phase
    out = segments.meet(out, phase, [*keys, "_phase"]).drop("_phase")
    return out.withColumn("resid", F.col(col) - F.col("trend") - F.col("seasonal"))


def trim(df: DataFrame, ts: str, first: int = 0, last: int = 0, keys=()) -> DataFrame:
    """df without its first and last rows, so many, in the order of ts."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    rows = segments.meet(segments.numbered(df, ts, "_n", keys), sizes, keys)
    return rows.where((F.col("_n") > first) & (F.col("_n") <= F.col("_rows") - last)).drop("_n", "_rows")


def last_rows(df: DataFrame, ts: str, n: int, keys=()) -> DataFrame:
    """The last n rows in the order of ts."""
    if not keys:
        return df.orderBy(F.desc(ts)).limit(n)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return segments.meet(segments.numbered(df, ts, "_n", keys), sizes, keys).where(F.col("_n") > F.col("_rows") - n).drop("_n", "_rows")


def recent(df: DataFrame, ts: str, months: int) -> DataFrame:
    """The rows later than so many months before the last one."""
    last = df.agg(F.add_months(F.max(F.to_date(ts)), -months).alias("_after"))  # one row
    return df.join(last, F.to_date(F.col(ts)) > F.col("_after")).drop("_after")
