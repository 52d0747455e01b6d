"""Series cut into spans of time, so that many tasks work on one long series.

Rows are dealt out and ordered by segment, a span of fixed width. What passes from one segment to the next (how many rows
came before, the last value, the next one) is taken from one row a segment: these stand in one array a series, which is
gone through once, and come back by a join on the segment, by which the rows lie already. So the rows of a series meet in
no task; the segments' rows do, a few hundred for ten years at the usual width. Rows without a time come first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEG = "_seg"
#: 30 days; a series denser than a row a second takes less.
WIDTH = 30 * 86400


def of(df: DataFrame, ts: str, width: float = WIDTH) -> Column:
    """The segment of a row: whole widths (seconds; the column's own unit if it is a number) since 1970."""
    kind, c = df.schema[ts].dataType, F.col(ts)
    if isinstance(kind, T.DateType):
        at = F.unix_date(c) * F.lit(86400)
    elif isinstance(kind, T.TimestampNTZType):
        at = F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`)")
    elif isinstance(kind, T.TimestampType):
        at = F.unix_seconds(c)
    else:
        at = c
    return F.coalesce(F.floor(at / F.lit(width)).cast("long"), F.lit(-(1 << 62)))


def cut(df: DataFrame, ts: str, width: float = WIDTH) -> DataFrame:
    return df.withColumn(SEG, of(df, ts, width))


def window(ts: str, keys=()):
    return W.partitionBy(*keys, SEG).orderBy(ts)


def scan(summary: DataFrame, keys, *passes: tuple[str, Column, Callable[[Column, Column], Column], bool]) -> DataFrame:
    """keys, segment and a column for each pass (name, start, step, last_first): the state in front of each segment.

    A state is start, then step(state, row of the segment before), a row at a time in their order, or against it if last_first.
    """
    facts = [c for c in summary.columns if c not in keys and c != SEG]
    one = summary.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(SEG, *facts))).alias("a"))
    out = one.withColumn(SEG, F.transform("a", lambda x: x[SEG]))
    for name, start, step, last_first in passes:
        kind = one.select(F.array(start).alias("o")).schema["o"].dataType.simpleString()
        into = lambda acc, x: F.struct(F.concat(acc["o"], F.array(acc["s"])).alias("o"), step(acc["s"], x).alias("s"))
        states = F.aggregate(F.reverse("a") if last_first else F.col("a"), F.struct(F.array().cast(kind).alias("o"), start.alias("s")), into, lambda acc: acc["o"])
        out = out.withColumn(name, F.reverse(states) if last_first else states)
    return out.select(*keys, F.inline(F.arrays_zip(SEG, *[p[0] for p in passes])))


def meet(rows: DataFrame, facts: DataFrame, on, how: str = "inner") -> DataFrame:
    """rows with the facts of their keys, null keys included; both may come from one table."""
    named = facts.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return rows.join(named, same, how).drop(*[f"_on_{c}" for c in on])


def back(rows: DataFrame, states: DataFrame, keys=()) -> DataFrame:
    """rows with what stands in front of their segments."""
    return rows.join(states, SEG, "left") if not keys else meet(rows, states, [*keys, SEG], "left")


def numbered(df: DataFrame, ts: str, name: str, keys=(), width: float = WIDTH) -> DataFrame:
    """df with the number of each row in its series, from 1."""
    rows = cut(df, ts, width)
    sizes = rows.groupBy(*keys, SEG).agg(F.count("*").alias("n"))
    before = scan(sizes, keys, ("_before", F.lit(0).cast("long"), lambda s, x: s + x["n"], False))
    inside = rows.withColumn(name, F.row_number().over(window(ts, keys)).cast("long"))
    return back(inside, before, keys).withColumn(name, F.col(name) + F.col("_before")).drop("_before", SEG)


#: Rows of a block.
BLOCK = 1 << 13


def haloed(df: DataFrame, ts: str, back: int, ahead: int, keys=(), block: int = BLOCK):
    """df's rows in blocks by their number (_n) in the series, and a window over a block in their order.

    Rows near the edges of a block go to its neighbours, too, so that a window sees so many rows back and ahead of each
    of the block's own rows, which are those where _block = _own; at most three times as many rows as the series has are made,
    and hardly more than itself where blocks are longer than what is looked for.
    """
    block = max(block, back, ahead, 1)
    place, own = (F.col("_n") - 1) % block, F.floor((F.col("_n") - 1) / block)
    near = F.array(own, F.when(place >= block - back, own + 1), F.when((place < ahead) & (own > 0), own - 1))
    rows = numbered(df, ts, "_n", keys).withColumn("_own", own).withColumn("_block", F.explode(F.filter(near, lambda b: b.isNotNull())))
    return rows, W.partitionBy(*keys, "_block").orderBy("_n")
