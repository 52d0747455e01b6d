"""Exact quantiles of groups of any size.

Spark's own percentile keeps a group's distinct values in one task. That is right for groups of up to ``MOST`` rows; a larger
group's order statistics are selected from all tasks: equal-depth histograms (mergeable sketches of bounded size) bracket
each rank, the rows below and on the bracket's edges are counted, and what lies strictly inside is bracketed again, until
it is few values. Edges are values of the data and counted apart, so ties, however many, are settled by counts. Results are
those of percentile: linear between neighbours, NaN the greatest, nulls left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.operators.segments import meet
from hourline.session import cut_lineage

#: Rows of a group that one task sorts by percentile; values of a bracket that one task sorts at the end.
MOST, FEW = 1_000_000, 20_000
#: Steps of a histogram; its ranks are right to a hundredth of a step.
STEPS = 128


def quantiles(df: DataFrame, keys: list[str], cols: list[str], probs: list[float], most: int = MOST, few: int = FEW) -> DataFrame:
    """keys and, under the name of each of cols, the array of its quantiles."""
    usual = [F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in cols]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    if (sizes.agg(F.max("_rows").alias("n")).first()["n"] or 0) <= most:
        return df.groupBy(*keys).agg(*usual)
    named = meet(df, sizes, keys)
    small = named.where(F.col("_rows") <= most).groupBy(*keys).agg(*usual)
    values = F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)]))
    long = named.where(F.col("_rows") > most).select(*keys, values).where("_v is not null")
    by = [*keys, "_c"]
    counts = long.groupBy(*by).agg(F.count("*").alias("_n"), F.count_if(~F.isnan("_v")).alias("_real"))
    asked = counts.select(*by, "_n", "_real", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p")).withColumn("_at", F.col("_p") * (F.col("_n") - 1))
    asked = cut_lineage(asked.withColumn("_lo", F.floor("_at")).withColumn("_hi", F.ceil("_at")))
    ranks = asked.select(*by, "_real", F.explode(F.array("_lo", "_hi")).alias("_rank")).distinct().where(F.col("_rank") < F.col("_real")).drop("_real")
    found = selected(long.where(~F.isnan("_v")), by, ranks, few)
    for end in ("_lo", "_hi"):
        of = found.select(*by, F.col("_rank").alias(end), F.col("_value").alias(f"{end}_value"))
        asked = meet(asked, of, [*by, end], "left").withColumn(f"{end}_value", F.coalesce(f"{end}_value", F.lit(float("nan"))))
    line = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo_value")).otherwise((F.col("_hi") - F.col("_at")) * F.col("_lo_value") + (F.col("_at") - F.col("_lo")) * F.col("_hi_value"))
    each = asked.withColumn("_q", line).groupBy(*keys).agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("_c") == i, F.struct("_i", "_q")))), lambda x: x["_q"]).alias(c) for i, c in enumerate(cols)])
    whole = [F.when(F.size(c) > 0, F.col(c)).alias(c) for c in cols]
    large = each.select(*keys, *whole)
    return small.unionByName(large) if keys else large  # without keys there is one group, which is large


def selected(rows: DataFrame, by: list[str], ranks: DataFrame, few: int = FEW) -> DataFrame:
    """by, _rank and _value: the value (_v) of each rank (from 0) among the rows of its group."""
    none = F.lit(None).cast("double")
    todo = ranks.withColumns({"_a": none, "_b": none, "_skip": F.lit(0).cast("long"), "_left": F.lit(None).cast("long")})
    done, last = [], []
    of = [*by, "_rank"]
    grid = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])

    def inside(state: DataFrame):
        joined = meet(rows, state, by)
        return joined.where((F.col("_a").isNull() | (F.col("_v") > F.col("_a"))) & (F.col("_b").isNull() | (F.col("_v") < F.col("_b"))))

    while True:
        seen = inside(todo)
        sketch = seen.groupBy(*of).agg(F.count("*").alias("_m"), F.max("_skip").alias("_s"), F.percentile_approx("_v", grid, 100 * STEPS).alias("_g"))
        step = (F.col("_rank") - F.col("_s")) / F.greatest(F.col("_m") - 1, F.lit(1)) * STEPS
        edges = sketch.select(*of, F.get("_g", F.greatest(F.floor(step) - 1, F.lit(0)).cast("int")).alias("_from"), F.get("_g", F.least(F.ceil(step) + 1, F.lit(STEPS)).cast("int")).alias("_to"))
        v, a, b = F.col("_v"), F.col("_from"), F.col("_to")
        counted = meet(seen, edges, of).groupBy(*of).agg(F.max("_skip").alias("_s"), F.first("_from").alias("_from"), F.first("_to").alias("_to"), F.count_if(v < a).alias("_below"), F.count_if(v == a).alias("_on_a"), F.count_if((v > a) & (v < b)).alias("_mid"))
        start = F.col("_s") + F.col("_below")
        past = start + F.col("_on_a")
        value = F.when(F.col("_rank") < past, a).when(F.col("_rank") >= past + F.col("_mid"), b)
        state = cut_lineage(counted.select(*of, value.alias("_value"), F.col("_from").alias("_a"), F.col("_to").alias("_b"), past.alias("_skip"), F.col("_mid").alias("_left")))
        done.append(state.where("_value is not null").select(*of, "_value"))
        last.append(state.where(F.col("_value").isNull() & (F.col("_left") <= few)).drop("_value"))
        todo = state.where(F.col("_value").isNull() & (F.col("_left") > few)).drop("_value")
        if todo.isEmpty():
            break
    for state in last:
        sorted_ = inside(state).groupBy(*of).agg(F.max("_skip").alias("_s"), F.sort_array(F.collect_list("_v")).alias("_vs"))  # few values at most
        done.append(sorted_.select(*of, F.get("_vs", (F.col("_rank") - F.col("_s")).cast("int")).alias("_value")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return cut_lineage(out)
