"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.llm.common import forget, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def _least(pairs: DataFrame) -> DataFrame:
    """u and m, the least of u and its neighbours; written, so that a join on a hub's edges can be split."""
    return written(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the smallest node reachable) of every node of edges (u, v) but the roots themselves.

    Large-star: every neighbour above u is tied to the least of u's neighbourhood. Small-star: so is every neighbour
    below u. Both keep the components, and the number of rounds grows with the logarithm of the longest path. Edges
    are kept as distinct (larger, smaller) pairs, so their number never grows. Loops and nulls are dropped.
    """
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = _state(e)
    for _ in range(rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _least(both)
        large = written(both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = _least(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        forget(e, near, large, least)
        e = new
        last, state = state, _state(e)
        if state == last:
            break
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out.scratch = e.scratch
    return out
