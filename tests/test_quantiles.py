"""Selected quantiles equal Spark's percentile, whatever the group."""

import random

import pytest
from pyspark.sql import functions as F

from hourline.operators.quantiles import quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]


def table(spark):
    rng = random.Random(1)
    kinds = {
        "even": lambda i: float(i),
        "normal": lambda i: rng.gauss(0, 1),
        "tied": lambda i: rng.choice([1.0, 1.0, 1.0, 2.0, 5.0]),
        "one": lambda i: 3.0,
        "wide": lambda i: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300),
        "ends": lambda i: rng.choice([float("-inf"), float("inf"), 0.0, -0.5, 1e308, -1e308]),
        "nan": lambda i: rng.choice([float("nan"), 1.0, 2.0]),
        "null": lambda i: None,
        None: lambda i: rng.expovariate(1),
    }
    rows = [(k, f(i), None if i % 3 else i % 11) for k, f in kinds.items() for i in range(3000)] + [("small", float(i), i) for i in range(7)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, x double, y int").repartition(6)


@pytest.mark.parametrize("most, few", [(10**6, 10), (100, 50), (100, 1), (100, 10**6)])
def test_equals_percentile(spark, most, few):
    df = table(spark)
    want = df.groupBy("k").agg(*[F.percentile(c, F.array(*map(F.lit, PROBS))).alias(c) for c in ("x", "y")])
    plain = lambda d: {r.k: tuple(None if v is None else [repr(z) for z in v] for v in (r.x, r.y)) for r in d.collect()}
    assert plain(quantiles(df, ["k"], ["x", "y"], PROBS, most, few)) == plain(want)


def test_without_keys_or_rows(spark):
    df = spark.range(5000).select(F.col("id").cast("double").alias("x"))
    assert quantiles(df, [], ["x"], [0.5], 100, 10).first()["x"] == [2499.5]
    assert quantiles(df.where("false").withColumn("k", F.lit(1)), ["k"], ["x"], [0.5]).count() == 0
