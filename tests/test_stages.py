"""The stages from sources to scores, by function and by command."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from hourline import stages

T0 = dt.datetime(2020, 1, 1)


def sources(spark, folder, days=1200):
    rng = random.Random(1)
    temp = [10 + 8 * math.sin(2 * math.pi * d / 365.25) for d in range(days)]
    load = [(T0 + dt.timedelta(hours=h), 100.0 + 10 * math.sin(2 * math.pi * h / 24) - temp[h // 24] + rng.gauss(0, 1)) for h in range(24 * days) if h % 997]
    df = spark.createDataFrame(load, "timestamp timestamp_ntz, load double")
    df.unionByName(df.limit(3)).write.parquet(f"{folder}/load")
    st = [(T0 + dt.timedelta(hours=24 * d + 12), s, temp[d] + s) for d in range(days) for s in (0, 1)]
    spark.createDataFrame(st, "timestamp timestamp_ntz, station int, temp double").write.parquet(f"{folder}/stations")
    px = [((T0 + dt.timedelta(days=d)).date(), float(d % 9 + i), i % 3, i == 3) for d in range(days) for i in range(4)]
    spark.createDataFrame(px, "date date, value double, quality int, fill boolean").write.parquet(f"{folder}/pixels")
    mo = [(2020 + m // 12, m % 12 + 1, float(m)) for m in range(40)]
    spark.createDataFrame(mo, "year int, month int, price double").write.parquet(f"{folder}/monthly_market")
    spark.createDataFrame(mo[3:], "year int, month int, price double").write.parquet(f"{folder}/monthly_tax")


def test_from_sources_to_scores(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    sources(spark, source)
    assert sorted(stages.run_aggregate(spark, source, target)) == ["load", "monthly", "pixels", "stations"]
    assert stages.run_aggregate(spark, source, target) == [] and stages.run_aggregate(spark, source, target, force=True)
    assert stages.run_merge(spark, target, "2020-01-01", "2023-04-14") and not stages.run_merge(spark, target, "2020-01-01", "2023-04-14")
    df = spark.read.parquet(f"{target}/merged")
    assert df.count() == df.select("timestamp").distinct().count() == 24 * 1200
    assert {"load", "st_temp", "st_station_count", "px_mean", "px_valid_count", "mo_market_price", "mo_tax_price", "year", "hour", "is_weekend"} <= {*df.columns}
    noon = df.where(F.col("timestamp") == F.lit(T0 + dt.timedelta(days=100, hours=12)).cast("timestamp_ntz")).first()
    assert (noon.st_station_count, noon.px_mean, noon.px_valid_count, noon.mo_market_price, noon.mo_tax_price, noon.hour) == (2, 1.5, 2, 3.0, 3.0, 12)
    stages.main(["evaluate", "--target", target, "--horizons", "30"])
    rows = spark.read.csv(f"{target}/scores/results_folds.csv", header=True, inferSchema=True).collect()
    rmse = {(r.model, r.fold): r.rmse for r in rows}
    assert len(rmse) == 4 and all(rmse["linear", f] < 2.0 < rmse["naive", f] for f in (0, 1))
    assert (tmp_path / "out/merged_quality").exists() and (tmp_path / "out/scores/results_all.csv").exists()


def test_sources_may_be_absent(spark, tmp_path):
    spark.createDataFrame([(T0, 1.0)], "timestamp timestamp_ntz, load double").write.parquet(str(tmp_path / "in/load"))
    stages.main(["aggregate", "--source", str(tmp_path / "in"), "--target", str(tmp_path / "out")])
    stages.main(["merge", "--target", str(tmp_path / "out"), "--start", "2020-01-01", "--end", "2020-01-01"])
    df = spark.read.parquet(str(tmp_path / "out/merged"))
    assert df.count() == 24 and df.where("load = 1").count() == 1
    with pytest.raises(SystemExit):
        stages.main(["aggregate", "--target", "x"])
