"""Files that break, come late or need a look at their places; reports of files; rasters with axes."""

import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hourline.operators import reports, reshape, stats
from hourline.plans import labels_and_shapes, registry
from hourline.sources import readers, sinks
from hourline.streaming import ingest


def one_file(df, path):
    """df as a single Parquet file."""
    df.coalesce(1).write.parquet(f"{path}.dir")
    (part,) = Path(f"{path}.dir").glob("part-*")
    os.rename(part, path)
    return str(path)


def test_tolerant_union(spark, tmp_path):
    a = one_file(spark.range(1000).withColumn("x", F.col("id") * 2), tmp_path / "a.parquet")
    b = one_file(spark.range(5).withColumn("y", F.lit("b")), tmp_path / "b.parquet")
    cut, torn = tmp_path / "cut.parquet", tmp_path / "torn.parquet"
    whole = Path(a).read_bytes()
    cut.write_bytes(whole[: len(whole) // 2])  # no footer
    torn.write_bytes(whole[:4] + bytes(len(whole) // 2) + whole[4 + len(whole) // 2 :])  # a footer, but no pages
    paths = [a, b, str(cut), str(torn), str(tmp_path / "none.parquet")]
    df, bad = readers.read_many(spark, paths)
    assert {Path(p).name for p, _ in bad} == {"cut.parquet", "torn.parquet", "none.parquet"} and all(r for _, r in bad)
    assert {(r.file, r.n) for r in df.groupBy("file").agg(F.count("*").alias("n")).collect()} == {("a.parquet", 1000), ("b.parquet", 5)}
    assert set(df.columns) == {"id", "x", "y", "file"}
    assert readers.read_many(spark, [str(cut)])[0] is None


def test_tolerant_union_of_csv(spark, tmp_path):
    for name, text in (("a.csv", "k,v\n1,2\n3,4\n"), ("a.csv.csv", "k,v\n5,6\n"), ("bad.csv", "k,v\n7,8\n9,x\n")):
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / n) for n in ("a.csv", "a.csv.csv", "bad.csv")]
    df, bad = readers.read_many(spark, paths, schema="k int, v int", header=True)
    assert [Path(p).name for p, _ in bad] == ["bad.csv"]
    assert sorted((r.k, r.v) for r in df.collect()) == [(1, 2), (3, 4), (5, 6)]


def test_late_files_add_to_their_day(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    day = lambda d, v: spark.createDataFrame([(dt.date(2024, 1, d), v)], "day date, v int").coalesce(1)
    day(1, 1).unionByName(day(2, 2)).coalesce(1).write.parquet(f"{src}/a")
    ingest.ingest_new(spark, f"{src}/*", out, ck, "day date, v int", "day")
    day(1, 3).write.parquet(f"{src}/b")
    for _ in range(2):
        ingest.ingest_new(spark, f"{src}/*", out, ck, "day date, v int", "day")
        assert sorted((r.day.day, r.v) for r in spark.read.parquet(out).collect()) == [(1, 1), (1, 3), (2, 2)]
    # a run that lost its checkpoint reads all files again and doubles none
    ingest.ingest_new(spark, f"{src}/*", out, f"{ck}2", "day date, v int", "day")
    assert spark.read.parquet(out).count() == 3


def test_hourly_means_of_a_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=20 * i), float(i)) for i in range(9)] + [(t + dt.timedelta(hours=30), 1.0)]
    spark.createDataFrame(rows, "ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "in"))
    ingest.hourly_means(stream, "ts", "v").writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.n, r["mean"]) for r in spark.table("means").collect()) == [(1, 1.0), (3, 1.0), (3, 4.0), (3, 7.0)]


def test_reports_of_several_files(spark, tmp_path):
    for i, n in enumerate((3, 5, 4)):
        rows = spark.range(n).select((F.col("id") + 10 * i).alias("x"), F.when(F.col("id") > 0, 1.0).alias("v"), F.expr(f"timestamp_ntz'2024-01-0{i + 1} 00:00:00'").alias("ts"))
        one_file(rows, tmp_path / f"{i}.parquet")
    df = spark.read.parquet(*[str(tmp_path / f"{i}.parquet") for i in range(3)])
    assert reports.ingest_report(df, ["x"], "v").first().asDict() == {"files": 3, "rows": 12, "least_rows": 3, "most_rows": 5, "x_min": 0, "x_max": 23, "null_pct": 25.0}
    p = reports.table_profile(df, ("timestamp", "ts")).first()
    assert (p.row_count, p.column_count, p.files, p.first_time.day, p.last_time.day) == (12, 3, 3, 1, 3)
    assert p.bytes == sum(os.path.getsize(tmp_path / f"{i}.parquet") for i in range(3))


def test_header_by_place(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('Note\nk;v\n1;a\nNote;b\nk;v\n\n2;"c;d"\n')
    rows = [tuple(r) for r in readers.read_below_header(spark, str(p), ("k", "v")).collect()]
    assert rows == [("1", "a"), ("Note", "b"), ("k", "v"), ("2", "c;d")]


def test_a_query_has_one_name():
    name = next(iter(registry.QUERIES))
    f = lambda t: t("x")
    f.__name__ = name
    with pytest.raises(ValueError):
        registry.query()(f)


def test_wide_periods_of_any_year(spark, tmp_path):
    rows = [("1-URGENT", dt.date(1971, 2, 1)), ("5-LOW", dt.date(2031, 12, 31)), ("1-URGENT", None)]
    spark.createDataFrame(rows, "o_orderpriority string, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    got = labels_and_shapes.wide_periods_to_monthly(lambda n: spark.read.parquet(f"{tmp_path}/{n}.parquet"))
    assert sorted((r.year, r.month, r.urgent, r.low) for r in got.collect()) == [*[(1971, m, 1, None) for m in (1, 2, 3)], *[(2031, m, None, 1) for m in (10, 11, 12)]]


def test_small_outputs(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "Jaar int, Bevolking string")
    assert readers.two_columns(df).columns == ["year", "population"]
    assert readers.two_columns(df.toDF("p", "q")).first().year == 2
    assert [r.Jaar for r in stats.top_k(df, F.desc("Jaar"), 2).collect()] == [3, 2]
    sinks.write_single(df.repartition(3), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("part-*"))) == 1


RASTER = "g string, band array<array<float>>, q array<array<int>>, lat array<double>, lon array<double>"


def test_raster_crop(spark):
    band = [[10.0 * i + j for j in range(5)] for i in range(4)]
    q = [[i * j for j in range(5)] for i in range(4)]
    falling, rising = [54.0, 53.0, 52.0, 51.0], [3.0, 4.0, 5.0, 6.0, 7.0]
    rows = [("a", band, q, falling, rising), ("b", band, None, falling[::-1], rising[::-1]), ("c", None, q, falling, rising), ("d", band, q, [9.0] * 4, rising), ("e", [], [], [], []), ("f", [band[0], None, band[2][:2]], q, [53.0, 52.5, 52.0], rising)]
    df = spark.createDataFrame(rows, RASTER)
    got = {(r.g, r.row_idx, r.col_idx): (r.lat, r.lon, r.value, r.quality) for r in reshape.crop_raster(df, "band", "lat", "lon", (3.5, 51.5, 6.0, 53.0), "q", ["g"]).collect()}
    want = {("a", i, j): (falling[i], rising[j], band[i][j], q[i][j]) for i in (1, 2) for j in (1, 2, 3)}
    want |= {("b", i, j): (falling[3 - i], rising[4 - j], band[i][j], None) for i in (1, 2) for j in (1, 2, 3)}
    own = {k: v for k, v in got.items() if k[0] in "ab"}
    assert own == want and not any(k[0] in "cde" for k in got)
    assert got["f", 0, 1] == (53.0, 4.0, 1.0, 0) and got["f", 2, 2][2] is None and got["f", 1, 1][2] is None
    plain = reshape.explode_raster(df.where("g = 'a'"), "band", "q").where("row_idx in (1, 2) and col_idx in (1, 2, 3)")
    assert {(r.value, r.quality) for r in plain.collect()} == {v[2:] for k, v in got.items() if k[0] == "a"}
