from hourline.operators import reshape
from hourline.sources import readers


def test_discover_and_header(spark, tmp_path):
    (tmp_path / "b_2020.csv").write_text("note\n\nCountry;Year;0\nNL;2020;1\nNL;2021;2\n")
    (tmp_path / "b_2020_old.csv").write_text("x\n")
    patterns = [f"{tmp_path}/a_*.csv", f"{tmp_path}/b_*.csv"]
    found = readers.discover(spark, patterns, exclude="old")
    assert len(found) == 1 and found[0].endswith("b_2020.csv")
    assert readers.discover(spark, patterns[:1]) == []
    assert readers.header_offset(spark, found[0], ("Country", "0")) == 2
    df = readers.read_below_header(spark, found[0], ("Country", "0"))
    assert sorted(tuple(r) for r in df.where("Year is not null").collect()) == [("NL", "2020", "1"), ("NL", "2021", "2")]
    assert readers.read_below_header(spark, found[0], ("Nope",)) is None


def test_long_load(spark):
    df = spark.createDataFrame([("NL ", "2020-01-01 00:00:00", None, "5"), ("BE", "2020-01-01 01:00:00", "7", "8")], "CountryCode string, DateUTC string, Value string, Value_ScaleTo100 string")
    assert [r.load for r in readers.read_long_load(df, country="NL").collect()] == [5.0]
    assert sorted(r.load is None or r.load for r in readers.read_long_load(df).collect()) == [True, 7.0]


def test_pivot_first_by_order(spark):
    df = spark.createDataFrame([(1, "a", 9, 1), (1, "a", 2, 2), (1, "a", None, 0)], "k int, n string, v int, o int")
    assert reshape.pivot_first(df, ["k"], "n", "v", ["a"], "o").collect()[0]["a"] == 9
