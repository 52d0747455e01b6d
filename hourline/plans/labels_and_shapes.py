"""Queries over labels, casts, unpivots, pivots and period expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourline.functions import clean
from hourline.operators import modelling, reshape
from hourline.plans.registry import query, rounded
from hourline.schema import order_columns
from hourline.sources.readers import prefer_value

_EN, _NL = (f"[{', '.join(repr(m) for m in clean.MONTHS[k])}]" for k in ("en", "nl"))


def _labels(t, lang: str):
    """Month labels of order dates; every seventh has a mark, every eleventh no month, every thirteenth is no label."""
    names = F.array(*[F.lit(m) for m in clean.MONTHS[lang]])
    o = t("orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.get(names, F.month("o_orderdate") - 1).alias("m"))
    k = F.col("o_orderkey")
    label = F.when(k % 13 == 0, F.concat(F.lit("x"), F.col("y"))).when(k % 11 == 0, F.col("y").cast("string")).otherwise(F.concat_ws(" ", "y", F.initcap("m")))
    return o.select("o_orderkey", F.concat(label, F.when(k % 7 == 0, "*").otherwise("")).alias("label"))


def _label_sql(months: str) -> str:
    return f"""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE year(o_orderdate)::INTEGER END AS year,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'year' ELSE 'month' END AS unit,
  CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE list_position({months}, ({months})[month(o_orderdate)])::INTEGER END AS n FROM orders"""


def _parsed(df, lang="en"):
    p = clean.parse_period(F.col("label"), lang)
    return df.select("o_orderkey", p["year"].alias("year"), p["unit"].alias("unit"), p["n"].alias("n"))


@query(_label_sql(_EN))
def period_parse_en(t):
    return _parsed(_labels(t, "en"))


@query(_label_sql(_NL))
def period_parse_nl(t):
    return _parsed(_labels(t, "nl"), "nl")


def _nth(t, unit: str, months: int):
    n = F.ceil(F.month("o_orderdate") / months)
    nth = F.get(F.array(*[F.lit(x) for x in ("1st", "2nd", "3rd", "4th")]), (n - 1).cast("int"))
    return t("orders").select("o_orderkey", F.concat_ws(" ", F.year("o_orderdate"), nth, F.lit(unit)).alias("label"))


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, 'quarter' AS unit, quarter(o_orderdate)::INTEGER AS n FROM orders")
def period_parse_q(t):
    return _parsed(_nth(t, "Quarter", 3))


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, 'semester' AS unit, ceil(month(o_orderdate) / 6.0)::INTEGER AS n FROM orders")
def period_parse_s(t):
    return _parsed(_nth(t, "semester", 6))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS price FROM orders")
def decimal_comma_cast(t):
    text = F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.translate(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), ".", ","))
    return t("orders").select("o_orderkey", clean.to_double(text, decimal_comma=True).alias("price"))


@query("""WITH k AS (SELECT o_orderkey, 'A' || year(o_orderdate) || lpad(dayofyear(o_orderdate)::VARCHAR, 3, '0') AS a, strftime(o_orderdate, 'obs-%Y%m%d-') || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || '.nc' AS b, o_orderdate FROM orders)
SELECT o_orderkey, o_orderdate::DATE AS day, (o_orderdate + to_hours((o_orderkey % 24)::INTEGER))::TIMESTAMP AS ts, year(o_orderdate)::INTEGER AS year FROM k""")
def key_from_name(t):
    o = t("orders").select("o_orderkey", "o_orderdate")
    a = F.concat(F.lit("A"), F.year("o_orderdate"), F.lpad(F.dayofyear("o_orderdate").cast("string"), 3, "0"))
    b = F.concat(F.lit("obs-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(".nc"))
    n = o.select("o_orderkey", a.alias("a"), b.alias("b"), F.concat(F.lit("data_"), F.year("o_orderdate"), F.lit("_v1.csv")).alias("c"))
    part = lambda c, p, i: F.regexp_extract(c, p, i).try_cast("int")
    pattern = r"(\d{4})(\d{2})(\d{2})-(\d{2})"
    day = clean.day_of_year(part("a", r"A(\d{4})(\d{3})", 1), part("a", r"A(\d{4})(\d{3})", 2))
    ts = F.make_timestamp_ntz(*[part("b", pattern, i) for i in (1, 2, 3, 4)], F.lit(0), F.lit(0))
    return n.select("o_orderkey", day.alias("day"), ts.alias("ts"), clean.year_in_name(F.col("c")).alias("year"))


@query("""WITH w AS (SELECT user_id, ts::DATE AS day, hour(ts) AS hour, round(sum(value), 2) AS value FROM events GROUP BY 1, 2, 3)
SELECT u.user_id, u.day, h::INTEGER AS hour, w.value FROM (SELECT DISTINCT user_id, day FROM w) u CROSS JOIN range(24) AS r(h) LEFT JOIN w ON w.user_id = u.user_id AND w.day = u.day AND w.hour = h""")
def unpivot_hours(t):
    wide = t("events").withColumn("h", F.hour("ts")).groupBy("user_id", F.to_date("ts").alias("day")).pivot("h", list(range(24))).agg(F.round(F.sum("value"), 2))
    return reshape.hours_to_long(wide, ["user_id", "day"])


@query("""WITH b AS (SELECT year(l_shipdate)::INTEGER AS year, l_returnflag AS flag, round(min(l_discount), 4) AS low, round(max(l_quantity), 4) AS high FROM lineitem GROUP BY 1, 2)
SELECT year, max(CASE WHEN flag = 'A' THEN low END) AS p_low_A, max(CASE WHEN flag = 'N' THEN low END) AS p_low_N, max(CASE WHEN flag = 'R' THEN low END) AS p_low_R,
 max(CASE WHEN flag = 'A' THEN high END) AS p_high_A, max(CASE WHEN flag = 'N' THEN high END) AS p_high_N, max(CASE WHEN flag = 'R' THEN high END) AS p_high_R FROM b GROUP BY year""")
def bands_long_wide(t):
    b = t("lineitem").groupBy(F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("flag")).agg(F.min("l_discount").alias("low"), F.max("l_quantity").alias("high"))
    return reshape.bands_to_wide(rounded(b, "low", "high"), ["year"], ["low", "high"], "flag", "p", ["A", "N", "R"])


def _periods(t, n):
    cols = [F.year("o_orderdate").alias("year")] + ([n.cast("int").alias("n")] if n is not None else [])
    return t("orders").groupBy(*cols).agg(F.count("*").alias("orders"))


def _expand_sql(n: str, months: int) -> str:
    return f"WITH q AS (SELECT year(o_orderdate)::INTEGER AS year, {n}::INTEGER AS n, count(*) AS orders FROM orders GROUP BY 1, 2) SELECT year, ((n - 1) * {months} + i)::INTEGER AS month, orders FROM q, range(1, {months + 1}) AS r(i)"


@query(_expand_sql("quarter(o_orderdate)", 3))
def quarter_to_months(t):
    return reshape.expand_period(_periods(t, F.quarter("o_orderdate")), "quarter", n="n").select("year", "month", "orders")


@query(_expand_sql("ceil(month(o_orderdate) / 6.0)", 6))
def semester_to_months(t):
    return reshape.expand_period(_periods(t, F.ceil(F.month("o_orderdate") / 6)), "semester", n="n").select("year", "month", "orders")


@query("""WITH q AS (SELECT year(o_orderdate)::INTEGER AS year, quarter(o_orderdate)::INTEGER AS n, count(*) AS orders FROM orders GROUP BY 1, 2), p AS (SELECT year(o_orderdate)::INTEGER AS year, count(DISTINCT o_custkey) AS population FROM orders GROUP BY 1)
SELECT year, ((n - 1) * 3 + i)::INTEGER AS month, orders, population FROM q JOIN p USING (year), range(1, 4) AS r(i)""")
def year_to_months(t):
    people = t("orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count_distinct("o_custkey").alias("population"))
    months = reshape.expand_period(_periods(t, F.quarter("o_orderdate")), "quarter", n="n")
    return months.join(people, "year", "left").select("year", "month", "orders", "population")


@query("""WITH l AS (SELECT o_orderpriority AS topic, year(o_orderdate)::INTEGER AS year, quarter(o_orderdate)::INTEGER AS q, count(*) AS n FROM orders GROUP BY 1, 2, 3),
m AS (SELECT year, ((q - 1) * 3 + i)::INTEGER AS month, topic, n FROM l, range(1, 4) AS r(i) WHERE topic <> '3-MEDIUM')
SELECT year, month, max(CASE WHEN topic = '1-URGENT' THEN n END) AS urgent, max(CASE WHEN topic = '5-LOW' THEN n END) AS low FROM m WHERE topic IN ('1-URGENT', '5-LOW') GROUP BY 1, 2""")
def wide_periods_to_monthly(t):
    labelled = t("orders").withColumn("period", F.concat(F.year("o_orderdate"), F.lit(" q"), F.quarter("o_orderdate")))
    quarters = sorted(r["period"] for r in labelled.select("period").distinct().collect() if r["period"])  # the table's own: the header of a wide table
    wide = labelled.groupBy(F.col("o_orderpriority").alias("topic")).pivot("period", quarters).count()
    long = wide.unpivot(["topic"], quarters, "period", "n").dropna().withColumn("name", clean.mapped(F.col("topic"), {"1-URGENT": "urgent", "5-LOW": "low"})).dropna()
    long = long.withColumn("year", F.substring("period", 1, 4).cast("int")).withColumn("q", F.substring("period", 7, 1).cast("int"))
    return reshape.pivot_first(reshape.expand_period(long, "quarter", n="q"), ["year", "month"], "name", "n", ["urgent", "low"])


@query("""WITH x AS (SELECT event_id, user_id, event_type, CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END AS v, value * 2 AS scaled FROM events), h AS (SELECT user_id, count(v) > 0 AS has FROM x GROUP BY 1)
SELECT event_id, round(CASE WHEN has THEN v ELSE scaled END, 4) AS load FROM x JOIN h USING (user_id) WHERE trim(event_type) = 'click'""")
def column_preference(t):
    x = t("events").select("event_id", "user_id", "event_type", F.when(F.col("user_id") % 3 != 0, F.col("value")).alias("v"), (F.col("value") * 2).alias("scaled"))
    return rounded(prefer_value(x, ["user_id"], "v", "scaled", "load").where(clean.is_entity(F.col("event_type"), "click")).select("event_id", "load"), "load")


_MODEL = """WITH w AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, sum(value) AS load, count(*) AS n, avg(CASE WHEN event_type = 'click' THEN value END) AS val, avg(CASE WHEN event_type = 'view' THEN value END) AS raw FROM events GROUP BY 1),
x AS (SELECT ts, CASE WHEN hour(ts) % 7 <> 3 THEN load END AS load, CASE WHEN hour(ts) % 5 <> 0 THEN coalesce(val, raw) END AS weather, CASE WHEN hour(ts) = 6 THEN load / n END AS cbs_price FROM w),
f AS (SELECT ts, load, last_value(weather IGNORE NULLS) OVER o AS weather, last_value(cbs_price IGNORE NULLS) OVER o AS cbs_price FROM x WINDOW o AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)),
m AS (SELECT * FROM f WHERE load IS NOT NULL)"""


def _model(t):
    of = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    w = t("events").groupBy(clean.hour_floor(F.col("ts")).alias("ts")).agg(F.sum("value").alias("load"), F.count("*").alias("n"), of("click").alias("val"), of("view").alias("raw"))
    h = F.hour("ts")
    known = h % 5 != 0
    raw = w.select("ts", F.when(h % 7 != 3, F.col("load")).alias("load"), F.when(known, F.col("val")).alias("obs_val_temp"), F.when(known, F.col("raw")).alias("obs_temp"), F.when(h == 6, F.col("load") / F.col("n")).alias("cbs_price"), F.col("n").alias("ntl_mean"), F.col("n").alias("obs_station_count"), h.alias("hour"))
    return modelling.modelling_table(raw, "ts", "load", {"weather": ("obs_val_temp", "obs_temp")}, ["cbs_price"])


@query(_MODEL + " SELECT ts, round(load, 4) AS load, round(weather, 4) AS weather, round(cbs_price, 4) AS cbs_price, hour(ts)::INTEGER AS hour FROM m")
def clean_modelling_table(t):
    return rounded(_model(t), "load", "weather", "cbs_price")


@query(_MODEL + " SELECT 'cbs_price' AS predictor, count(cbs_price) AS n, round(avg(cbs_price), 4) AS mean FROM m UNION ALL SELECT 'weather', count(weather), round(avg(weather), 4) FROM m")
def predictor_summary(t):
    m = _model(t)
    long = m.unpivot(["ts"], modelling.predictors(m, "load", "ts"), "predictor", "v")
    return rounded(long.groupBy("predictor").agg(F.count("v").alias("n"), F.avg("v").alias("mean")), "mean")


@query("""WITH l AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y') || ' ' || quarter(o_orderdate) || 'th quarter*' ELSE strftime(o_orderdate, '%Y %B') END AS label, o_orderdate FROM orders)
SELECT o_orderkey, label, make_date(year(o_orderdate)::INTEGER, month(o_orderdate)::INTEGER, 1) AS month FROM l WHERE o_orderkey % 4 > 1""")
def monthly_rows_only(t):
    d = F.col("o_orderdate")
    label = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy")).when(F.col("o_orderkey") % 4 == 1, F.concat(F.date_format(d, "yyyy "), F.quarter(d).cast("string"), F.lit("th quarter*"))).otherwise(F.date_format(d, "yyyy MMMM"))
    rows = t("orders").select("o_orderkey", label.alias("label"), clean.first_of_month(F.year(d), F.month(d)).alias("month"))
    return rows.where(clean.granularity(F.col("label")) == "month")


@query("SELECT c_custkey, c_acctbal, c_mktsegment, c_name FROM customer")
def ordered_wide_table(t):
    return order_columns(t("customer"), ["c_custkey"], ["c_acct", "c_mkt"], ["c_name"]).orderBy("c_custkey")


@query("""WITH l AS (SELECT event_id, ts AS t FROM events) SELECT event_id, CASE WHEN t >= TIMESTAMP '2024-03-31 02:00:00' AND t < TIMESTAMP '2024-03-31 03:00:00' THEN NULL ELSE t - INTERVAL 1 HOUR END AS utc FROM l""")
def local_to_utc_dst(t):
    return t("events").select("event_id", clean.local_to_utc(F.col("ts"), "CET").alias("utc"))
