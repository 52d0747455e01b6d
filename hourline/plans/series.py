"""Queries over series: quality, groups, windows and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourline.functions import clean
from hourline.operators import aggregate, quality, reports, stats, windows
from hourline.plans.registry import DAILY, FULL_HOURLY, HOURLY, daily, hourly, query, rounded


@query("""WITH c AS (SELECT count(*) AS n, count(*) - count(c_custkey) AS a, count(*) - count(c_name) AS b, count(*) - count(c_nationkey) AS c, count(*) - count(CASE WHEN c_acctbal > 0 THEN 1 END) AS d FROM customer)
SELECT * FROM (SELECT 'c_custkey' AS column, 'bigint' AS dtype, a AS null_count, round(100.0 * a / n, 2) AS null_pct, n AS row_count FROM c UNION ALL SELECT 'c_name', 'string', b, round(100.0 * b / n, 2), n FROM c
UNION ALL SELECT 'c_nationkey', 'int', c, round(100.0 * c / n, 2), n FROM c UNION ALL SELECT 'positive', 'double', d, round(100.0 * d / n, 2), n FROM c) x""")
def table_profile(t):
    return quality.profile(t("customer").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("positive")))


@query("SELECT event_type, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, count(value) AS n FROM events GROUP BY 1")
def basic_stats(t):
    return rounded(quality.basic_stats(t("events"), "value", ["event_type"]), "mean", "std")


@query("SELECT 'o_custkey' AS column, round(100.0 * (count(*) - count(CASE WHEN o_custkey % 5 <> 0 THEN 1 END)) / count(*), 2) AS null_pct FROM orders")
def null_pct(t):
    return quality.profile(t("orders").select(F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("o_custkey"))).select("column", "null_pct")


@query("WITH h AS (SELECT year(o_orderdate)::INTEGER AS year, count(DISTINCT date_trunc('hour', o_orderdate)) AS hours FROM orders GROUP BY 1), e AS (SELECT *, CASE WHEN year % 4 = 0 AND year % 100 <> 0 OR year % 400 = 0 THEN 8784 ELSE 8760 END AS expected FROM h) SELECT year, hours, expected, round(100.0 * hours / expected, 2) AS pct FROM e")
def year_coverage(t):
    return quality.year_coverage(t("orders"), "o_orderdate")


@query("WITH y AS (SELECT DISTINCT year(o_orderdate)::INTEGER AS year FROM orders WHERE year(o_orderdate) % 3 <> 0) SELECT i::INTEGER AS year FROM range((SELECT min(year) FROM y), (SELECT max(year) FROM y)) AS r(i) WHERE i NOT IN (SELECT year FROM y)")
def missing_years(t):
    return quality.missing_years(t("orders").select(F.year("o_orderdate").alias("year")).where("year % 3 <> 0"), "year")


_GRID = "g AS (SELECT unnest(generate_series((SELECT min(ts) FROM h), (SELECT max(ts) FROM h), INTERVAL 1 HOUR)) AS ts)"


@query(f"WITH {HOURLY}, {_GRID}, j AS (SELECT g.ts, load, CASE WHEN hour(g.ts) < 12 THEN load END AS morning FROM g LEFT JOIN h USING (ts)) SELECT * FROM (SELECT 'load' AS column, count(load) AS present, round(100.0 * count(load) / count(*), 2) AS pct, CASE WHEN 100.0 * count(load) / count(*) < 85 THEN 'warning' ELSE 'ok' END AS status FROM j UNION ALL SELECT 'morning', count(morning), round(100.0 * count(morning) / count(*), 2), CASE WHEN 100.0 * count(morning) / count(*) < 85 THEN 'warning' ELSE 'ok' END FROM j) x")
def source_coverage(t):
    df = windows.regularise(hourly(t("events")), "ts", "hour").withColumn("morning", F.when(F.hour("ts") < 12, F.col("load")))
    return quality.source_coverage(df, ["load", "morning"])


@query(f"WITH {HOURLY}, {_GRID}, m AS (SELECT ts FROM g WHERE ts NOT IN (SELECT ts FROM h)), r AS (SELECT ts, ts - row_number() OVER (ORDER BY ts) * INTERVAL 1 HOUR AS k FROM m) SELECT min(ts) AS gap_start, max(ts) AS gap_end, count(*) AS length FROM r GROUP BY k")
def gap_ranges_hourly(t):
    return windows.gap_ranges(hourly(t("events")), "ts", "hour")


@query(f"WITH {DAILY}, g AS (SELECT unnest(generate_series((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day), m AS (SELECT day FROM g WHERE day NOT IN (SELECT day FROM d)), r AS (SELECT day, (day - row_number() OVER (ORDER BY day)::INTEGER) AS k FROM m) SELECT min(day) AS gap_start, max(day) AS gap_end, count(*) AS length FROM r GROUP BY k")
def gap_ranges_daily(t):
    return windows.gap_ranges(daily(t("orders")), "day", "day")


@query(f"WITH {HOURLY}, {_GRID}, m AS (SELECT ts FROM g WHERE ts NOT IN (SELECT ts FROM h)), r AS (SELECT ts, ts - row_number() OVER (ORDER BY ts) * INTERVAL 1 HOUR AS k FROM m), x AS (SELECT min(ts) AS gap_start, max(ts) AS gap_end, count(*) AS length FROM r GROUP BY k) SELECT gap_start, gap_end, length, count(*) OVER () AS ranges, (sum(length) OVER ())::BIGINT AS missing, row_number() OVER (ORDER BY gap_start)::INTEGER AS n FROM x QUALIFY n <= 5")
def gap_report(t):
    return quality.gap_report(hourly(t("events")), "ts", "hour", 5)


@query(f"WITH {HOURLY} SELECT year(ts)::INTEGER AS year, count(*) AS hours, round(min(load), 4) AS low, round(max(load), 4) AS high, round(avg(load), 4) AS mean, round(stddev_samp(load), 4) AS std, CASE WHEN year(ts) % 4 = 0 AND (year(ts) % 100 <> 0 OR year(ts) % 400 = 0) THEN 8784 ELSE 8760 END::BIGINT AS expected, round(100.0 * count(*) / CASE WHEN year(ts) % 4 = 0 AND (year(ts) % 100 <> 0 OR year(ts) % 400 = 0) THEN 8784 ELSE 8760 END, 2) AS pct FROM h GROUP BY year(ts)")
def load_report(t):
    return rounded(reports.load_report(hourly(t("events")), "ts", "load"), "low", "high", "mean", "std")


@query("WITH e AS (SELECT event_type AS variable, date_trunc('hour', ts) AS h, CASE WHEN value > 5 THEN value END AS v FROM events) SELECT variable, round(100.0 * count(CASE WHEN v IS NULL THEN 1 END) / count(*), 2) AS null_pct, count(DISTINCT h) AS hours, round(min(v), 4) AS low, round(max(v), 4) AS high, round(avg(v), 4) AS mean, date_diff('hour', min(h), max(h)) + 1 AS expected, round(100.0 * count(DISTINCT h) / (date_diff('hour', min(h), max(h)) + 1), 2) AS pct FROM e GROUP BY 1")
def weather_report(t):
    e = t("events").withColumn("v", F.when(F.col("value") > 5, F.col("value")))
    return rounded(reports.variable_report(e, "ts", "event_type", "v"), "low", "high", "mean")


@query("WITH m AS (SELECT year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m FROM orders WHERE year(o_orderdate) % 3 <> 1) SELECT min(y) AS first_year, max(y) AS last_year, count(DISTINCT y * 12 + m) AS months, coalesce((SELECT string_agg(x::VARCHAR, ',' ORDER BY x) FROM (SELECT unnest(range((SELECT min(y) FROM m), (SELECT max(y) FROM m) + 1)) AS x) r WHERE x NOT IN (SELECT y FROM m)), '') AS missing FROM m")
def monthly_report(t):
    m = t("orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).where("y % 3 <> 1")
    return reports.monthly_report(m, "y", "m")


@query(f"WITH {HOURLY}, {_GRID}, j AS (SELECT load, CASE WHEN hour(g.ts) < 12 THEN load END AS morning FROM g LEFT JOIN h USING (ts)), u AS (SELECT 'load' AS col, load AS v FROM j UNION ALL SELECT 'morning', morning FROM j) SELECT col AS column, count(*) AS rows, count(v) AS present, round(100.0 * count(v) / count(*), 2) AS pct, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, CASE WHEN 100.0 * count(v) / count(*) < 85 THEN 'warning' ELSE 'ok' END AS status FROM u GROUP BY 1")
def coverage_report(t):
    df = windows.regularise(hourly(t("events")), "ts", "hour").withColumn("morning", F.when(F.hour("ts") < 12, F.col("load")))
    return rounded(reports.coverage_report(df, ["load", "morning"]), "mean", "std")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= (SELECT count(*) / 5 FROM events) AND count(*) >= 100")
def row_count_guard(t):
    least = F.lit(5)
    e = reports.enough(t("events"), ["event_type"], 100).groupBy("event_type").agg(F.count("*").alias("n"))
    return e.crossJoin(t("events").agg(F.count("*").alias("all"))).where(F.col("n") >= F.col("all") / least).select("event_type", "n")


@query(f"WITH {FULL_HOURLY} SELECT ts, round(load, 4) AS load FROM h ORDER BY ts DESC LIMIT 48")
def last_rows(t):
    return rounded(windows.last_rows(hourly(t("events"), gaps=False), "ts", 48), "load")


@query()
def quality_report_json(t):
    return quality.document(quality.profile(t("customer")), "customer")


@query(f"WITH {DAILY} SELECT year(day)::INTEGER AS year, round(avg(total), 4) AS mean, round(stddev_samp(total), 4) AS std FROM d GROUP BY 1")
def annual_mean_std(t):
    return rounded(daily(t("orders")).groupBy(F.year("day").alias("year")).agg(F.avg("total").alias("mean"), F.stddev_samp("total").alias("std")), "mean", "std")


def _subseries(unit: str, key: str) -> str:
    return f"WITH {FULL_HOURLY} SELECT {key}::INTEGER AS {unit}, round(median(load) + 1e-9, 4) AS median, round(avg(load) + 1e-9, 4) AS mean, round(stddev_samp(load) + 1e-9, 4) AS std FROM h GROUP BY 1"


def _sub(t, unit, key):
    return rounded(hourly(t("events"), gaps=False).groupBy(key.alias(unit)).agg(F.median("load").alias("median"), F.avg("load").alias("mean"), F.stddev_samp("load").alias("std")), "median", "mean", "std", nudge=1e-9)


@query(_subseries("hour", "hour(ts)"))
def subseries_hour(t):
    return _sub(t, "hour", F.hour("ts"))


@query(_subseries("dow", "dayofweek(ts) + 1"))
def subseries_dow(t):
    return _sub(t, "dow", F.dayofweek("ts"))


@query(f"WITH {DAILY} SELECT month(day)::INTEGER AS month, round(median(total), 4) AS median, round(stddev_samp(total), 4) AS std FROM d GROUP BY 1")
def subseries_month(t):
    return rounded(daily(t("orders")).groupBy(F.month("day").alias("month")).agg(F.median("total").alias("median"), F.stddev_samp("total").alias("std")), "median", "std")


@query(f"WITH {FULL_HOURLY} SELECT hour(ts)::INTEGER AS hour, {', '.join(f'round(median(CASE WHEN dayofweek(ts) + 1 = {d} THEN load END), 4) AS {chr(34)}{d}{chr(34)}' for d in range(1, 8))} FROM h GROUP BY 1")
def heatmap_dow_hour(t):
    h = hourly(t("events"), gaps=False).withColumn("hour", F.hour("ts")).withColumn("dow", F.dayofweek("ts"))
    return aggregate.heatmap(h, "hour", "dow", list(range(1, 8)), F.round(F.median("load"), 4))


@query(f"WITH {DAILY} SELECT year(day)::INTEGER AS year, {', '.join(f'round(avg(CASE WHEN month(day) = {m} THEN total END), 4) AS {chr(34)}{m}{chr(34)}' for m in range(1, 13))} FROM d GROUP BY 1")
def heatmap_year_month(t):
    d = daily(t("orders")).withColumn("year", F.year("day")).withColumn("month", F.month("day"))
    return aggregate.heatmap(d, "year", "month", list(range(1, 13)), F.round(F.avg("total"), 4))


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(value) AS whisker_low, max(value) AS whisker_high FROM events JOIN q USING (event_type) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1, 2, 3, 4""")
def box_summary(t):
    return rounded(aggregate.box_summary(t("events"), ["event_type"], "value"), "q1", "median", "q3")


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_HOLED = "x AS (SELECT CASE WHEN l_linenumber <> 3 THEN l_quantity END AS l_quantity, l_extendedprice, CASE WHEN l_linenumber <> 5 THEN l_discount END AS l_discount, l_tax FROM lineitem)"


def _holed(t):
    return t("lineitem").select(F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice", F.when(F.col("l_linenumber") != 5, F.col("l_discount")).alias("l_discount"), "l_tax")


@query(f"WITH {_HOLED} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n FROM x" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]))
def corr_matrix(t):
    return rounded(stats.corr_matrix(_holed(t), _COLS, 36), "r", digits=6)


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem")
def corr_pairs(t):
    return rounded(stats.corr_matrix(t("lineitem"), _COLS[:2]), "r", digits=6)


#: The Gram matrix beside the unit matrix, eliminated a column a step, leaves its inverse.
_VIF = f"""WITH RECURSIVE x AS (SELECT [{', '.join(f'{c}::DOUBLE' for c in _COLS)}] AS v FROM lineitem),
g AS (SELECT i, j, CASE WHEN j <= {len(_COLS)} THEN sum(v[i] * v[least(j, {len(_COLS)})]) WHEN j = i + {len(_COLS)} THEN 1.0 ELSE 0.0 END AS v FROM x, range(1, {len(_COLS) + 1}) AS a(i), range(1, {2 * len(_COLS) + 1}) AS b(j) GROUP BY i, j),
r AS (SELECT i, list(v ORDER BY j) AS r FROM g GROUP BY i), e AS (SELECT 1 AS p, list(r ORDER BY i) AS m FROM r UNION ALL
  SELECT p + 1, list_transform(m, lambda r, i: CASE WHEN i = p THEN list_transform(r, lambda z: z / m[p][p]) ELSE list_transform(r, lambda z, q: z - r[p] / m[p][p] * m[p][q]) END) FROM e WHERE p <= {len(_COLS)}),
n AS (SELECT {_COLS}[i] AS name, (SELECT m FROM e WHERE p = {len(_COLS) + 1})[i][{len(_COLS)} + i] * g.v AS vif FROM g WHERE i = j)"""


@query(f"{_VIF} SELECT name, round(vif, 5) AS vif FROM n")
def vif(t):
    return rounded(stats.vif(t("lineitem"), _COLS), "vif", digits=5)


@query(f"{_VIF} SELECT name, round(vif, 5) AS vif, CASE WHEN vif > 10 THEN 'high' WHEN vif > 5 THEN 'moderate' ELSE 'low' END AS severity FROM n ORDER BY vif DESC")
def vif_ranked(t):
    return rounded(stats.vif(t("lineitem"), _COLS).withColumn("severity", clean.severity(F.col("vif"), 10, 5)), "vif", digits=5).orderBy(F.desc("vif"))


@query("""WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT least(greatest(ceil((l_extendedprice - lo) / ((hi - lo) / 30)), 1), 30)::INTEGER AS bin, l_quantity AS y, lo, hi FROM lineitem, s)
SELECT bin, round(avg(y), 4) AS mean, count(*) AS n, round(min((lo + (bin - 1) * (hi - lo) / 30 - CASE WHEN bin = 1 THEN 0.001 * (hi - lo) ELSE 0 END + lo + bin * (hi - lo) / 30) / 2), 4) AS centre FROM b GROUP BY bin""")
def binned_mean(t):
    return rounded(aggregate.binned_mean(t("lineitem"), "l_extendedprice", "l_quantity"), "mean", "centre")


_TWO = f"{DAILY}, s AS (SELECT l_shipdate::DATE AS day, round(sum(l_extendedprice), 2) AS shipped FROM lineitem GROUP BY 1), j AS (SELECT total, shipped FROM d JOIN s USING (day))"


@query(f"WITH {_TWO} SELECT round(avg(total / nullif(shipped, 0)), 4) AS ratio_mean, round(median(total / nullif(shipped, 0)), 4) AS ratio_median, round(stddev_samp(total / nullif(shipped, 0)), 4) AS ratio_std, round(max(abs(total - shipped)), 4) AS max_abs_diff, round(avg(total - shipped), 4) AS diff_mean FROM j")
def ratio_diff_stats(t):
    s = t("lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_extendedprice"), 2).alias("shipped"))
    out = aggregate.ratio_stats(daily(t("orders")).join(s, "day"), "total", "shipped")
    return rounded(out, *out.columns)


def _acf_sql(n: int, tail: str) -> str:
    return f"WITH {HOURLY}, x AS (SELECT row_number() OVER (ORDER BY ts) AS n, (load - avg(load) OVER ()) / stddev_pop(load) OVER () AS z, count(*) OVER () AS c FROM h), r AS (SELECT k::INTEGER AS lag, round(sum(a.z * b.z) / max(a.c), 6) AS acf FROM range(0, {n + 1}) AS g(k), x b JOIN x a ON a.n = b.n + k GROUP BY k) {tail}"


@query(_acf_sql(48, "SELECT lag, acf FROM r"))
def acf(t):
    return rounded(stats.acf(hourly(t("events")), "load", "ts", 48), "acf", digits=6)


@query(_acf_sql(48, "SELECT lag, acf FROM r WHERE lag > 0 ORDER BY abs(acf) DESC, lag LIMIT 10"))
def acf_top10(t):
    a = rounded(stats.acf(hourly(t("events")), "load", "ts", 48), "acf", digits=6)
    return a.where("lag > 0").orderBy(F.desc(F.abs("acf")), "lag").limit(10)


#: The recursion that gives the coefficients of order k from those of order k - 1.
_PACF = """WITH RECURSIVE h AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, sum(value) AS load FROM events GROUP BY 1, 2),
x AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n, (load - avg(load) OVER w) / stddev_pop(load) OVER w AS z, count(*) OVER w AS c FROM h WINDOW w AS (PARTITION BY event_type)),
l AS (SELECT b.event_type, k::INTEGER AS lag, sum(a.z * b.z) / max(a.c) AS r FROM range(1, 25) AS g(k), x b JOIN x a ON a.event_type = b.event_type AND a.n = b.n + k WHERE b.c >= 30 GROUP BY 1, 2),
s AS (SELECT event_type, list(r ORDER BY lag) AS r FROM l GROUP BY 1),
p AS (SELECT event_type, r, 1 AS lag, [r[1]] AS phi FROM s UNION ALL
  SELECT event_type, r, lag + 1, list_append(list_transform(phi, lambda f, i: f - (r[lag + 1] - list_dot_product(phi, list_reverse(r[1:lag]))) / (1 - list_dot_product(phi, r[1:lag])) * phi[lag + 1 - i]), (r[lag + 1] - list_dot_product(phi, list_reverse(r[1:lag]))) / (1 - list_dot_product(phi, r[1:lag]))) FROM p WHERE lag < 24)
SELECT event_type, lag, round(phi[lag], 6) AS pacf FROM p UNION ALL SELECT event_type, 0, 1.0 FROM s"""


@query(_PACF)
def pacf(t):
    h = t("events").groupBy("event_type", clean.hour_floor(F.col("ts")).alias("ts")).agg(F.sum("value").alias("load"))
    return rounded(stats.pacf(stats.acf(h, "load", "ts", 24, ["event_type"]), ["event_type"]), "pacf", digits=6)


_PAIR = "w AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, round(sum(value), 2) AS load, round(avg(CASE WHEN event_type = 'view' THEN value END), 4) AS seen FROM events GROUP BY 1), v AS (SELECT * FROM w WHERE seen IS NOT NULL), x AS (SELECT row_number() OVER (ORDER BY ts) AS n, (load - avg(load) OVER ()) / stddev_pop(load) OVER () AS zx, (seen - avg(seen) OVER ()) / stddev_pop(seen) OVER () AS zy, count(*) OVER () AS c FROM v), r AS (SELECT k::INTEGER AS lag, round(sum(a.zx * b.zy) / max(a.c), 6) AS ccf FROM range(-24, 25) AS g(k), x b JOIN x a ON a.n = b.n + k GROUP BY k)"


def _ccf(t):
    w = t("events").groupBy(clean.hour_floor(F.col("ts")).alias("ts")).agg(F.round(F.sum("value"), 2).alias("load"), F.round(F.avg(F.when(F.col("event_type") == "view", F.col("value"))), 4).alias("seen"))
    return rounded(stats.ccf(w, "load", "seen", "ts", 24), "ccf", digits=6)


@query(f"WITH {_PAIR} SELECT lag, ccf FROM r")
def ccf(t):
    return _ccf(t)


@query(f"WITH {_PAIR} SELECT (SELECT lag FROM r ORDER BY abs(ccf) DESC, lag LIMIT 1) AS peak_lag, (SELECT ccf FROM r ORDER BY abs(ccf) DESC, lag LIMIT 1) AS peak, (SELECT ccf FROM r WHERE lag = 0) AS at_zero, (SELECT round(1.96 / sqrt(max(c)), 6) FROM x) AS band")
def ccf_peak(t):
    n = t("events").where("event_type = 'view'").agg(F.count_distinct(F.date_trunc("hour", "ts")).alias("n"))
    order = F.struct(F.abs("ccf"), -F.col("lag"))
    peak = _ccf(t).agg(F.max_by("lag", order).alias("peak_lag"), F.max_by("ccf", order).alias("peak"), F.max(F.when(F.col("lag") == 0, F.col("ccf"))).alias("at_zero"))
    return peak.crossJoin(n).select("peak_lag", "peak", "at_zero", F.round(1.96 / F.sqrt("n"), 6).alias("band"))


_DEC = f"""WITH {FULL_HOURLY}, t AS (SELECT ts, load, (row_number() OVER o - 1) % 24 AS ph, CASE WHEN count(load) OVER (ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) = 25 THEN (sum(load) OVER (ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) + sum(load) OVER (ORDER BY ts ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING)) / 48 END AS trend FROM h WINDOW o AS (ORDER BY ts)),
p AS (SELECT ph, avg(load - trend) AS s FROM t GROUP BY ph), q AS (SELECT ph, s - avg(s) OVER () AS seasonal FROM p), r AS (SELECT ts, load, trend, seasonal, load - trend - seasonal AS resid FROM t JOIN q USING (ph))"""


@query(f"{_DEC} SELECT ts, load, round(trend + 1e-8, 4) AS trend, round(seasonal + 1e-8, 4) AS seasonal, round(resid + 1e-8, 4) AS resid FROM r")
def decompose(t):
    return rounded(windows.decompose(hourly(t("events"), gaps=False), "load", "ts", 24), "trend", "seasonal", "resid", nudge=1e-8)


@query(f"{_DEC} SELECT round(100 * var_pop(trend) / var_pop(load), 4) AS trend_pct, round(100 * var_pop(seasonal) / var_pop(load), 4) AS seasonal_pct, round(100 * var_pop(resid) / var_pop(load), 4) AS resid_pct FROM r")
def variance_explained(t):
    d = windows.decompose(hourly(t("events"), gaps=False), "load", "ts", 24)
    return d.agg(*[F.round(100 * F.var_pop(c) / F.var_pop("load"), 4).alias(f"{c}_pct") for c in ("trend", "seasonal", "resid")])


@query("""WITH x AS (SELECT event_id, user_id, ts, value, date_trunc('hour', ts)::TIMESTAMP AS hour FROM events)
SELECT user_id, hour, event_id, value FROM x QUALIFY row_number() OVER (PARTITION BY user_id, hour ORDER BY ts DESC, event_id DESC) = 1""")
def dedupe_keep_last(t):
    e = t("events").select("user_id", clean.hour_floor(F.col("ts")).alias("hour"), "event_id", "value", "ts")
    return windows.dedupe_last(e, ["user_id", "hour"], ["ts", "event_id"]).drop("ts")


_REG = f"WITH {HOURLY}, {_GRID}, j AS (SELECT ts, load FROM g LEFT JOIN h USING (ts))"


@query(f"{_REG} SELECT ts, load FROM j")
def regularise(t):
    return windows.regularise(hourly(t("events")), "ts", "hour")


@query(f"{_REG} SELECT ts, last_value(load IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS load FROM j")
def ffill(t):
    return windows.ffill(windows.regularise(hourly(t("events")), "ts", "hour"), ["load"], "ts")


@query(f"""{_REG}, k AS (SELECT ts, CASE WHEN hour(ts) NOT BETWEEN 2 AND 12 THEN load END AS load, row_number() OVER (ORDER BY ts) AS n FROM j),
b AS (SELECT *, last_value(CASE WHEN load IS NOT NULL THEN n END IGNORE NULLS) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pa, first_value(CASE WHEN load IS NOT NULL THEN n END IGNORE NULLS) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb FROM k),
e AS (SELECT b.*, x.load AS va, y.load AS vb FROM b LEFT JOIN k x ON x.n = b.pa LEFT JOIN k y ON y.n = b.pb)
SELECT ts, round(CASE WHEN load IS NOT NULL THEN load WHEN n - pa <= 7 THEN coalesce(va + (vb - va) * (n - pa) / nullif(pb - pa, 0), va) END, 4) AS load FROM e""")
def interpolate_limit(t):
    r = windows.regularise(hourly(t("events")), "ts", "hour").withColumn("load", F.when(~F.hour("ts").between(2, 12), F.col("load")))
    return rounded(windows.interpolate(r, "load", "ts", 7), "load")


@query(f"{_REG} SELECT ts, CASE WHEN count(load) OVER w = 24 THEN round(avg(load) OVER w + 1e-9, 4) END AS mean FROM j WINDOW w AS (ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)")
def rolling_full(t):
    r = windows.rolling_centered(windows.regularise(hourly(t("events")), "ts", "hour"), "load", "ts", 24, "mean")
    return rounded(r.select("ts", "mean"), "mean", nudge=1e-9)


@query(f"WITH {DAILY} SELECT day, CASE WHEN count(total) OVER w >= 7 THEN round(avg(total) OVER w + 1e-9, 4) END AS mean FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)")
def rolling_minperiods(t):
    return rounded(windows.rolling_centered(daily(t("orders")), "total", "day", 30, "mean", 7).select("day", "mean"), "mean", nudge=1e-9)


@query(f"WITH {DAILY} SELECT day, total, lag(total, 7) OVER (ORDER BY day) AS lag_7 FROM d")
def lag_rows(t):
    return windows.lag_rows(daily(t("orders")), "total", "day", 7, "lag_7")


@query(f"WITH {DAILY} SELECT d.day, d.total, p.total AS lag_7 FROM d LEFT JOIN d p ON p.day = d.day - 7")
def lag_time(t):
    return windows.lag_time(daily(t("orders")), "total", "day", "7 days", "lag_7").withColumn("day", F.col("day").cast("date"))


@query()
def sample_hash(t):
    return stats.sample_n(t("orders"), "o_orderkey", 500)


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE > (SELECT max(o_orderdate::DATE) - INTERVAL 5 YEAR FROM orders)")
def recent_window(t):
    return windows.recent(t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "day", 60)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def top_rows(t):
    return t("customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25)
