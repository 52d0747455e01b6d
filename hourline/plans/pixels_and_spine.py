"""Queries over pixels, the spine, and its joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourline.functions import clean
from hourline import stages
from hourline.operators import aggregate, align, quality, reports, reshape, spatial
from hourline.plans.registry import DAILY, FULL_HOURLY, HOURLY, PIXELS, daily, hourly, pixels, query, rounded
from hourline.schema import with_missing_columns

TOTAL = 120
_AGG = """count(CASE WHEN NOT fill AND quality <= 1 THEN 1 END)::INTEGER AS valid_count, count(CASE WHEN fill THEN 1 END)::INTEGER AS fill_count,
  count(CASE WHEN NOT fill AND quality > 1 THEN 1 END)::INTEGER AS invalid_count, year(day)::INTEGER AS year FROM p GROUP BY day"""
_SELECTIVE = f"WITH {PIXELS}, a AS (SELECT day, avg(CASE WHEN NOT fill AND quality <= 1 THEN value END) AS mean, sum(CASE WHEN NOT fill AND quality <= 1 THEN value END) AS sum, {_AGG})"


@query(f"{_SELECTIVE} SELECT day, round(CASE WHEN valid_count >= 12 THEN mean END, 4) AS mean, round(CASE WHEN valid_count >= 12 THEN sum END, 4) AS sum, valid_count, fill_count, invalid_count, year FROM a")
def daily_quality_agg(t):
    return rounded(aggregate.daily_quality_agg(pixels(t("lineitem")), "day", "value", "quality", "fill", TOTAL), "mean", "sum")


@query(f"WITH {PIXELS} SELECT day, round(avg(CASE WHEN NOT fill THEN value END) + 1e-9, 4) AS mean, round(sum(CASE WHEN NOT fill THEN value END), 4) AS sum, {_AGG}")
def daily_quality_agg_all(t):
    return rounded(aggregate.daily_quality_agg(pixels(t("lineitem")), "day", "value", "quality", "fill", selective=False), "mean", nudge=1e-9).withColumn("sum", F.round("sum", 4))


@query(f"{_SELECTIVE}, n AS (SELECT *, valid_count + fill_count + invalid_count AS total FROM a) SELECT min(total) AS total_min, max(total) AS total_max, round(avg(total), 4) AS total_mean, round(avg(valid_count / nullif(total, 0)), 4) AS valid_mean, round(min(valid_count / nullif(total, 0)), 4) AS valid_min, round(avg(invalid_count / nullif(valid_count + invalid_count, 0)), 4) AS imputed_mean, round(max(invalid_count / nullif(valid_count + invalid_count, 0)), 4) AS imputed_max FROM n")
def pixel_composition(t):
    a = aggregate.daily_quality_agg(pixels(t("lineitem")), "day", "value", "quality", "fill").withColumn("total", F.expr("valid_count + fill_count + invalid_count"))
    v, i = clean.safe_div(F.col("valid_count"), F.col("total")), clean.safe_div(F.col("invalid_count"), F.expr("valid_count + invalid_count"))
    return rounded(a.agg(F.min("total").alias("total_min"), F.max("total").alias("total_max"), F.avg("total").alias("total_mean"), F.avg(v).alias("valid_mean"), F.min(v).alias("valid_min"), F.avg(i).alias("imputed_mean"), F.max(i).alias("imputed_max")), "total_mean", "valid_mean", "valid_min", "imputed_mean", "imputed_max")


@query(f"{_SELECTIVE} SELECT day, (valid_count + fill_count + invalid_count)::BIGINT AS seen, (valid_count + fill_count + invalid_count - 25)::BIGINT AS off FROM a WHERE valid_count + fill_count + invalid_count <> 25")
def pixel_invariant(t):
    a = aggregate.daily_quality_agg(pixels(t("lineitem")), "day", "value", "quality", "fill")
    return reports.violations(a, "day", ["valid_count", "fill_count", "invalid_count"], 25)


@query(f"{_SELECTIVE} SELECT month(day)::INTEGER AS month, round(avg(100.0 * valid_count / nullif(valid_count + fill_count + invalid_count, 0)), 4) AS valid_pct, round(avg(100.0 * invalid_count / nullif(valid_count + fill_count + invalid_count, 0)), 4) AS imputed_pct FROM a GROUP BY 1")
def monthly_composition(t):
    a = aggregate.daily_quality_agg(pixels(t("lineitem")), "day", "value", "quality", "fill").withColumn("total", F.expr("valid_count + fill_count + invalid_count"))
    pct = lambda c: 100 * clean.safe_div(F.col(c), F.col("total"))
    return rounded(a.groupBy(F.month("day").alias("month")).agg(F.avg(pct("valid_count")).alias("valid_pct"), F.avg(pct("invalid_count")).alias("imputed_pct")), "valid_pct", "imputed_pct")


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(l_extendedprice - 40000.0) > 500.1 + 0.4 THEN l_extendedprice END, 4) AS value, (l_suppkey >> 1) & 3 AS flag, abs(l_extendedprice - 40000.0) <= 500.1 + 0.4 AS is_fill FROM lineitem")
def bitmask_sentinel(t):
    v = F.col("l_extendedprice")
    return rounded(t("lineitem").select("l_orderkey", "l_linenumber", clean.sentinel_to_null(v, 40000.0, 500.1).alias("value"), clean.bits(F.col("l_suppkey"), 1, 2).cast("long").alias("flag"), clean.is_sentinel(v, 40000.0, 500.1).alias("is_fill")), "value")


#: A square with a hole, and an island.
POLYGON = '{"type":"MultiPolygon","coordinates":[[[[10,1],[60,1],[60,12],[10,12],[10,1]],[[20,3],[40,3],[40,8],[20,8],[20,3]]],[[[70.5,2.5],[90.5,2.5],[80.5,11.5],[70.5,2.5]]]]}'


@query("""WITH g AS (SELECT c_custkey % 100 AS x, c_custkey // 100 AS y, c_acctbal FROM customer),
m AS (SELECT * FROM g WHERE x BETWEEN 5 AND 95 AND y BETWEEN 0 AND 14)
SELECT x, y, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM m WHERE ((x > 10 AND x < 60 AND y > 1 AND y < 12) AND NOT (x >= 20 AND x <= 40 AND y >= 3 AND y <= 8))
 OR (y > 2.5 AND (80.5 - 70.5) * (y - 2.5) - (x - 70.5) * (11.5 - 2.5) < 0 AND (80.5 - 90.5) * (y - 2.5) - (x - 90.5) * (11.5 - 2.5) > 0) GROUP BY x, y""")
def bbox_polygon_mask(t):
    grid = t("customer").select((F.col("c_custkey") % 100).alias("x"), F.floor(F.col("c_custkey") / 100).alias("y"), "c_acctbal")
    boxed = spatial.bbox(grid, "x", "y", 5, 0, 95, 14)
    edges = spatial.polygon_edges(t("region").limit(1).select(F.lit(POLYGON).alias("g")), "g")
    return spatial.inside(boxed, edges, "x", "y").groupBy("x", "y").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT vec_id, (i - 1)::INTEGER AS col_idx, round(embedding[i]::DOUBLE, 6) AS value, ((i - 1) % 4)::INTEGER AS quality FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)")
def raster_explode(t):
    q = F.transform("embedding", lambda x, i: (i % 4).cast("int"))
    rows = t("embeddings").select("vec_id", F.array("embedding").alias("band"), F.array(q).alias("q"))
    return reshape.explode_raster(rows, "band", "q", ["vec_id"]).select("vec_id", "col_idx", F.round(F.col("value").cast("double"), 6).alias("value"), "quality")


@query("""WITH e AS (SELECT vec_id, i, j, embedding[8 * i + j + 1]::DOUBLE AS v FROM embeddings, range(8) AS a(i), range(8) AS b(j))
SELECT vec_id, i::INTEGER AS row_idx, j::INTEGER AS col_idx, (53.5 - 0.5 * i)::DOUBLE AS lat, (3.0 + 0.25 * j)::DOUBLE AS lon, round(v, 6) AS value, ((i + j) % 4)::INTEGER AS quality FROM e WHERE 53.5 - 0.5 * i BETWEEN 50.7 AND 52.6 AND 3.0 + 0.25 * j BETWEEN 3.3 AND 4.5""")
def raster_crop(t):
    """Granules of eight by eight cells on a falling and a rising axis."""
    grid = lambda f: F.transform(F.sequence(F.lit(0), F.lit(7)), f)
    band, marks = grid(lambda i: F.slice("embedding", 8 * i + 1, 8)), grid(lambda i: grid(lambda j: ((i + j) % 4).cast("int")))
    rows = t("embeddings").select("vec_id", band.alias("band"), marks.alias("q"), grid(lambda i: 53.5 - 0.5 * i).alias("lat"), grid(lambda j: 3.0 + 0.25 * j).alias("lon"))
    cells = reshape.crop_raster(rows, "band", "lat", "lon", (3.3, 50.7, 4.5, 52.6), "q", ["vec_id"])
    return cells.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("""WITH s AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, user_id, avg(CASE WHEN event_type <> 'error' THEN value END) AS a, max(value) AS b FROM events GROUP BY 1, 2)
SELECT ts, round(avg(a) + 1e-9, 4) AS a, round(avg(b) + 1e-9, 4) AS b, count(a)::INTEGER AS station_count FROM s GROUP BY ts""")
def station_mean(t):
    s = t("events").groupBy(clean.hour_floor(F.col("ts")).alias("ts"), "user_id").agg(F.avg(F.when(F.col("event_type") != "error", F.col("value"))).alias("a"), F.max("value").alias("b"))
    return rounded(aggregate.station_mean(s, "ts", ["a", "b"], "a"), "a", "b", nudge=1e-9)


_SPINE = "s AS (SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) FROM events)::TIMESTAMP, (SELECT date_trunc('day', max(ts)) + INTERVAL 23 HOUR FROM events)::TIMESTAMP, INTERVAL 1 HOUR)) AS timestamp)"
_CALENDAR = "year(timestamp)::INTEGER AS year, month(timestamp)::INTEGER AS month, day(timestamp)::INTEGER AS day, hour(timestamp)::INTEGER AS hour, (dayofweek(timestamp) + 1)::INTEGER AS day_of_week, (dayofweek(timestamp) IN (0, 6))::INTEGER AS is_weekend, dayofyear(timestamp)::INTEGER AS day_of_year, weekofyear(timestamp)::INTEGER AS week_of_year, quarter(timestamp)::INTEGER AS quarter"


def _spine(t):
    span = t("events").agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("a"), (F.date_trunc("day", F.max("ts")) + F.expr("interval 23 hours")).cast("timestamp_ntz").alias("b"))
    return span.select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("timestamp"))


@query(f"WITH {_SPINE} SELECT timestamp, {_CALENDAR} FROM s")
def hourly_spine_calendar(t):
    return reshape.calendar_features(_spine(t), "timestamp")


@query(f"""WITH {_SPINE}, {FULL_HOURLY}, c AS (SELECT timestamp, {_CALENDAR} FROM s),
d AS (SELECT (o_orderdate + INTERVAL 8400 DAY)::DATE AS date, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1),
m AS (SELECT 2024 AS year, month(o_orderdate) AS month, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY 2)
SELECT c.timestamp, load, d.total AS d_total, m.price AS m_price FROM c LEFT JOIN h ON c.timestamp = h.ts LEFT JOIN d ON c.timestamp::DATE = d.date LEFT JOIN m ON c.year = m.year AND c.month = m.month""")
def spine_align_hour_day_month(t):
    o = t("orders")
    d = o.groupBy(F.date_add(F.to_date("o_orderdate"), 8400).alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    m = rounded(o.groupBy(F.lit(2024).alias("year"), F.month("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("price")), "price")
    out = align.join_on_hour(reshape.calendar_features(_spine(t), "timestamp"), hourly(t("events"), gaps=False).withColumnRenamed("ts", "timestamp"))
    return align.join_on_month(align.join_on_day(out, d, prefix="d_"), m, "m_").select("timestamp", "load", "d_total", "m_price")


@query("""WITH a AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS a FROM orders WHERE year(o_orderdate) < 1999 GROUP BY 1, 2),
b AS (SELECT year(l_shipdate) AS year, month(l_shipdate) AS month, count(*) AS b FROM lineitem WHERE year(l_shipdate) > 1996 GROUP BY 1, 2),
c AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, max(o_custkey) AS c FROM orders WHERE year(o_orderdate) IN (1995, 2000) GROUP BY 1, 2)
SELECT year::INTEGER AS year, month::INTEGER AS month, a, b, c FROM a FULL JOIN b USING (year, month) FULL JOIN c USING (year, month)""")
def outer_chain_monthly(t):
    o, li = t("orders"), t("lineitem")
    by = lambda c: [F.year(c).alias("year"), F.month(c).alias("month")]
    frames = [o.groupBy(*by("o_orderdate")).agg(F.count("*").alias("a")).where("year < 1999"), li.groupBy(*by("l_shipdate")).agg(F.count("*").alias("b")).where("year > 1996"), o.groupBy(*by("o_orderdate")).agg(F.max("o_custkey").alias("c")).where("year in (1995, 2000)")]
    return align.outer_chain(frames, ["year", "month"])


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, year(l_shipdate)::INTEGER AS year, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax END AS tax, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS levy FROM lineitem)
SELECT l_orderkey, l_linenumber, year, round(CASE WHEN year <= 1998 THEN levy + tax ELSE tax END, 4) AS total FROM x""")
def conditional_total(t):
    null_at = lambda c, n: F.when(F.col("l_linenumber") != n, F.col(c))
    y = F.year("l_shipdate")
    return rounded(t("lineitem").select("l_orderkey", "l_linenumber", y.alias("year"), clean.conditional_total(y, null_at("l_discount", 2), null_at("l_tax", 1), 1998).alias("total")), "total")


@query("""WITH l AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS levy FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
n AS (SELECT year(l_shipdate) AS year, month(l_shipdate) AS month, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT year::INTEGER AS year, month::INTEGER AS month, n, levy AS levy_old FROM n LEFT JOIN l USING (year, month)""")
def lookup_join(t):
    by = lambda c: [F.year(c).alias("year"), F.month(c).alias("month")]
    old = t("orders").where("o_orderstatus = 'F'").groupBy(*by("o_orderdate")).agg(F.count("*").alias("n"), F.max("o_custkey").alias("best"))
    new = t("lineitem").groupBy(*by("l_shipdate")).agg(F.count("*").alias("n"))
    return align.lookup(new, old, ["year", "month"], "_old", ["n"]).withColumnRenamed("n_old", "levy_old")


@query("""SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, o_totalprice AS price, o_orderstatus AS status, NULL::VARCHAR AS priority FROM orders WHERE year(o_orderdate) <= 1997
UNION ALL SELECT o_orderkey, year(o_orderdate)::INTEGER, o_totalprice, NULL, o_orderpriority FROM orders WHERE year(o_orderdate) > 1997""")
def version_splice(t):
    o = t("orders").withColumn("year", F.year("o_orderdate"))
    old = o.select("o_orderkey", "year", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    new = o.select("o_orderkey", "year", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    return with_missing_columns(align.version_splice(old, new, 1997), {"status": "string", "priority": "string"})


@query("""WITH n(priority, suffix, name) AS (VALUES (1, 'ARD', 'standard'), (2, 'D', 'd'), (3, 'Y', 'y'), (4, 'L', 'l')),
m AS (SELECT p_type, arg_min(name, priority) AS name FROM (SELECT DISTINCT p_type FROM part) q JOIN n ON p_type LIKE '%' || suffix GROUP BY p_type)
SELECT p_partkey, p_type, name FROM part LEFT JOIN m USING (p_type)""")
def topic_suffix_match(t):
    parts = t("part")
    names = parts.sparkSession.createDataFrame([(1, "ARD", "standard"), (2, "D", "d"), (3, "Y", "y"), (4, "L", "l")], "priority int, suffix string, name string")
    return align.match_suffix(parts.select("p_partkey", "p_type"), "p_type", names).select("p_partkey", "p_type", "name")


@query(f"WITH {DAILY}, s AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem) SELECT day, 'a' AS only_in FROM (SELECT day FROM d EXCEPT SELECT day FROM s) UNION ALL SELECT day, 'b' FROM (SELECT day FROM s EXCEPT SELECT day FROM d)")
def product_alignment(t):
    return quality.alignment(daily(t("orders")), t("lineitem").select(F.to_date("l_shipdate").alias("day")), "day")


@query(f"WITH {DAILY} SELECT day FROM d INTERSECT SELECT l_shipdate::DATE FROM lineitem")
def key_intersection(t):
    return daily(t("orders")).select("day").intersect(t("lineitem").select(F.to_date("l_shipdate").alias("day")))


@query("SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem")
def distinct_keys(t):
    return t("lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()


@query("SELECT 1::BIGINT AS files, count(*) AS rows, count(*) AS least_rows, count(*) AS most_rows, min(l_suppkey) AS l_suppkey_min, max(l_suppkey) AS l_suppkey_max, min(l_partkey) AS l_partkey_min, max(l_partkey) AS l_partkey_max, round(100.0 * count(CASE WHEN l_extendedprice IS NULL THEN 1 END) / count(*), 2) AS null_pct FROM lineitem")
def ingest_report(t):
    return reports.ingest_report(t("lineitem"), ["l_suppkey", "l_partkey"], "l_extendedprice")


@query("SELECT count(*) AS row_count, 6 AS column_count, min(ts) AS first_time, max(ts) AS last_time, 1::BIGINT AS files, true AS sized FROM events")
def table_summary(t):
    """Bytes are the store's own, so the query says only that they are known; tests compare them with the files."""
    out = reports.table_profile(t("events"), ("timestamp", "ts"))
    return out.withColumn("sized", F.col("bytes") > 0).drop("bytes")


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS t, generate_subscripts(embedding, 1)::INTEGER - 1 AS station FROM embeddings)
SELECT vec_id AS hour, station, round(CASE WHEN isnan(t) THEN NULL ELSE t END, 5) + 0.0 AS temp, NULL::DOUBLE AS wind FROM e""")
def station_grid(t):
    rows = reshape.grid_to_rows(t("embeddings").withColumnRenamed("vec_id", "hour"), ["hour"], {"temp": "embedding", "wind": "no_such"})
    return rounded(rows, "temp", digits=5).withColumn("temp", F.col("temp") + F.lit(0.0))  # no negative zeros


@query(f"WITH {HOURLY} SELECT year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, round(avg(load), 4) AS mean, count(*) AS n FROM h GROUP BY 1, 2")
def monthly_from_hourly(t):
    return rounded(hourly(t("events")).groupBy(F.year("ts").alias("year"), F.month("ts").alias("month")).agg(F.avg("load").alias("mean"), F.count("*").alias("n")), "mean")


_MERGED = f"""WITH {_SPINE}, {HOURLY}, c AS (SELECT timestamp, {_CALENDAR} FROM s),
p AS (SELECT (l_shipdate + INTERVAL 8400 DAY)::DATE AS day, l_extendedprice AS value, l_linenumber % 4 AS quality, l_returnflag = 'A' AND l_linestatus = 'O' AS fill FROM lineitem),
px AS (SELECT day, avg(CASE WHEN NOT fill AND quality <= 1 THEN value END) AS mean, sum(CASE WHEN NOT fill AND quality <= 1 THEN value END) AS sum, {_AGG}),
st AS (SELECT ts, avg(v) AS v, count(v)::INTEGER AS n FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, user_id, avg(value) AS v FROM events GROUP BY 1, 2) q GROUP BY ts),
a AS (SELECT month(o_orderdate) AS month, count(*) AS orders FROM orders WHERE month(o_orderdate) <> 1 OR o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT month(l_shipdate) AS month, max(l_suppkey) AS supplier FROM lineitem GROUP BY 1)"""


@query(f"""{_MERGED} SELECT c.timestamp, load, round(mean + 1e-9, 4) AS px_mean, round(px.sum, 4) AS px_sum, valid_count AS px_valid_count, fill_count AS px_fill_count, invalid_count AS px_invalid_count, round(st.v + 1e-9, 4) AS st_v, st.n AS st_station_count,
 a.orders AS mo_a_orders, b.supplier AS mo_b_supplier, c.year, c.month, c.day, c.hour, c.quarter, c.week_of_year, c.day_of_week, c.day_of_year, c.is_weekend
 FROM c LEFT JOIN h ON c.timestamp = h.ts LEFT JOIN px ON px.day = c.timestamp::DATE LEFT JOIN st ON st.ts = c.timestamp LEFT JOIN a ON c.year = 2024 AND a.month = c.month LEFT JOIN b ON c.year = 2024 AND b.month = c.month""")
def merged_table(t):
    """Events as load and stations, line items as pixels, orders and line items by month."""
    li, o, hour = t("lineitem"), t("orders"), clean.hour_floor(F.col("ts")).alias("timestamp")
    px = pixels(li).select(F.date_add("day", 8400).alias("date"), "value", "quality", "fill")
    st = t("events").groupBy(hour, F.col("user_id").alias("station")).agg(F.avg("value").alias("v"))
    by = lambda c: [F.lit(2024).alias("year"), F.month(c).alias("month")]
    a = o.where((F.month("o_orderdate") != 1) | (F.col("o_orderkey") % 2 == 0)).groupBy(*by("o_orderdate")).agg(F.count("*").alias("orders"))
    b = li.groupBy(*by("l_shipdate")).agg(F.max("l_suppkey").alias("supplier"))
    load = hourly(t("events")).withColumnRenamed("ts", "timestamp")
    parts = stages.aggregated({"load": load, "pixels": px, "stations": st, "monthly_a": a, "monthly_b": b})
    out = stages.merged(_spine(t), parts)
    return rounded(out, "px_mean", "st_v", nudge=1e-9).withColumn("px_sum", F.round("px_sum", 4))
