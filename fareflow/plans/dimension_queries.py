"""Queries over weather, city events, rents, restaurants, and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import places as P
from ..operators import validate as V
from ..sources import tables as T
from .adapters import CITY_EVENTS, RENT, RESTAURANTS, TRIPS_EV, WEATHER, ZONES_EV, ZONES_LI, Catalogue, city_events, rent, restaurants, rounded, table, trips_ev, weather, zones_ev, zones_li

query = Catalogue()


@query(f"WITH {CITY_EVENTS} SELECT date, hour, borough, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) ELSE 'Mixed Events' END AS event_type, CAST(sum(n_events) AS BIGINT) AS n_events FROM city_events GROUP BY date, hour, borough")
def events_collapsed(spark, sf):
    return A.collapse_events(city_events(spark, sf))


@query(f"WITH {CITY_EVENTS} SELECT borough, date, hour, CAST(sum(n_events) AS BIGINT) AS n_events, count(DISTINCT event_type) AS n_event_types FROM city_events GROUP BY 1, 2, 3 HAVING sum(n_events) >= 2")
def events_borough_hour(spark, sf):
    return A.events_borough_hour(city_events(spark, sf), 2)


@query(f"WITH {CITY_EVENTS}, h AS (SELECT borough, date, hour, sum(n_events) AS n, count(DISTINCT event_type) AS k FROM city_events GROUP BY 1, 2, 3) SELECT borough, date, CAST(sum(n) AS BIGINT) AS n_events, CAST(sum(k) AS BIGINT) AS n_event_types, CAST(max(n) AS BIGINT) AS max_per_hour FROM h GROUP BY 1, 2")
def events_daily(spark, sf):
    return A.events_daily(A.events_borough_hour(city_events(spark, sf)))


@query(f"WITH {CITY_EVENTS} SELECT event_type, date, CAST(sum(n_events) AS BIGINT) AS n_events FROM city_events GROUP BY 1, 2")
def events_type_daily(spark, sf):
    return A.events_by_type(city_events(spark, sf))


@query(f"WITH {CITY_EVENTS}, h AS (SELECT borough, date, hour, sum(n_events) AS n FROM city_events GROUP BY 1, 2, 3) SELECT borough, hour, round(avg(n), 4) AS mean_events, round(coalesce(stddev_samp(n), 0), 4) AS std_events, count(DISTINCT date) AS n_days FROM h GROUP BY 1, 2")
def events_hourly_pattern(spark, sf):
    return rounded(A.events_hourly_pattern(A.events_borough_hour(city_events(spark, sf))))


@query(f"WITH {CITY_EVENTS} SELECT date, hour, CAST(sum(n_events) AS BIGINT) AS city_n_events, 1 AS city_has_event FROM city_events GROUP BY 1, 2")
def city_event_features(spark, sf):
    return A.city_event_features(city_events(spark, sf))


@query(f"WITH {WEATHER} SELECT date, hour, round(temp_c, 4) AS temp_c, precip_mm, wind_kmh, weather_code FROM weather WHERE hour BETWEEN 0 AND 23 AND temp_c BETWEEN -40 AND 55 AND wind_kmh BETWEEN 0 AND 300 AND precip_mm >= 0")
def weather_valid(spark, sf):
    return rounded(V.valid(weather(spark, sf), V.weather_rules()).select("date", "hour", "temp_c", "precip_mm", "wind_kmh", "weather_code"))


# Two observations an hour, so that collapsing has something to do.
WEATHER2 = f"{WEATHER.replace('weather AS', 'one AS', 1)}, weather AS (SELECT date, CAST(floor(hour / 2) AS INT) AS hour, temp_c, precip_mm, rain_mm, snowfall_mm, wind_kmh, weather_code FROM one)"


def _weather2(spark, sf):
    return weather(spark, sf).withColumn("hour", F.floor(F.col("hour") / 2).cast("int"))


@query(f"WITH {WEATHER2}, c AS (SELECT date, hour, weather_code FROM weather GROUP BY date, hour, weather_code QUALIFY row_number() OVER (PARTITION BY date, hour ORDER BY count(*) DESC, weather_code) = 1) SELECT w.date, w.hour, round(avg(temp_c), 4) AS temp_c, round(avg(wind_kmh), 4) AS wind_kmh, sum(precip_mm) AS precip_mm, sum(rain_mm) AS rain_mm, sum(snowfall_mm) AS snowfall_mm, max(c.weather_code) AS weather_code FROM weather w JOIN c ON w.date = c.date AND w.hour = c.hour GROUP BY 1, 2")
def weather_hour_day(spark, sf):
    return rounded(A.weather_hour(_weather2(spark, sf)))


@query(f"WITH {WEATHER}, c AS (SELECT date, weather_code FROM weather GROUP BY date, weather_code QUALIFY row_number() OVER (PARTITION BY date ORDER BY count(*) DESC, weather_code) = 1) SELECT w.date, round(avg(temp_c), 4) AS temp_mean, min(temp_c) AS temp_min, max(temp_c) AS temp_max, round(avg(wind_kmh), 4) AS wind_mean, max(wind_kmh) AS wind_max, sum(precip_mm) AS precip_mm, sum(rain_mm) AS rain_mm, sum(snowfall_mm) AS snowfall_mm, max(c.weather_code) AS weather_code FROM weather w JOIN c ON w.date = c.date GROUP BY 1".replace("min(temp_c)", "round(min(temp_c), 4)").replace("max(temp_c)", "round(max(temp_c), 4)"))
def weather_daily(spark, sf):
    return rounded(A.weather_daily(weather(spark, sf)))


@query(f"WITH {WEATHER} SELECT hour, " + ", ".join(f"round({f}({c}), 4) AS {c}_{n}" for c in ("temp_c", "precip_mm", "wind_kmh") for n, f in (("mean", "avg"), ("std", "stddev_samp"))) + " FROM weather GROUP BY 1")
def weather_hourly_pattern(spark, sf):
    return rounded(A.weather_hourly_pattern(weather(spark, sf)))


@query(f"WITH {WEATHER} SELECT weather_code, count(*) AS n_hours FROM weather GROUP BY 1")
def weather_code_dist(spark, sf):
    return A.weather_codes(weather(spark, sf))


@query(f"WITH {WEATHER2} SELECT date, hour, round(avg(temp_c), 4) AS temp_c, round(avg(precip_mm), 4) AS precip_mm FROM weather GROUP BY 1, 2")
def weather_features(spark, sf):
    return rounded(A.weather_features(_weather2(spark, sf)))


@query(f"WITH {WEATHER} SELECT CAST(dayofweek(date) IN (0, 6) AS INT) AS is_weekend, round(quantile_cont(temp_c, 0.25), 4) AS q1, round(quantile_cont(temp_c, 0.5), 4) AS median, round(quantile_cont(temp_c, 0.75), 4) AS q3, round(avg(temp_c), 4) AS mean FROM weather GROUP BY 1")
def weather_box(spark, sf):
    q = F.percentile("temp_c", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = weather(spark, sf).groupBy(F.dayofweek("date").isin(1, 7).cast("int").alias("is_weekend")).agg(q.alias("q"), F.avg("temp_c").alias("mean"))
    return rounded(found.select("is_weekend", *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))], "mean"))


@query(f"WITH {RENT} SELECT year, zone_id, round(coalesce(sum(CASE WHEN price_moe > 0 THEN price / (price_moe * price_moe) END) / sum(CASE WHEN price_moe > 0 THEN 1 / (price_moe * price_moe) END), avg(price)), 4) AS rent_price_zone, count(DISTINCT id) AS n_tracts, round(avg(price_moe), 4) AS mean_moe, round(avg(CASE WHEN price > 0 THEN price_moe / price END), 4) AS mean_relative_error, round(count(*) FILTER (price_moe IS NULL) / count(*), 4) AS moe_null_share FROM rent GROUP BY 1, 2")
def rent_weighted_mean(spark, sf):
    return rounded(A.rent_by_zone(rent(spark, sf)))


@query("SELECT p_brand, round(coalesce(avg(p_retailprice) FILTER (p_size > 45), avg(p_retailprice)), 4) AS mean_price, count(*) FILTER (p_size > 45) AS n_available FROM part GROUP BY 1")
def rent_available_mean(spark, sf):
    return rounded(A.mean_available_price(table(spark, sf, "part"), "p_brand", "p_retailprice", F.col("p_size") > 45))


RENT_ZONES = f"{RENT}, {ZONES_LI}, known AS (SELECT year, zone_id, avg(price) AS v FROM rent WHERE zone_id % 7 <> 3 GROUP BY 1, 2)"


@query(f"WITH {RENT_ZONES}, moved AS (SELECT * FROM known WHERE year <> 2025 UNION ALL SELECT 2025, zone_id, v FROM known WHERE year = 2024), g AS (SELECT y AS year, pu_location_id AS zone_id, borough FROM zones, (VALUES (2023), (2024), (2025)) t(y)), j AS (SELECT g.*, v FROM g LEFT JOIN moved m ON g.year = m.year AND g.zone_id = m.zone_id), b AS (SELECT *, coalesce(v, avg(v) OVER (PARTITION BY year, borough)) AS vb FROM j), y AS (SELECT *, coalesce(vb, avg(vb) OVER (PARTITION BY year)) AS vy FROM b) SELECT CAST(year AS INT) AS year, zone_id, borough, round(coalesce(vy, (SELECT avg(vy) FROM y)), 4) AS rent_price_zone FROM y")
def rent_imputed(spark, sf):
    known = A.yearly_features(rent(spark, sf).where(F.col("zone_id") % 7 != 3), "price").withColumnRenamed("price", "rent_price_zone")
    zones = zones_li(spark, sf).withColumnRenamed("pu_location_id", "zone_id")
    return rounded(A.carried_and_imputed(known, zones, (2023, 2024, 2025), {2025: 2024}))


@query(f"WITH {RENT} SELECT year, zone_id, round(avg(price), 4) AS price FROM rent GROUP BY 1, 2")
def zone_year_features(spark, sf):
    return rounded(A.yearly_features(rent(spark, sf), "price"))


@query(f"WITH {RENT}, y AS (SELECT zone_id, year, avg(price) AS price FROM rent GROUP BY 1, 2) SELECT zone_id, year, round(price, 4) AS price FROM y QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY year DESC) = 1")
def latest_zone_features(spark, sf):
    return rounded(A.latest_features(rent(spark, sf), "price"))


@query(f"WITH {RESTAURANTS}, l AS (SELECT * FROM restaurants QUALIFY row_number() OVER (PARTITION BY year, camis ORDER BY inspection_date DESC, score DESC, grade DESC, zone_id DESC) = 1) SELECT year, zone_id, count(DISTINCT camis) AS n_restaurants_zone, count(DISTINCT cuisine) AS n_cuisines_zone, round(avg(score), 4) AS mean_score, round(avg(CASE WHEN grade = 'O' THEN 1.0 ELSE 0.0 END), 4) AS grade_a_share FROM l GROUP BY 1, 2")
def restaurants_zone(spark, sf):
    graded = restaurants(spark, sf).withColumn("_g", F.col("grade")).withColumn("grade", F.col("_g"))
    last = V.first_per_key(graded, ["year", "camis"], F.desc("inspection_date"), F.desc("score"), F.desc("grade"), F.desc("zone_id"))
    return rounded(A.restaurants_by_zone(last.withColumn("grade", F.when(F.col("grade") == "O", "A").otherwise("B"))))


@query("SELECT p_partkey, lower(p_type) AS low, upper(p_name) AS up, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS title, CASE WHEN p_size % 3 = 0 THEN NULL ELSE trim(p_brand) END AS brand, CAST(p_size AS DOUBLE) + 1000.5 AS price FROM part")
def text_cleaning(spark, sf):
    p = table(spark, sf, "part")
    brand = F.when(F.col("p_size") % 3 == 0, F.lit(" nan ")).otherwise(F.concat(F.lit("  "), "p_brand", F.lit(" ")))
    amount = F.format_number(F.col("p_size") + 1000.5, 2)
    return p.select("p_partkey", F.lower("p_type").alias("low"), F.upper("p_name").alias("up"), C.title_case("p_name").alias("title"), C.clean_text(brand).alias("brand"), C.money(F.concat(F.lit("$"), amount)).alias("price"))


@query("SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'Manhattan' WHEN 2 THEN 'Bronx' WHEN 3 THEN 'Brooklyn' WHEN 4 THEN 'Queens' END AS by_code, CASE r_regionkey WHEN 0 THEN 'Staten Island' ELSE 'St. Elsewhere' END AS by_name, make_date(2020 + r_regionkey, 1, 1) AS snapshot FROM region")
def borough_names(spark, sf):
    key = F.col("r_regionkey")
    return table(spark, sf, "region").select("r_regionkey", C.borough_name(key).alias("by_code"), C.borough_name(F.when(key == 0, "STATEN island").otherwise("ST. elsewhere")).alias("by_name"), C.snapshot_date(F.concat((2020 + key).cast("string"), F.lit("-acs5"))).alias("snapshot"))


@query("SELECT l_returnflag AS key, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM lineitem), 1) AS percent FROM lineitem GROUP BY 1")
def share_table(spark, sf):
    found = A.shares(table(spark, sf, "lineitem"), "l_returnflag", 6)
    return rounded(found.withColumnRenamed("l_returnflag", "key"), 1)


@query("SELECT l_linenumber, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N, count(*) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY 1")
def crosstab_levels(spark, sf):
    return A.crosstab(table(spark, sf, "lineitem"), "l_linenumber", "l_returnflag", ["A", "N", "R"])


@query(f"WITH {TRIPS_EV} SELECT hour, " + ", ".join(f"count(*) FILTER (day_of_week = {d}) AS d{d}" for d in range(1, 8)) + " FROM trips GROUP BY 1")
def pivot_day_hour(spark, sf):
    return A.crosstab(trips_ev(spark, sf).withColumn("day", F.concat(F.lit("d"), "day_of_week")), "hour", "day", [f"d{d}" for d in range(1, 8)])


@query(f"WITH {TRIPS_EV}, m AS (SELECT pu_location_id, hour, avg(total_amount_std) AS m FROM trips GROUP BY 1, 2) SELECT pu_location_id, round(avg(m), 4) AS mean_total_amount_std, count(*) AS n_cells FROM m GROUP BY 1")
def mean_of_means(spark, sf):
    return rounded(A.mean_of_means(trips_ev(spark, sf), ["pu_location_id", "hour"], "pu_location_id", "total_amount_std"))


@query(f"WITH {TRIPS_EV}, top3 AS (SELECT pu_location_id FROM trips GROUP BY 1 ORDER BY count(*) DESC, pu_location_id LIMIT 3) SELECT pu_location_id, hour, count(*) AS num_trips, round(avg(total_amount_std), 4) AS avg_price FROM trips SEMI JOIN top3 USING (pu_location_id) GROUP BY 1, 2")
def hotspots_top_zones(spark, sf):
    t = trips_ev(spark, sf)
    best = A.top(t.groupBy("pu_location_id").agg(F.count("*").alias("n")), 3, F.desc("n"), F.col("pu_location_id"))
    return rounded(t.join(F.broadcast(best), "pu_location_id", "left_semi").groupBy("pu_location_id", "hour").agg(F.count("*").alias("num_trips"), F.avg("total_amount_std").alias("avg_price")))


@query(f"WITH {TRIPS_EV}, d AS (SELECT service_type, date, count(*) AS n FROM trips GROUP BY 1, 2) SELECT service_type, round(avg(n), 4) AS mean_daily_trips, CAST(sum(n) AS BIGINT) AS total_trips FROM d GROUP BY 1")
def overview_services(spark, sf):
    d = trips_ev(spark, sf).groupBy("service_type", "date").agg(F.count("*").alias("n"))
    return rounded(d.groupBy("service_type").agg(F.avg("n").alias("mean_daily_trips"), F.sum("n").alias("total_trips")))


@query(f"WITH {TRIPS_EV} SELECT hour, service_type, pu_location_id, round(avg(total_amount_std), 4) AS avg_price, count(*) AS num_trips FROM trips WHERE year = 2024 AND service_type IN ('click', 'view') AND pu_location_id IN (1, 2, 3) GROUP BY ALL ORDER BY num_trips DESC, hour, service_type, pu_location_id LIMIT 15")
def service_comparison(spark, sf):
    t = trips_ev(spark, sf).where((F.col("year") == 2024) & F.col("service_type").isin("click", "view") & F.col("pu_location_id").isin(1, 2, 3))
    found = t.groupBy("hour", "service_type", "pu_location_id").agg(F.avg("total_amount_std").alias("avg_price"), F.count("*").alias("num_trips"))
    return rounded(A.top(found, 15, F.desc("num_trips"), F.col("hour"), F.col("service_type"), F.col("pu_location_id")))


@query(f"WITH {TRIPS_EV}, {ZONES_EV}, {WEATHER}, t AS (SELECT date, hour, pu_location_id, count(*) AS num_trips FROM trips GROUP BY ALL) SELECT borough, round(avg(num_trips) FILTER (coalesce(rain_mm, 0) <= 2), 4) AS mean_without, round(avg(num_trips) FILTER (rain_mm > 2), 4) AS mean_with, round(CASE WHEN avg(num_trips) FILTER (coalesce(rain_mm, 0) <= 2) <> 0 THEN (avg(num_trips) FILTER (rain_mm > 2) - avg(num_trips) FILTER (coalesce(rain_mm, 0) <= 2)) * 100 / avg(num_trips) FILTER (coalesce(rain_mm, 0) <= 2) END, 4) AS percent_change FROM t JOIN zones USING (pu_location_id) LEFT JOIN weather USING (date, hour) GROUP BY 1")
def rain_effect_pct(spark, sf):
    t = trips_ev(spark, sf).groupBy("date", "hour", "pu_location_id").agg(F.count("*").alias("num_trips"))
    joined = t.join(zones_ev(spark, sf), "pu_location_id").join(weather(spark, sf), ["date", "hour"], "left")
    return rounded(A.percent_change(joined, ["borough"], F.coalesce(F.col("rain_mm"), F.lit(0.0)) > 2, F.col("num_trips")))


@query(f"WITH {TRIPS_EV}, {WEATHER} SELECT pu_location_id, service_type, CASE WHEN rain_mm IS NULL THEN 'unknown' WHEN rain_mm <= 0 THEN 'none' WHEN rain_mm <= 2 THEN 'light' WHEN rain_mm <= 8 THEN 'moderate' ELSE 'heavy' END AS rain, count(*) AS n, round(avg(total_amount_std), 4) AS avg_price FROM trips LEFT JOIN weather USING (date, hour) GROUP BY ALL")
def rain_bins(spark, sf):
    joined = trips_ev(spark, sf).join(weather(spark, sf), ["date", "hour"], "left")
    return rounded(joined.groupBy("pu_location_id", "service_type", C.rain_bin("rain_mm").alias("rain")).agg(F.count("*").alias("n"), F.avg("total_amount_std").alias("avg_price")))


@query(f"WITH {TRIPS_EV}, {ZONES_EV}, {CITY_EVENTS}, e AS (SELECT date, hour, borough, sum(n_events) AS n FROM city_events GROUP BY 1, 2, 3), t AS (SELECT date, hour, pu_location_id, count(*) AS num_trips FROM trips GROUP BY ALL) SELECT hour, CAST(coalesce(n, 0) > 0 AS INT) AS has_event, count(*) AS n_cells, round(avg(num_trips), 4) AS mean_trips FROM t JOIN zones USING (pu_location_id) LEFT JOIN e USING (date, hour, borough) GROUP BY 1, 2")
def event_effect(spark, sf):
    e = A.events_borough_hour(city_events(spark, sf))
    t = trips_ev(spark, sf).groupBy("date", "hour", "pu_location_id").agg(F.count("*").alias("num_trips"))
    joined = t.join(zones_ev(spark, sf), "pu_location_id").join(e, ["date", "hour", "borough"], "left").fillna(0, ["n_events"])
    return rounded(joined.groupBy("hour", (F.col("n_events") > 0).cast("int").alias("has_event")).agg(F.count("*").alias("n_cells"), F.avg("num_trips").alias("mean_trips")))


@query("SELECT l_returnflag, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n_rows, CAST(sum(CAST(l_quantity > 25 AS INT)) AS BIGINT) AS n_valid_quantity, CAST(sum(CAST(l_discount > 0 AS INT)) AS BIGINT) AS n_discounted FROM lineitem GROUP BY 1, 2")
def audit_report(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("year"), (F.col("l_quantity") > 25).cast("int").alias("valid_quantity"), (F.col("l_discount") > 0).cast("int").alias("discounted"))
    return T.audit(li, ["l_returnflag", "year"], ["valid_quantity", "discounted"])


@query("SELECT c_custkey, CASE WHEN x < 0 THEN NULL ELSE CAST(floor(x / 1000) AS INT) * 10 + CAST(floor(y / 1000) AS INT) END AS zone_id FROM (SELECT c_custkey, c_acctbal AS x, CAST(c_custkey % 1000 * 10 AS DOUBLE) + 0.5 AS y FROM customer)".replace("x < 0", "x < 0 OR x >= 10000 OR y >= 10000"))
def point_in_polygon(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), ((F.col("c_custkey") % 1000 * 10).cast("double") + 0.5).alias("y"))
    corners = F.array(*[F.struct(F.lit(i).alias("ring_no"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(((0, 0), (1000, 0), (1000, 1000), (0, 1000)))])
    squares = spark.range(100).select(F.col("id").cast("int").alias("zone_id"), F.explode(corners).alias("c"))
    vertices = squares.select("zone_id", "c.ring_no", (F.floor(F.col("zone_id") / 10) * 1000 + F.col("c.dx")).cast("double").alias("x"), (F.col("zone_id") % 10 * 1000 + F.col("c.dy")).cast("double").alias("y"))
    return P.zone_of(c, P.polygons(vertices), cell=500.0).select(F.col("id").alias("c_custkey"), "zone_id")


@query("SELECT 'http://x/listings-2024-0' || (1 + r_regionkey) || '-01.csv' AS link, make_date(2024, 1 + r_regionkey, 1) AS snapshot FROM region ORDER BY r_regionkey DESC LIMIT 1")
def latest_snapshot(spark, sf):
    links = table(spark, sf, "region").select(F.concat(F.lit("<a href='http://x/listings-2024-0"), (F.col("r_regionkey") + 1).cast("string"), F.lit("-01.csv'>"), F.lit("<a href='http://x/other-2025-01-01.csv'>")).alias("html"))
    return T.latest_snapshot(links, r"http://x/listings-(\d{4}-\d{2}-\d{2})\.csv").select("link", "snapshot")


@query("SELECT r_regionkey * 10 + i AS hour_no, CAST(r_regionkey + i AS DOUBLE) AS temp FROM region, range(3) t(i)".replace("r_regionkey * 10 + i AS", "CAST(r_regionkey * 10 + i AS INT) AS"))
def weather_payload(spark, sf):
    key = F.col("r_regionkey")
    body = F.to_json(F.struct(F.struct(F.array(*[key * 10 + i for i in range(3)]).alias("hour_no"), F.array(*[(key + i).cast("double") for i in range(3)]).alias("temp")).alias("hourly")))
    return T.zip_arrays(table(spark, sf, "region").select(body.alias("body")), {"hour_no": "int", "temp": "double"})


@query("SELECT c_custkey AS id, 2024 AS year, c_acctbal AS v FROM customer WHERE c_nationkey < 5 UNION ALL SELECT c_custkey, 2025, c_acctbal FROM customer WHERE c_nationkey < 5")
def replace_partition_union(spark, sf):
    c = table(spark, sf, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") < 5, 2024).otherwise(2025).alias("year"), F.col("c_acctbal").alias("v"))
    return c.where("year <> 2025").unionByName(c.where("year = 2024").withColumn("year", F.lit(2025)))
