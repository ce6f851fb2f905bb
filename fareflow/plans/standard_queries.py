"""Queries from raw records to standard trips, and trips joined with places and days."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import aggregates as A
from ..operators import dimensions as D
from ..operators import panel as P
from ..operators import trips as T
from .adapters import CITY_EVENTS, RESTAURANTS, TRIPS_EV, TRIPS_LI, ZONES_EV, ZONES_LI, Catalogue, city_events, restaurants, rounded, table, trips_ev, trips_li, zones_ev, zones_li

query = Catalogue()

# Order lines as raw records: returned ones are yellow, open ones green, the others rides. Line numbers make hours, days minutes.


def raw_trips(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    n, price = F.col("l_linenumber"), F.col("l_extendedprice")
    pick = F.col("o_orderdate") + F.make_interval(hours=n * 3)
    drop = pick + F.make_interval(mins=F.datediff("l_shipdate", "o_orderdate"))
    r = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    zones = [F.when((n != 7) | (F.col("l_returnflag") != "N"), F.col("l_suppkey")).alias("PULocationID"), F.col("l_partkey").alias("DOLocationID")]
    taxi = [F.when(n != 5, n.cast("string")).otherwise("x").alias("VendorID"), n.alias("passenger_count"), F.col("l_quantity").alias("trip_distance"), n.alias("RatecodeID"), (n % 5).alias("payment_type"), (price / 200).alias("fare_amount"), (price * F.col("l_tax") / 200).alias("tip_amount"), (F.col("l_discount") * 10).alias("tolls_amount"), F.lit(2.5).alias("congestion_surcharge")]
    yellow = r.where("l_returnflag = 'A'").select(pick.alias("tpep_pickup_datetime"), drop.alias("tpep_dropoff_datetime"), *zones, *taxi, F.when(n != 3, price / 150).alias("total_amount"), F.lit(1.25).alias("Airport_fee"))
    green = r.where("l_returnflag = 'N'").select(pick.alias("lpep_pickup_datetime"), drop.alias("lpep_dropoff_datetime"), *zones, *taxi, (price / 150).alias("total_amount"))
    rides = r.where("l_returnflag = 'R'").select(pick.alias("pickup_datetime"), drop.alias("dropoff_datetime"), *zones, F.col("l_quantity").alias("trip_miles"), (price / 200).alias("base_passenger_fare"), F.when(n % 2 == 0, price * F.col("l_tax") / 200).alias("tips"), (F.col("l_discount") * 10).alias("tolls"), F.lit(2.75).alias("congestion_surcharge"))
    return {"yellow": yellow, "green": green, "fhvhv": rides}


def _standard(spark, sf):
    return T.standard_trips(raw_trips(spark, sf), (1996, 1998))


STANDARD = """raw AS (
  SELECT *, o_orderdate + to_hours(CAST(l_linenumber * 3 AS BIGINT)) AS pick, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days, l_returnflag <> 'R' AS taxi, CAST(l_linenumber AS INT) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey), amounts AS (
  SELECT *, CASE WHEN l_returnflag = 'A' AND n <> 3 OR l_returnflag = 'N' THEN l_extendedprice / 150 END AS total_amount, CASE WHEN taxi THEN l_extendedprice / 200 END AS fare_amount, CASE WHEN taxi THEN l_extendedprice * l_tax / 200 END AS tip_amount,
    CASE WHEN NOT taxi AND n % 2 = 0 THEN l_extendedprice * l_tax / 200 END AS tips, CASE WHEN taxi THEN l_discount * 10 END AS tolls_amount, CASE WHEN NOT taxi THEN l_discount * 10 END AS tolls,
    CASE WHEN taxi THEN 2.5 ELSE 2.75 END AS congestion_surcharge, CASE WHEN l_returnflag = 'A' THEN 1.25 END AS airport_fee, CASE WHEN NOT taxi THEN l_extendedprice / 200 END AS base_passenger_fare FROM raw), std AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'yellow' WHEN 'N' THEN 'green' ELSE 'fhvhv' END AS service_type, pick AS pickup_datetime, pick + to_minutes(days) AS dropoff_datetime, CAST(pick AS DATE) AS date, CAST(year(pick) AS INT) AS year, CAST(month(pick) AS INT) AS month,
    CAST(hour(pick) AS INT) AS hour, CAST(dayofweek(pick) + 1 AS INT) AS day_of_week, CAST(dayofweek(pick) IN (0, 6) AS INT) AS is_weekend, CAST(weekofyear(pick) AS INT) AS week_of_year, CAST(CASE WHEN l_returnflag <> 'N' OR n <> 7 THEN l_suppkey END AS INT) AS pu_location_id,
    CAST(l_partkey AS INT) AS do_location_id, l_quantity AS trip_distance, CAST(days AS DOUBLE) AS trip_duration_min,
    coalesce(total_amount, coalesce(base_passenger_fare, 0) + coalesce(tip_amount, 0) + coalesce(tips, 0) + coalesce(tolls_amount, 0) + coalesce(tolls, 0) + coalesce(airport_fee, 0) + congestion_surcharge) AS total_amount_std,
    total_amount, fare_amount, tip_amount, tips, CASE WHEN fare_amount > 0 THEN tip_amount / fare_amount END AS tip_pct, tolls_amount, tolls, CAST(congestion_surcharge AS DOUBLE) AS congestion_surcharge, CAST(airport_fee AS DOUBLE) AS airport_fee, base_passenger_fare,
    CASE WHEN NOT taxi THEN l_quantity END AS trip_miles, CASE WHEN taxi AND n <> 5 THEN n END AS VendorID, CASE WHEN taxi THEN n END AS passenger_count, CASE WHEN taxi THEN n END AS RatecodeID, CASE WHEN taxi THEN n % 5 END AS payment_type FROM amounts), trips AS (
  SELECT *, CASE WHEN trip_distance > 0 THEN total_amount_std / trip_distance END AS price_per_mile FROM std WHERE pu_location_id IS NOT NULL AND year BETWEEN 1996 AND 1998)"""
_DOUBLES = {f.name for f in S.TRIP.fields if f.dataType.simpleString() == "double"}


def _shown(names) -> str:
    return ", ".join(f"round({c}, 4) AS {c}" if c in _DOUBLES else f"1 AS {c}" if c.startswith("is_valid_for_") else c for c in names)


@query(f"WITH {STANDARD} SELECT {_shown(S.TRIP.fieldNames())} FROM trips")
def standard_trips(spark, sf):
    return rounded(_standard(spark, sf))


@query(f"WITH {STANDARD}, once AS (SELECT DISTINCT {', '.join(S.TRIP_IDENTITY)} FROM trips) SELECT {_shown(S.TRIP_IDENTITY)} FROM once")
def dedup_trips(spark, sf):
    t = _standard(spark, sf)
    return rounded(T.without_repeats(t.unionByName(t.where("hour = 6"))).select(*S.TRIP_IDENTITY))


@query(f"WITH {STANDARD} SELECT service_type, count(*) AS n, count(VendorID) AS n_vendor, round(sum(total_amount_std), 2) AS total FROM trips WHERE year = 1997 AND month = 5 GROUP BY 1")
def core_trips(spark, sf):
    t = T.of_month(_standard(spark, sf), 1997, 5)
    return rounded(t.groupBy("service_type").agg(F.count("*").alias("n"), F.count("VendorID").alias("n_vendor"), F.sum("total_amount_std").alias("total")), 2)


@query(f"WITH {TRIPS_LI}, {ZONES_LI} SELECT trip_id, hour, t.pu_location_id, do_location_id, z.borough, e.borough AS borough_dropoff FROM trips t LEFT JOIN zones z ON t.pu_location_id = z.pu_location_id LEFT JOIN zones e ON do_location_id = e.pu_location_id")
def both_zones(spark, sf):
    return D.both_ends(trips_li(spark, sf), zones_li(spark, sf)).select("trip_id", "hour", "pu_location_id", "do_location_id", "borough", "borough_dropoff")


@query(f"WITH {TRIPS_EV}, {ZONES_EV}, {CITY_EVENTS}, {RESTAURANTS}, d AS (SELECT date, CAST(sum(n_events) AS BIGINT) AS day_events FROM city_events GROUP BY 1), b AS (SELECT borough, date, CAST(sum(n_events) AS BIGINT) AS borough_events FROM city_events GROUP BY 1, 2), h AS (SELECT borough, date, hour, CAST(sum(n_events) AS BIGINT) AS n_events FROM city_events GROUP BY 1, 2, 3), z AS (SELECT CAST(zone_id AS INT) AS pu_location_id, count(DISTINCT camis) AS n_places FROM restaurants GROUP BY 1) SELECT pu_location_id, borough, date, hour, count(*) AS n, max(day_events) AS day_events, max(borough_events) AS borough_events, max(n_events) AS n_events, max(n_places) AS n_places FROM trips LEFT JOIN zones USING (pu_location_id) LEFT JOIN d USING (date) LEFT JOIN b USING (borough, date) LEFT JOIN h USING (borough, date, hour) LEFT JOIN z USING (pu_location_id) GROUP BY 1, 2, 3, 4")
def tip_day_features(spark, sf):
    e, n = city_events(spark, sf), F.sum("n_events")
    features = {
        ("date",): e.groupBy("date").agg(n.alias("day_events")),
        ("borough", "date"): e.groupBy("borough", "date").agg(n.alias("borough_events")),
        ("borough", "date", "hour"): e.groupBy("borough", "date", "hour").agg(n.alias("n_events")),
        ("pu_location_id",): restaurants(spark, sf).groupBy(F.col("zone_id").cast("int").alias("pu_location_id")).agg(F.count_distinct("camis").alias("n_places")),
        ("absent", "date"): e,
    }
    t = D.with_day_features(trips_ev(spark, sf).join(zones_ev(spark, sf), "pu_location_id", "left"), features)
    return t.groupBy("pu_location_id", "borough", "date", "hour").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("day_events", "borough_events", "n_events", "n_places")])


@query("SELECT n_nationkey AS zone_id, n_name, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 1) ON n_regionkey = r_regionkey")
def tract_centroids(spark, sf):
    tracts = table(spark, sf, "nation").select(F.col("n_nationkey").alias("zone_id"), "n_name", "n_regionkey")
    known = table(spark, sf, "region").where("r_regionkey > 1").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return D.with_centroids(tracts, known.unionAll(known), "n_regionkey").select("zone_id", "n_name", "r_name")


@query("SELECT DISTINCT CASE c_nationkey % 6 WHEN 1 THEN 'Manhattan' WHEN 2 THEN 'Bronx' WHEN 3 THEN 'Brooklyn' WHEN 4 THEN 'Queens' WHEN 5 THEN 'Staten Island' END AS borough, c_mktsegment FROM customer")
def restaurant_places(spark, sf):
    return D.places(table(spark, sf, "customer").select((F.col("c_nationkey") % 6).alias("borough"), "c_mktsegment"))


@query("SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INT) AS hour, CAST(user_id % 5 AS VARCHAR) AS borough, event_type, count(*) AS n_events FROM events WHERE event_type <> 'click' GROUP BY ALL")
def events_grouped(spark, sf):
    raw = table(spark, sf, "events").select("ts", (F.col("user_id") % 5).cast("string").alias("borough"), F.when(F.col("event_type") != "click", F.col("event_type")).otherwise(" ").alias("kind"))
    return D.events_by_hour(raw, "ts", "borough", "kind")


@query(f"WITH {TRIPS_EV} SELECT date, service_type, count(*) AS num_trips, round(avg(total_amount_std), 4) AS avg_price, round(stddev_samp(total_amount_std), 4) AS std_price, count(DISTINCT pu_location_id) AS n_zones FROM trips WHERE total_amount_std > 0 AND total_amount_std < 300 AND date BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY 1, 2")
def priced_in_range(spark, sf):
    return rounded(A.daily_service(A.priced(trips_ev(spark, sf), 300.0, "2024-01-05", "2024-01-20")))


@query(f"WITH {TRIPS_EV} SELECT pu_location_id, date + to_hours(hour) AS timestamp_hour, count(*) AS n_trips FROM trips WHERE total_amount_std > 100 GROUP BY 1, 2")
def valid_demand(spark, sf):
    t = trips_ev(spark, sf).withColumn("is_valid_for_demand", (F.col("total_amount_std") > 100).cast("int"))
    return P.hourly_counts(t, F.col("is_valid_for_demand") == 1)


@query(f"WITH {TRIPS_EV} SELECT service_type, pu_location_id, hour, total_amount_std, event_key FROM (SELECT *, service_type || pu_location_id || date || hour AS event_key FROM trips) WHERE CAST('0x' || substr(md5('42:' || event_key), 1, 8) AS BIGINT) < 0.1 * 4294967296")
def seeded_sample(spark, sf):
    t = trips_ev(spark, sf).withColumn("event_key", F.concat("service_type", F.col("pu_location_id").cast("string"), F.col("date").cast("string"), F.col("hour").cast("string")))
    return A.seeded_sample(t.select("service_type", "pu_location_id", "hour", "total_amount_std", "event_key"), 0.1, "event_key")


@query(f"WITH {TRIPS_EV}, h AS (SELECT hour, service_type, count(*) AS n FROM trips GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY n DESC, hour, service_type) AS place FROM h")
def placed_report(spark, sf):
    return A.placed(trips_ev(spark, sf).groupBy("hour", "service_type").agg(F.count("*").alias("n")), F.desc("n"), F.col("hour"), F.col("service_type"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (l_quantity > 25) AS n_long, count(*) FILTER (l_discount = 0) AS n_plain, count(*) FILTER (l_shipdate IS NULL) AS n_undated FROM lineitem")
def scan_counts(spark, sf):
    return A.scan_counts(table(spark, sf, "lineitem"), {"n_long": F.col("l_quantity") > 25, "n_plain": F.col("l_discount") == 0, "n_undated": F.col("l_shipdate").isNull()})


@query("SELECT c_custkey, " + ", ".join(f"CASE WHEN c_nationkey % 7 <> 0 AND c_mktsegment = '{x}' THEN 1 ELSE 0 END AS \"c_mktsegment_{x}\"" for x in ("AUTOMOBILE", "BUILDING", "UNSEEN")) + ", CASE WHEN c_nationkey % 7 = 0 THEN 1 ELSE 0 END AS c_mktsegment_null FROM customer")
def segment_dummies(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return A.dummies(c, "c_mktsegment", ["AUTOMOBILE", "BUILDING", "UNSEEN"])


@query("SELECT r_regionkey AS a_b, r_name AS a_b_2, r_regionkey + 1 AS c, length(r_name) AS \"column\" FROM region")
def safe_columns(spark, sf):
    from ..functions.columns import safe_names

    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("a[b]"), F.col("r_name").alias("a b"), (F.col("r_regionkey") + 1).alias("<c>"), F.length("r_name").alias("[]"))
    return r.toDF(*safe_names(r.columns))


@query("SELECT c_custkey, round(degrees(c_acctbal * 1000 / 6378137.0), 4) AS lon, round(degrees(2 * atan(exp(c_custkey * 1000 / 6378137.0)) - pi() / 2), 4) AS lat FROM customer")
def web_mercator(spark, sf):
    from ..functions.columns import from_web_mercator

    lon, lat = from_web_mercator(F.col("c_acctbal") * 1000, F.col("c_custkey") * 1000)
    return rounded(table(spark, sf, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat")))
