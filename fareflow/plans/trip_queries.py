"""Queries over trips: validation, standardisation, deduplication, outliers, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import outliers as O
from ..operators import standardize as Z
from ..operators import validate as V
from .adapters import CITY_EVENTS, RENT, RESTAURANTS, TRIPS_EV, TRIPS_LI, Catalogue, city_events, rent, restaurants, rounded, table, trips_ev, trips_li

query = Catalogue()


@query(f"""WITH {TRIPS_EV} SELECT date, service_type, count(*) AS num_trips, round(avg(total_amount_std), 4) AS avg_price, round(stddev_samp(total_amount_std), 4) AS std_price,
  count(DISTINCT pu_location_id) AS n_zones FROM trips WHERE total_amount_std > 0 AND total_amount_std < 500 GROUP BY ALL""")
def daily_service(spark, sf):
    return rounded(A.daily_service(A.priced(trips_ev(spark, sf))))


@query(f"""WITH {TRIPS_EV} SELECT pu_location_id, hour, date, count(*) AS num_trips, round(avg(total_amount_std), 4) AS avg_price, round(stddev_samp(total_amount_std), 4) AS std_price
  FROM trips WHERE total_amount_std > 0 AND total_amount_std < 500 GROUP BY ALL HAVING count(*) >= 2""")
def zone_hour_day_global(spark, sf):
    return rounded(A.zone_hour_day(A.priced(trips_ev(spark, sf)), least=2))


@query(f"""WITH {TRIPS_EV} SELECT pu_location_id, hour, date, service_type, count(*) AS num_trips, round(avg(total_amount_std), 4) AS avg_price, round(stddev_samp(total_amount_std), 4) AS std_price
  FROM trips WHERE total_amount_std > 0 AND total_amount_std < 500 GROUP BY ALL HAVING count(*) >= 2""")
def zone_hour_day_service(spark, sf):
    return rounded(A.zone_hour_day(A.priced(trips_ev(spark, sf)), ["service_type"], least=2))


@query(f"""WITH {TRIPS_EV} SELECT service_type, count(total_amount_std) AS n, round(avg(total_amount_std), 4) AS mean, round(stddev_samp(total_amount_std), 4) AS std FROM trips GROUP BY ALL""")
def merged_moments(spark, sf):
    parts = A.moments(trips_ev(spark, sf), ["service_type", "date"])
    return rounded(A.merge_moments(parts, ["service_type"]))


@query(f"""WITH {TRIPS_EV}, cells AS (
  SELECT pu_location_id, hour, service_type, count(*) AS num_trips, avg(total_amount_std) AS avg_price, quantile_cont(total_amount_std, 0.75) - quantile_cont(total_amount_std, 0.25) AS iqr
  FROM trips WHERE total_amount_std > 0 AND total_amount_std < 500 GROUP BY ALL HAVING count(*) >= 5), m AS (
  SELECT avg(iqr) AS mi, stddev_samp(iqr) AS si, avg(ln(1 + num_trips)) AS ml, stddev_samp(ln(1 + num_trips)) AS sl FROM cells), z AS (
  SELECT cells.*, CASE WHEN si > 0 THEN (iqr - mi) / si ELSE 0 END AS zi, CASE WHEN sl > 0 THEN (ln(1 + num_trips) - ml) / sl ELSE 0 END AS zl FROM cells, m)
SELECT pu_location_id, hour, service_type, num_trips, round(avg_price, 4) AS avg_price, round(iqr, 4) AS iqr, round(iqr * ln(1 + num_trips), 4) AS biz_score, round(zi + zl, 4) AS z_sum, round(zi * zl, 4) AS z_product FROM z""")
def price_variability(spark, sf):
    return rounded(A.price_variability(A.priced(trips_ev(spark, sf)), least=5))


LI_RULES = """CASE WHEN pickup_datetime IS NULL THEN 'pickup_missing' WHEN dropoff_datetime IS NULL THEN 'dropoff_missing' WHEN NOT dropoff_datetime > pickup_datetime THEN 'dropoff_not_after_pickup'
  WHEN NOT date_diff('minute', pickup_datetime, dropoff_datetime) <= 360 THEN 'too_long' WHEN passenger_count <= 0 THEN 'no_passengers' WHEN trip_distance <= 0 THEN 'no_distance'
  WHEN fare_amount < 0 THEN 'negative_fare_amount' WHEN tip_amount < 0 THEN 'negative_tip_amount' WHEN fare_amount > 400 THEN 'fare_too_high' END"""


def _li(spark, sf):
    """Order lines with days shrunk to minutes and prices to the scale of fares."""
    trips = trips_li(spark, sf).withColumn("dropoff_datetime", F.col("pickup_datetime") + F.make_interval(mins=F.col("trip_duration_min").cast("int")))
    return trips.withColumns({"fare_amount": F.col("fare_amount") / 200, "tip_amount": F.col("tip_amount") / 200})


LI_SCALED = f"""{TRIPS_LI.replace("trips AS", "raw AS")}, trips AS (
  SELECT * REPLACE (pickup_datetime + to_minutes(CAST(trip_duration_min AS INT)) AS dropoff_datetime, fare_amount / 200 AS fare_amount, tip_amount / 200 AS tip_amount) FROM raw)"""


@query(f"""WITH {LI_SCALED} SELECT trip_id, pickup_datetime, dropoff_datetime, pu_location_id, passenger_count, round(fare_amount, 4) AS fare_amount FROM trips WHERE ({LI_RULES}) IS NULL""")
def validate_trips(spark, sf):
    df = _li(spark, sf)
    kept = V.valid(df, V.taxi_rules(df.columns, "pickup_datetime", "dropoff_datetime"))
    return rounded(kept.select("trip_id", "pickup_datetime", "dropoff_datetime", "pu_location_id", "passenger_count", "fare_amount"))


@query(f"""WITH {LI_SCALED}, r AS (SELECT {LI_RULES} AS reason FROM trips) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def rejection_reasons(spark, sf):
    df = _li(spark, sf)
    return V.rejections(df, V.taxi_rules(df.columns, "pickup_datetime", "dropoff_datetime"))


RIDES = f"""WITH {TRIPS_LI}, rides AS (
  SELECT trip_id, pickup_datetime - to_minutes(CAST(passenger_count AS INT)) AS request_datetime, CASE WHEN trip_distance > 10 THEN pickup_datetime - to_minutes(CAST(trip_distance AS INT) % 3) END AS on_scene_datetime,
    pickup_datetime, pickup_datetime + to_minutes(CAST(trip_duration_min AS INT)) AS dropoff_datetime, trip_distance AS trip_miles,
    CASE WHEN passenger_count <> 3 THEN trip_duration_min * 60 + 100 * passenger_count END AS trip_time, fare_amount / 200 AS base_passenger_fare, fare_amount / 300 AS driver_pay,
    CASE WHEN passenger_count <> 2 THEN trip_distance - 2 END AS tolls, 20 - tip_amount / 200 AS tips FROM trips), r AS (
  SELECT CASE WHEN NOT dropoff_datetime > pickup_datetime THEN 'dropoff_not_after_pickup' WHEN NOT pickup_datetime > request_datetime THEN 'pickup_not_after_request'
    WHEN on_scene_datetime IS NOT NULL AND NOT pickup_datetime >= on_scene_datetime THEN 'pickup_before_scene' WHEN on_scene_datetime IS NOT NULL AND NOT on_scene_datetime >= request_datetime THEN 'scene_before_request'
    WHEN date_diff('minute', pickup_datetime, dropoff_datetime) > 360 THEN 'too_long' WHEN NOT coalesce(abs(trip_time / 60 - date_diff('minute', pickup_datetime, dropoff_datetime)) < 5, false) THEN 'clock_differs'
    WHEN trip_miles <= 0 THEN 'no_distance' WHEN base_passenger_fare < 0 THEN 'negative_base_passenger_fare' WHEN tolls < 0 THEN 'negative_tolls' WHEN tips < 0 THEN 'negative_tips' WHEN driver_pay < 0 THEN 'negative_driver_pay'
    WHEN base_passenger_fare > 400 THEN 'fare_too_high' WHEN driver_pay > 400 THEN 'pay_too_high' ELSE 'valid' END AS reason FROM rides)
SELECT reason, count(*) AS n FROM r GROUP BY 1"""


def _rides(spark, sf):
    t, pick = trips_li(spark, sf), F.col("pickup_datetime")
    return t.select(
        (pick - F.make_interval(mins=F.col("passenger_count"))).alias("request_datetime"), F.when(F.col("trip_distance") > 10, pick - F.make_interval(mins=F.col("trip_distance").cast("int") % 3)).alias("on_scene_datetime"),
        pick, (pick + F.make_interval(mins=F.col("trip_duration_min").cast("int"))).alias("dropoff_datetime"), F.col("trip_distance").alias("trip_miles"),
        F.when(F.col("passenger_count") != 3, F.col("trip_duration_min") * 60 + 100 * F.col("passenger_count")).alias("trip_time"), (F.col("fare_amount") / 200).alias("base_passenger_fare"), (F.col("fare_amount") / 300).alias("driver_pay"),
        F.when(F.col("passenger_count") != 2, F.col("trip_distance") - 2).alias("tolls"), (20 - F.col("tip_amount") / 200).alias("tips"),
    )


@query(RIDES)
def ride_reasons(spark, sf):
    rides = _rides(spark, sf)
    return rides.groupBy(F.coalesce(V.reason(V.ride_rules(rides.columns)), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(RIDES.replace("SELECT CASE WHEN NOT dropoff_datetime > pickup", "SELECT CASE WHEN NOT (year(pickup_datetime) = 1995 AND month(pickup_datetime) = 3) THEN 'outside_month' WHEN NOT dropoff_datetime > pickup"))
def ride_month_reasons(spark, sf):
    rides = _rides(spark, sf)
    return rides.groupBy(F.coalesce(V.reason(V.ride_rules(rides.columns, 1995, 3)), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, CASE WHEN l_linenumber IN (1, 2, 6, 7) THEN l_linenumber END AS l_linenumber, CASE WHEN l_returnflag IN ('Y', 'N') THEN l_returnflag END AS l_returnflag FROM lineitem""")
def domain_coding(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return V.code_domains(df, {"l_linenumber": (1, 2, 6, 7), "l_returnflag": ("Y", "N")})


@query(f"""WITH {TRIPS_LI}, a AS (SELECT *, CASE WHEN fare_amount > 0 THEN tip_amount / fare_amount END AS tip_pct0, CASE WHEN trip_distance > 0 THEN total_amount_std / trip_distance END AS ppm0 FROM trips), b AS (
  SELECT *, CASE WHEN trip_duration_min <= 0 THEN NULL ELSE trip_duration_min END AS dur1, CASE WHEN tip_pct0 NOT BETWEEN 0 AND 3 THEN NULL ELSE tip_pct0 END AS tip_pct FROM a), c AS (
  SELECT *, coalesce(trip_distance / (dur1 / 60) > 120, false) AS fast FROM b)
SELECT trip_id, date, year, month, hour, day_of_week, is_weekend, week_of_year, pu_location_id, round(CASE WHEN fast THEN NULL ELSE dur1 END, 4) AS trip_duration_min, round(CASE WHEN fast THEN NULL ELSE trip_distance END, 4) AS trip_distance,
  round(tip_pct, 4) AS tip_pct, CASE WHEN fast THEN NULL ELSE round(ppm0, 4) END AS price_per_mile, 1 AS is_valid_for_price, CAST(NOT fast AND dur1 IS NOT NULL AS INT) AS is_valid_for_duration, CAST(NOT fast AS INT) AS is_valid_for_distance FROM c""")
def standardize_trips(spark, sf):
    t = trips_li(spark, sf)
    t = t.withColumns({"tip_pct": C.ratio("tip_amount", "fare_amount"), "price_per_mile": C.ratio("total_amount_std", "trip_distance")})
    t = Z.validity_flags(Z.empty_bad_cells(t), {"price": "total_amount_std", "duration": "trip_duration_min", "distance": "trip_distance"})
    return rounded(t.select("trip_id", "date", "year", "month", "hour", "day_of_week", "is_weekend", "week_of_year", "pu_location_id", "trip_duration_min", "trip_distance", "tip_pct", "price_per_mile", "is_valid_for_price", "is_valid_for_duration", "is_valid_for_distance"))


@query("""SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE coalesce(NULL, o_totalprice * 0.8 + CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 0.1 ELSE 0 END) END, 4) AS total_amount_std,
  round(CASE WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN NULL ELSE CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 2.5 END + CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 1.5 END END, 4) AS tips FROM orders""")
def price_harmonization(spark, sf):
    o, s = table(spark, sf, "orders"), F.col("o_orderstatus")
    total = Z.total_amount(F.when(s == "F", F.col("o_totalprice")), F.col("o_totalprice") * 0.8, F.when(s == "O", F.col("o_totalprice") * 0.1))
    tips = Z.both(F.when(s != "P", F.lit(2.5)), F.when(F.col("o_custkey") % 2 != 0, F.lit(1.5)))
    return rounded(o.select("o_orderkey", total.alias("total_amount_std"), tips.alias("tips")))


@query("""SELECT event_id, CAST(floor(hour(ts) / 3) AS INT) AS hour_block_3h, date_trunc('hour', ts) AS timestamp_hour, CAST(hour(ts) IN (7, 8, 9, 16, 17, 18, 19) AS INT) AS is_peak, CAST(hour(ts) < 6 AS INT) AS is_night,
  CAST(isodow(ts) - 1 AS INT) AS weekday_monday0, CAST(year(ts) AS INT) AS year, CAST(weekofyear(ts) AS INT) AS week_of_year FROM events""")
def calendar_parts(spark, sf):
    h = F.hour("ts")
    return table(spark, sf, "events").select("event_id", F.floor(h / 3).cast("int").alias("hour_block_3h"), C.hour_start("ts").alias("timestamp_hour"), h.isin(7, 8, 9, 16, 17, 18, 19).cast("int").alias("is_peak"), (h < 6).cast("int").alias("is_night"), F.weekday("ts").alias("weekday_monday0"), F.year("ts").alias("year"), F.weekofyear("ts").alias("week_of_year"))


SCOPE_SQL = "[" + ", ".join(f"CASE WHEN count({{v}}) >= 30 THEN round (quantile_cont({{v}}, {q}), 6) END" for q in O.QUANTILES) + "]"
_THREE = ("trip_duration_min", "trip_distance", "total_amount_std")
_Q = ", ".join(f"{SCOPE_SQL.format(v=v)} AS {v}" for v in _THREE)
_K = "service_type, year, month"


@query(f"""WITH {TRIPS_LI} SELECT {_K}, hour, count(trip_distance) AS n, """ + ", ".join(f"CASE WHEN count(trip_distance) >= 30 THEN round(quantile_cont(trip_distance, {q}), 4) END AS p{round(q * 100):02d}" for q in O.QUANTILES) + " FROM trips GROUP BY ALL")
def outlier_thresholds(spark, sf):
    q = O.thresholds(trips_li(spark, sf), {"hour": O.SCOPES["hour"]}, ["trip_distance"])["hour"]
    return rounded(q.select(*O.KEYS, "hour", F.col("n_trip_distance").alias("n"), *[F.col("q_trip_distance")[i].alias(f"p{round(p * 100):02d}") for i, p in enumerate(O.QUANTILES)]))


def _limit(v: str, i: int) -> str:
    return f"coalesce(a.{v}[{i}], b.{v}[{i}], c.{v}[{i}], d.{v}[{i}])"


def _treated(v: str) -> str:
    return f"CASE WHEN t.{v} < {_limit(v, 1)} OR t.{v} > {_limit(v, 4)} THEN NULL WHEN t.{v} < {_limit(v, 2)} OR t.{v} > {_limit(v, 3)} THEN least(greatest(t.{v}, {_limit(v, 2)}), {_limit(v, 3)}) ELSE t.{v} END"


_SCOPES = f"""{TRIPS_LI}, a AS (SELECT {_K}, pu_location_id, hour, is_weekend, {_Q} FROM trips GROUP BY 1, 2, 3, 4, 5, 6), b AS (SELECT {_K}, pu_location_id, {_Q} FROM trips GROUP BY 1, 2, 3, 4), c AS (SELECT {_K}, hour, {_Q} FROM trips GROUP BY 1, 2, 3, 4), d AS (SELECT {_K}, {_Q} FROM trips GROUP BY 1, 2, 3)"""
_JOINED = " ".join(f"LEFT JOIN {s} ON " + " AND ".join(f"t.{k} = {s}.{k}" for k in ("service_type", "year", "month", *keys)) for s, keys in (("a", ("pu_location_id", "hour", "is_weekend")), ("b", ("pu_location_id",)), ("c", ("hour",)), ("d", ())))


@query(f"""WITH {_SCOPES}, f AS (SELECT t.trip_id, t.hour, t.pu_location_id, t.date, {", ".join(f"{_treated(v)} AS {v}" for v in _THREE)} FROM trips t {_JOINED})
SELECT trip_id, hour, pu_location_id, date, round(trip_duration_min, 3) AS trip_duration_min, round(trip_distance, 3) AS trip_distance, round(total_amount_std, 3) AS total_amount_std, CASE WHEN trip_distance > 0 THEN round(total_amount_std / trip_distance, 3) END AS price_per_mile FROM f""")
def contextual_outliers(spark, sf):
    t = O.treat(O.with_thresholds(trips_li(spark, sf), _THREE), _THREE)
    return rounded(t.select("trip_id", "hour", "pu_location_id", "date", "trip_duration_min", "trip_distance", "total_amount_std", "price_per_mile"), 3)


@query(f"""WITH {_SCOPES}, l AS (""" + " UNION ALL ".join(f"SELECT '{v}' AS variable, CASE WHEN a.{v}[1] IS NOT NULL THEN 'primary' WHEN b.{v}[1] IS NOT NULL THEN 'zone' WHEN c.{v}[1] IS NOT NULL THEN 'hour' WHEN d.{v}[1] IS NOT NULL THEN 'all' END AS scope, CASE WHEN t.{v} < {_limit(v, 1)} OR t.{v} > {_limit(v, 4)} THEN 'r' WHEN t.{v} < {_limit(v, 2)} OR t.{v} > {_limit(v, 3)} THEN 'c' END AS action FROM trips t {_JOINED}" for v in _THREE) + """)
SELECT variable, scope, count(*) FILTER (action = 'r') AS n_removed, count(*) FILTER (action = 'c') AS n_clamped FROM l GROUP BY 1, 2""")
def outlier_actions(spark, sf):
    return O.actions(O.treat(O.with_thresholds(trips_li(spark, sf), _THREE), _THREE), _THREE)


@query("""SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem""")
def dedup_exact(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates(["l_orderkey", "l_linenumber"])


@query(f"""WITH {RESTAURANTS} SELECT camis, zone_id, inspection_date, grade, inspection_id FROM restaurants QUALIFY row_number() OVER (PARTITION BY camis ORDER BY inspection_date DESC, inspection_id DESC) = 1""")
def latest_per_key(spark, sf):
    return V.first_per_key(restaurants(spark, sf), ["camis"], F.desc("inspection_date"), F.desc("inspection_id")).select("camis", "zone_id", "inspection_date", "grade", "inspection_id")


@query(f"""WITH {RENT}, k AS (SELECT * FROM rent QUALIFY row_number() OVER (PARTITION BY year, zone_id ORDER BY price_moe NULLS LAST, price DESC, id) = 1)
SELECT year, zone_id, id, price FROM k QUALIFY row_number() OVER (PARTITION BY year, id ORDER BY zone_id) = 1""")
def rent_dedup(spark, sf):
    once = V.first_per_key(rent(spark, sf), ["year", "zone_id"], F.asc_nulls_last("price_moe"), F.desc("price"), F.col("id"))
    return V.first_per_key(once, ["year", "id"], F.col("zone_id")).select("year", "zone_id", "id", "price")


@query(f"""WITH {RENT}, q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b, count(price) AS n FROM rent)
SELECT id, price, (n < 10 OR b - a <= 0 OR price BETWEEN a - 0.6 * (b - a) AND b + 0.6 * (b - a)) AS in_fence FROM rent, q""")
def rent_price_fence(spark, sf):
    return V.iqr_fence(rent(spark, sf), "price", factor=0.6).select("id", "price", "in_fence")


@query(f"""WITH {RENT}, r AS (SELECT CASE WHEN room_type = 'PROMO' THEN 'snapshot_missing' WHEN year <> 2024 THEN 'snapshot_year_out_of_range' WHEN id % 100 = 7 THEN 'zone_id_invalid' WHEN NOT (price > 0 AND price <= 10000) THEN 'price_invalid_or_unreasonable'
  WHEN price > 1500 THEN 'price_outlier' WHEN id % 10 = 3 THEN 'borough_invalid' ELSE 'valid' END AS reason FROM rent) SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def rent_reasons(spark, sf):
    r = rent(spark, sf)
    zone = F.when(F.col("id") % 100 == 7, "7").otherwise("36061000100")
    r = r.select(F.when(F.col("room_type") != "PROMO", F.make_date("year", F.lit(1), F.lit(1))).alias("snapshot"), zone.alias("id"), zone.alias("zone_id"), "zone_name", "neighborhood", "price", F.lit(40.7).alias("latitude"), F.lit(-74.0).alias("longitude"), F.when(F.col("id") % 10 == 3, "Nowhere").otherwise("Queens").alias("borough"), "room_type")
    return r.groupBy(F.coalesce(V.reason(V.rent_rules(F.col("price") <= 1500, (2024, 2024))), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {RESTAURANTS}, r AS (SELECT CASE WHEN zone_id % 6 = 5 THEN 'borough' WHEN camis % 11 = 0 THEN 'latitude' WHEN score / 40 NOT BETWEEN 0 AND 200 THEN 'score' WHEN grade NOT IN ('A', 'B', 'C', 'N', 'P', 'Z', 'G') THEN 'grade' ELSE 'valid' END AS reason FROM restaurants)
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def restaurant_reasons(spark, sf):
    r = restaurants(spark, sf).withColumn("score", F.col("score") / 40)
    r = r.withColumns({"borough": F.when(F.col("zone_id") % 6 != 5, "Bronx").otherwise("Ewr"), "latitude": F.when(F.col("camis") % 11 == 0, 0.0).otherwise(40.5), "longitude": F.lit(-74.0)})
    return r.groupBy(F.coalesce(V.reason(V.restaurant_rules()), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {CITY_EVENTS} SELECT date, hour, borough, event_type, n_events FROM city_events WHERE borough IN ('ASIA', 'EUROPE') AND hour BETWEEN 0 AND 23 AND length(trim(event_type)) > 0""")
def events_valid(spark, sf):
    return V.valid(city_events(spark, sf), V.event_rules(("ASIA", "EUROPE"))).select("date", "hour", "borough", "event_type", "n_events")


@query(f"""WITH {CITY_EVENTS} SELECT date, hour, borough, event_type, CAST(CASE WHEN n_events % 2 = 0 THEN n_events / 2 ELSE 1 END AS INT) AS n_events FROM city_events""")
def events_counted(spark, sf):
    halves = city_events(spark, sf).withColumn("n_events", (F.col("n_events") / 2).cast("string"))
    return V.counted_events(halves).select("date", "hour", "borough", "event_type", "n_events")


@query(f"""WITH {RENT}, r AS (SELECT *, CASE WHEN room_type = 'PROMO' THEN 'snapshot_missing' WHEN price > 1500 THEN 'price_outlier' WHEN id % 10 = 3 THEN 'borough_invalid' END AS reason, id % 50 AS tract FROM rent),
  z AS (SELECT *, row_number() OVER (PARTITION BY year, tract, reason IS NULL ORDER BY price_moe NULLS LAST, price DESC, id) AS n FROM r)
SELECT CASE WHEN reason IS NOT NULL THEN reason WHEN n > 1 THEN 'duplicate_zone_in_snapshot' ELSE 'valid' END AS reason, count(*) AS n FROM z GROUP BY 1""")
def rent_accounting(spark, sf):
    r = rent(spark, sf).withColumn("part", F.col("id"))
    tract = F.concat(F.lit("36061"), F.lpad((F.col("part") % 50).cast("string"), 6, "0"))
    r = r.withColumns({"snapshot": F.when(F.col("room_type") != "PROMO", F.make_date("year", F.lit(1), F.lit(1))), "id": tract, "zone_id": tract, "latitude": F.lit(40.7), "longitude": F.lit(-74.0), "borough": F.when(F.col("part") % 10 == 3, "Nowhere").otherwise("Queens")})
    duplicates = [("duplicate_zone_in_snapshot", ["year", "zone_id"]), ("duplicate_id_in_snapshot", ["year", "id"])]
    found = V.accounted(r, V.rent_rules(F.col("price") <= 1500), duplicates, F.asc_nulls_last("price_moe"), F.desc("price"), F.col("part"))
    return found.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) THEN o_custkey END AS o_custkey FROM orders""")
def known_customers(spark, sf):
    valid = table(spark, sf, "customer").where("c_nationkey < 12")
    return V.known_only(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", valid, "c_custkey")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def uniqueness_check(spark, sf):
    return V.repeated_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT count(*) FILTER (o_orderstatus = 'P') AS changed_o_orderstatus, count(*) FILTER (o_totalprice > 400000) AS changed_o_totalprice, count(*) FILTER (o_orderstatus = 'P' OR o_totalprice > 400000) AS changed_rows FROM orders""")
def changed_cells(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = o.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"), F.least("o_totalprice", F.lit(400000.0)).alias("o_totalprice"))
    return V.changed_cells(o, after, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query(f"""WITH {TRIPS_LI} SELECT trip_id, hour, pu_location_id, round(tip_amount, 4) AS tip_amount, CAST(tip_amount > 0 AS INT) AS has_tip, CAST(hour IN (7, 8, 9, 16, 17, 18, 19) AS INT) AS is_peak, CAST(hour < 6 AS INT) AS is_night, CAST(isodow(pickup_datetime) - 1 AS INT) AS weekday_monday0
  FROM trips WHERE fare_amount > 0 AND month BETWEEN 10 AND 12""")
def tip_trips(spark, sf):
    t = trips_li(spark, sf).withColumn("tip_pct", C.ratio("tip_amount", "fare_amount"))
    return rounded(Z.tip_trips(t, months=(10, 12)).select("trip_id", "hour", "pu_location_id", "tip_amount", "has_tip", "is_peak", "is_night", "weekday_monday0"))


@query("""SELECT p_partkey, coalesce(a, b) AS id, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN a ELSE coalesce(b, a) END AS zone_id
  FROM (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size END AS a, CASE WHEN p_size % 5 <> 0 THEN CAST(p_size + p_partkey % 2 AS INT) END AS b FROM part)""")
def mutual_fill(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("id"), F.when(F.col("p_size") % 5 != 0, (F.col("p_size") + F.col("p_partkey") % 2).cast("int")).alias("zone_id"))
    return p.withColumns(C.filled_from_each_other("id", "zone_id", mismatch=True))


@query("""SELECT o_orderkey, CASE WHEN n <= floor(t * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN n <= floor(t * CAST(0.7 AS DOUBLE)) + floor(t * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n, count(*) OVER () AS t FROM orders)""")
def row_split(spark, sf):
    from ..operators.stress import row_split as split

    return split(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "split")


@query(f"""WITH {TRIPS_EV}, h AS (SELECT hour, count(*) AS n FROM trips GROUP BY 1), a AS (SELECT 'most' AS side, hour, n FROM h ORDER BY n DESC, hour LIMIT 4), b AS (SELECT 'least' AS side, hour, n FROM h ORDER BY n, hour LIMIT 4) SELECT * FROM a UNION ALL SELECT * FROM b""")
def extreme_hours(spark, sf):
    h = trips_ev(spark, sf).groupBy("hour").agg(F.count("*").alias("n"))
    most, least = A.top(h, 4, F.desc("n"), F.col("hour")), A.top(h, 4, F.col("n"), F.col("hour"))
    return most.select(F.lit("most").alias("side"), "hour", "n").unionAll(least.select(F.lit("least").alias("side"), "hour", "n"))


@query("""SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 12) ON o_custkey = c_custkey""")
def left_dimension(spark, sf):
    c = table(spark, sf, "customer").where("c_nationkey < 12")
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", "c_name", "c_nationkey")
