"""The test tables read as trips, zones, weather, city events, rents and restaurants; each view in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import calendar


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Halves of the last digit are moved off the edge by this much, so that another order of summation gives the same digits.
NUDGE = 0.5001


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to some digits, in the same way as ``same_round`` has it in SQL."""
    scale = 10**digits
    return df.select(*[(F.floor(F.col(c) * scale + NUDGE) / scale).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def same_round(sql: str) -> str:
    """``round(x, n)`` written out as ``rounded`` does it."""
    while (at := sql.find("round(")) >= 0:
        depth, end, comma = 1, at + 6, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if sql[end] == "," and depth == 1 else comma
            end += 1
        scale = 10 ** int(sql[comma + 1 : end - 1])
        sql = f"{sql[:at]}(floor(({sql[at + 6 : comma]}) * {scale} + {NUDGE}) / {scale}){sql[end:]}"
    return sql


class Catalogue(dict):
    """Queries by name; ``sql`` has their oracle."""

    def __init__(self):
        super().__init__()
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self[f.__name__] = f
            if sql:
                self.sql[f.__name__] = same_round(sql)
            return f

        return add


# Trips from the event stream: a zone for each of eight groups of users.


def trips_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("service_type"), F.col("ts").alias("pickup_datetime"), (F.col("user_id") % 8 + 1).cast("int").alias("pu_location_id"), F.col("value").alias("total_amount_std")).withColumns(calendar("pickup_datetime"))


TRIPS_EV = """trips AS (
  SELECT event_type AS service_type, ts AS pickup_datetime, CAST(user_id % 8 + 1 AS INT) AS pu_location_id, value AS total_amount_std, CAST(ts AS DATE) AS date,
    CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(hour(ts) AS INT) AS hour, CAST(dayofweek(ts) + 1 AS INT) AS day_of_week,
    CAST(dayofweek(ts) IN (0, 6) AS INT) AS is_weekend, CAST(weekofyear(ts) AS INT) AS week_of_year
  FROM events)"""


# Trips from order lines: suppliers are pick-up zones, line numbers hours, days from order to shipment minutes.


def trips_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    price = F.col("l_extendedprice")
    trips = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("trip_id"), F.col("l_returnflag").alias("service_type"), F.col("o_orderdate").alias("pickup_datetime"), F.col("l_shipdate").alias("dropoff_datetime"),
        F.datediff("l_shipdate", "o_orderdate").cast("double").alias("trip_duration_min"), F.col("l_suppkey").cast("int").alias("pu_location_id"), F.col("l_partkey").cast("int").alias("do_location_id"),
        F.col("l_linenumber").alias("line_hour"), F.col("l_quantity").alias("trip_distance"), price.alias("fare_amount"), (price * F.col("l_tax")).alias("tip_amount"),
        (price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("total_amount_std"), F.col("l_linenumber").alias("passenger_count"),
    )
    return trips.withColumns(calendar("pickup_datetime")).withColumn("hour", F.col("line_hour")).drop("line_hour")


TRIPS_LI = """trips AS (
  SELECT l_orderkey AS trip_id, l_returnflag AS service_type, o_orderdate AS pickup_datetime, l_shipdate AS dropoff_datetime,
    CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS trip_duration_min, CAST(l_suppkey AS INT) AS pu_location_id, CAST(l_partkey AS INT) AS do_location_id,
    l_quantity AS trip_distance, l_extendedprice AS fare_amount, l_extendedprice * l_tax AS tip_amount,
    l_extendedprice * (1 - l_discount) * (1 + l_tax) AS total_amount_std, l_linenumber AS passenger_count,
    CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, l_linenumber AS hour,
    CAST(dayofweek(o_orderdate) + 1 AS INT) AS day_of_week, CAST(dayofweek(o_orderdate) IN (0, 6) AS INT) AS is_weekend, CAST(weekofyear(o_orderdate) AS INT) AS week_of_year
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def zones_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = spark.range(1, 9).select(F.col("id").cast("int").alias("pu_location_id"), (F.col("id") % 5).cast("int").alias("r"))
    region = table(spark, sf_dir, "region")
    return zones.join(region, F.col("r") == F.col("r_regionkey")).select("pu_location_id", F.col("r_name").alias("borough"))


ZONES_EV = """zones AS (
  SELECT CAST(z AS INT) AS pu_location_id, r_name AS borough FROM range(1, 9) t(z) JOIN region ON z % 5 = r_regionkey)"""


def zones_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("s_suppkey").cast("int").alias("pu_location_id"), F.col("s_name").alias("zone_name"), F.col("r_name").alias("borough"))


ZONES_LI = """zones AS (
  SELECT CAST(s_suppkey AS INT) AS pu_location_id, s_name AS zone_name, r_name AS borough
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumns({"date": F.to_date("ts"), "hour": F.hour("ts")})
    kind = F.col("event_type")
    return ev.groupBy("date", "hour").agg(
        F.avg(F.when(kind == "view", F.col("value"))).alias("temp_c"), F.count_if(kind == "error").cast("double").alias("precip_mm"), F.count_if(kind == "error").cast("double").alias("rain_mm"),
        F.count_if(kind == "signup").cast("double").alias("snowfall_mm"), F.max("value").alias("wind_kmh"), F.count_if(kind == "click").cast("int").alias("weather_code"),
    )


WEATHER = """weather AS (
  SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INT) AS hour, avg(value) FILTER (event_type = 'view') AS temp_c, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS precip_mm,
    CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS rain_mm, CAST(count(*) FILTER (event_type = 'signup') AS DOUBLE) AS snowfall_mm, max(value) AS wind_kmh,
    CAST(count(*) FILTER (event_type = 'click') AS INT) AS weather_code
  FROM events GROUP BY 1, 2)"""


def city_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").where("event_type in ('purchase', 'signup')").withColumn("r", (F.col("user_id") % 5).cast("int"))
    joined = ev.join(table(spark, sf_dir, "region"), F.col("r") == F.col("r_regionkey"))
    return joined.groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), F.col("r_name").alias("borough"), "event_type").agg(F.count("*").alias("n_events"))


CITY_EVENTS = """city_events AS (
  SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INT) AS hour, r_name AS borough, event_type, count(*) AS n_events
  FROM events JOIN region ON user_id % 5 = r_regionkey WHERE event_type IN ('purchase', 'signup') GROUP BY ALL)"""


def rent(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    moe = F.nullif((F.col("p_size") % 10).cast("double"), F.lit(0.0))
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100).cast("int").alias("zone_id"), F.col("p_retailprice").alias("price"), moe.alias("price_moe"), (2023 + F.col("p_partkey") % 2).cast("int").alias("year"), F.col("p_brand").alias("neighborhood"), F.col("p_type").alias("room_type"), F.col("p_name").alias("zone_name"))


RENT = """rent AS (
  SELECT p_partkey AS id, CAST(p_partkey % 100 AS INT) AS zone_id, p_retailprice AS price, nullif(CAST(p_size % 10 AS DOUBLE), 0.0) AS price_moe, CAST(2023 + p_partkey % 2 AS INT) AS year,
    p_brand AS neighborhood, p_type AS room_type, p_name AS zone_name
  FROM part)"""


def restaurants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    joined = c.join(o, F.col("c_custkey") == F.col("o_custkey"))
    return joined.select(F.col("c_custkey").alias("camis"), F.col("c_nationkey").alias("zone_id"), F.col("c_mktsegment").alias("cuisine"), F.col("c_acctbal").alias("score"), F.col("o_orderdate").alias("inspection_date"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("grade"), F.col("o_orderkey").alias("inspection_id"))


RESTAURANTS = """restaurants AS (
  SELECT c_custkey AS camis, c_nationkey AS zone_id, c_mktsegment AS cuisine, c_acctbal AS score, o_orderdate AS inspection_date, CAST(year(o_orderdate) AS INT) AS year,
    o_orderstatus AS grade, o_orderkey AS inspection_id
  FROM customer JOIN orders ON c_custkey = o_custkey)"""
