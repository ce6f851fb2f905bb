"""Queries behind a map, a forecast and the cards of a dashboard.

scores: zone, day_of_week (Sunday = 1), hour, raw. Clients that count days from Monday = 0 convert at the edge, by
``from_monday``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import five_levels, three_levels

OFFSETS = (0, 2, 4, 6, 12, 24)


def from_monday(day: Column) -> Column:
    """0 to 6 from Monday to 1 to 7 from Sunday."""
    return (day + 1) % 7 + 1


def median_features(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns])


def calibrated(df: DataFrame, raw: str = "raw") -> DataFrame:
    """score: raw between its 5th and 95th percentile, held within 0 and 1."""
    q = df.agg(F.percentile(raw, F.array(F.lit(0.05), F.lit(0.95))).alias("_q"))
    width = F.when(F.col("_q")[1] > F.col("_q")[0], F.col("_q")[1] - F.col("_q")[0]).otherwise(1.0)
    out = df.crossJoin(F.broadcast(q))  # one row
    return out.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(raw) - F.col("_q")[0]) / width))).drop("_q")


def zone_map(scores: DataFrame, day_of_week: int, hour: int) -> DataFrame:
    """Every zone of the slot; of the hour on any day if the slot is empty; else all slots."""
    match = F.when((F.col("day_of_week") == day_of_week) & (F.col("hour") == hour), 0).when(F.col("hour") == hour, 1).otherwise(2)
    ranked = scores.withColumn("_m", match)
    best = ranked.agg(F.min("_m").alias("_best"))
    return ranked.join(F.broadcast(best), F.col("_m") == F.col("_best")).drop("_m", "_best").withColumn("level", three_levels("score"))


def predictions(scores: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (zone, day_of_week, hour) the nearest slot: exact, then zone and hour, then zone, then hour; of
    equals the first by zone, day and hour. Requests that meet nothing stay, with null."""
    r, s = requests.alias("r"), scores.alias("s")
    same = {c: F.col(f"r.{c}") == F.col(f"s.{c}") for c in ("zone", "day_of_week", "hour")}
    joined = _candidates(r, s)
    quality = F.when(same["zone"] & same["hour"] & same["day_of_week"], 0).when(same["zone"] & same["hour"], 1).when(same["zone"], 2).otherwise(3)
    order = F.row_number().over(W.partitionBy("r.zone", "r.day_of_week", "r.hour").orderBy(quality, F.col("s.zone"), F.col("s.day_of_week"), F.col("s.hour")))
    best = joined.select("r.zone", "r.day_of_week", "r.hour", F.when(F.col("s.zone").isNotNull(), quality).alias("match"), F.col("s.score").alias("score"), order.alias("_n")).where("_n = 1").drop("_n")
    return best.withColumn("level", three_levels("score"))


def _candidates(r: DataFrame, s: DataFrame) -> DataFrame:
    """Slots of the request's zone and, where the zone has none, of its hour: two equi-joins instead of one disjunction."""
    zones = s.select(F.col("s.zone").alias("_z")).distinct()
    own = r.join(s, F.col("r.zone") == F.col("s.zone"))
    rest = r.join(zones, F.col("r.zone") == F.col("_z"), "left_anti")
    return own.unionAll(rest.join(s, F.col("r.hour") == F.col("s.hour"), "left"))


def forecast(scores: DataFrame, zones: Sequence[int], day_of_week: int, hour: int, offsets: Sequence[int] = OFFSETS) -> DataFrame:
    """Each zone at the hours ahead, days rolling over."""
    spark = scores.sparkSession
    ahead = spark.createDataFrame([(int(z), int(o)) for z in zones for o in offsets], "zone int, hour_offset int")
    at = F.lit(hour) + F.col("hour_offset")
    slots = ahead.select("zone", "hour_offset", (at % 24).cast("int").alias("hour"), ((F.lit(day_of_week - 1) + F.floor(at / 24)) % 7 + 1).cast("int").alias("day_of_week"))
    found = predictions(scores, slots.select("zone", "day_of_week", "hour").distinct())
    return slots.join(found, ["zone", "day_of_week", "hour"], "left")


def forecast_summary(ahead: DataFrame) -> DataFrame:
    return ahead.groupBy("zone").agg(F.max_by("hour_offset", F.struct("score", -F.col("hour_offset"))).alias("peak_offset"), F.max("score").alias("peak_score"), F.avg("score").alias("mean_score"))


def kpis(shown: DataFrame) -> DataFrame:
    n = F.count("*")
    return shown.agg(
        n.alias("n_zones"), F.count_if(F.col("score") > 0.8).alias("n_critical"), F.count_if(F.col("score") <= 0.2).alias("n_stable"),
        (F.count_if(F.col("score") > 0.8) * 100 / n).alias("percent_critical"), F.avg("score").alias("mean_score"), F.avg(F.when(F.col("score") > 0.8, F.col("score"))).alias("mean_critical"),
        F.max_by("zone", F.struct("score", -F.col("zone"))).alias("max_zone"), F.min_by("zone", F.struct("score", "zone")).alias("min_zone"),
    )


def alerts(shown: DataFrame, search: str = "", n: int = 4) -> DataFrame:
    """The worst zones whose id or name holds the search text, whatever its case."""
    text = F.concat_ws(" ", F.col("zone").cast("string"), *[c for c in ("zone_name",) if c in shown.columns])
    return shown.where(F.contains(F.lower(text), F.lit(search.lower()))).orderBy(F.desc("score"), "zone").limit(n).withColumn("level", five_levels("score"))


def best_and_worst(shown: DataFrame, n: int = 5) -> DataFrame:
    worst = shown.orderBy(F.desc("score"), "zone").limit(n).select(F.lit("worst").alias("side"), "zone", "score")
    return worst.unionAll(shown.orderBy("score", "zone").limit(n).select(F.lit("best").alias("side"), "zone", "score"))


def hour_extremes(scores: DataFrame) -> DataFrame:
    by_hour = scores.groupBy("hour").agg(F.avg("score").alias("m"))
    return by_hour.agg(F.min_by("hour", F.struct("m", "hour")).alias("best_hour"), F.max_by("hour", F.struct("m", -F.col("hour"))).alias("worst_hour"))


def day_profile(scores: DataFrame, day_of_week: int, hours: Sequence[int] = (8, 10, 12, 14, 16, 18)) -> DataFrame:
    """Mean score at some hours of a day, and whether the day rises, falls or is stable (within 0.02)."""
    means = scores.where((F.col("day_of_week") == day_of_week) & F.col("hour").isin(*hours)).groupBy("hour").agg(F.round(F.avg("score"), 3).alias("mean_score"))
    ends = means.agg((F.max_by("mean_score", "hour") - F.min_by("mean_score", "hour")).alias("_d"))
    trend = F.when(F.abs("_d") <= 0.02, "stable").when(F.col("_d") > 0, "rising").otherwise("falling")
    return means.crossJoin(F.broadcast(ends)).withColumn("trend", trend).drop("_d")  # one row
