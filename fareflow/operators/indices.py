"""Demand patterns and composite indices."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import steps

# The weights of the index.
CORE = {"tip_amount_score": 0.30, "tip_pct_score": 0.20, "passenger_score": 0.15, "trip_volume_score": 0.35}
EXTERNAL = {"rent_score": 0.15, "restaurants_score": 0.07, "cuisines_score": 0.03}
LABELS = ((0.2, "Bajo"), (0.4, "Medio-bajo"), (0.6, "Medio"), (0.8, "Medio-alto"))


def demand_patterns(daily: DataFrame, least: int = 30) -> DataFrame:
    """Zone-hours with demand level (terciles within the zone), stability (variation coefficient over all) and priority.

    daily: pu_location_id, hour, date, num_trips, avg_price, std_price. Zones with fewer than three different means are Media.
    """
    cells = daily.where(F.col("num_trips") >= least).groupBy("pu_location_id", "hour").agg(
        F.avg("num_trips").alias("num_trips_avg"), F.coalesce(F.stddev_samp("num_trips"), F.lit(0.0)).alias("num_trips_std"), F.min("num_trips").alias("num_trips_min"),
        F.max("num_trips").alias("num_trips_max"), F.count("num_trips").alias("num_trips_count"), F.avg("avg_price").alias("avg_price_mean"), F.avg("std_price").alias("std_price_mean"),
    )
    cells = cells.withColumn("cv", F.when(F.col("num_trips_avg") > 0, F.col("num_trips_std") / F.col("num_trips_avg")).otherwise(0.0))
    zone = W.partitionBy("pu_location_id")
    cells = cells.withColumns({"_t": F.percentile("num_trips_avg", F.array(F.lit(1 / 3), F.lit(2 / 3))).over(zone), "_d": F.size(F.collect_set("num_trips_avg").over(zone))})
    level = F.when(F.col("_d") < 3, "Media").when(F.col("num_trips_avg") <= F.col("_t")[0], "Baja").when(F.col("num_trips_avg") <= F.col("_t")[1], "Media").otherwise("Alta")
    whole = cells.agg(F.percentile("cv", F.array(F.lit(0.33), F.lit(0.66))).alias("_c"))
    out = cells.withColumn("demand_level", level).crossJoin(F.broadcast(whole))  # one row
    stable = F.when(F.col("cv") <= F.col("_c")[0], "Predecible").when(F.col("cv") <= F.col("_c")[1], "Variable").otherwise("Volátil")
    out = out.withColumn("stability", stable)
    demand = F.when(F.col("demand_level") == "Alta", 3).when(F.col("demand_level") == "Media", 2).otherwise(1)
    calm = F.when(F.col("stability") == "Predecible", 3).when(F.col("stability") == "Variable", 2).otherwise(1)
    out = out.withColumn("operational_priority", demand * calm)
    label = F.when(F.col("operational_priority") >= 7, "Crítica").when(F.col("operational_priority") >= 4, "Alta").otherwise("Baja")
    return out.withColumn("operational_priority_label", label).drop("_t", "_d", "_c")


def min_max(c: str, by: str = "year"):
    """Between 0 and 1 within the year; 0.5 where all are equal; null stays null."""
    w = W.partitionBy(by)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(F.col(c).isNotNull(), F.when(hi == lo, 0.5).otherwise((F.col(c) - lo) / (hi - lo)))


def weighted_available(weights: Mapping[str, float]):
    """The weighted mean of the features that a row has; null if it has none."""
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    bottom = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return F.when(bottom > 0, top / bottom)


def tip_base(trips: DataFrame) -> DataFrame:
    """By year and pick-up zone, of plausible trips: volume, mean and median tip, mean share, mean passengers, share of tippers."""
    plausible = (F.col("tip_amount").isNull() | (F.col("tip_amount") >= 0)) & (F.col("tip_pct").isNull() | F.col("tip_pct").between(0, 100)) & (F.col("passenger_count").isNull() | F.col("passenger_count").between(0, 8))
    return trips.where(plausible).groupBy("year", "pu_location_id").agg(
        F.count("*").alias("trip_volume"), F.avg("tip_amount").alias("avg_tip_amount"), F.percentile("tip_amount", F.lit(0.5)).alias("median_tip_amount"),
        F.avg("tip_pct").alias("avg_tip_pct"), F.avg("passenger_count").alias("avg_passenger_count"), F.avg((F.col("tip_amount") > 0).cast("double")).alias("tip_share"),
    )


def socioeconomic_index(base: DataFrame, rent: DataFrame | None = None, restaurants: DataFrame | None = None) -> DataFrame:
    """Core score of the trips and, where a zone has any, a quarter of external score; scaled within the year and labelled."""
    out = base
    for extra, columns in ((rent, ["rent_price_zone"]), (restaurants, ["n_restaurants_zone", "n_cuisines_zone"])):
        if extra is None:
            out = out.withColumns({c: F.lit(None).cast("double") for c in columns})
        else:
            out = out.join(extra.select("year", F.col("zone_id").alias("pu_location_id"), *columns), ["year", "pu_location_id"], "left")
    parts = {"tip_amount_score": "avg_tip_amount", "tip_pct_score": "avg_tip_pct", "passenger_score": "avg_passenger_count", "trip_volume_score": "trip_volume", "rent_score": "rent_price_zone", "restaurants_score": "n_restaurants_zone", "cuisines_score": "n_cuisines_zone"}
    out = out.withColumns({score: min_max(c) for score, c in parts.items()})
    out = out.withColumns({"core_taxi_score": weighted_available(CORE), "external_score": weighted_available(EXTERNAL)})
    raw = F.when(F.col("external_score").isNotNull(), 0.75 * F.col("core_taxi_score") + 0.25 * F.col("external_score")).otherwise(F.col("core_taxi_score"))
    out = out.withColumn("socioeconomic_score_raw", raw)
    out = out.withColumn("socioeconomic_score", min_max("socioeconomic_score_raw"))
    return out.withColumn("socioeconomic_label", steps("socioeconomic_score", LABELS, "Alto", "Sin datos"))
