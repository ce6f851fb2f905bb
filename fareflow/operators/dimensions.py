"""Facts joined with zones, days and places. Dimensions are left to the planner, which broadcasts what it measures to be small."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import borough_name
from .panel import TIME, busiest, wide


def both_ends(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Trips with borough and borough_dropoff. zones: pu_location_id, borough."""
    once = zones.select("pu_location_id", "borough").dropDuplicates(["pu_location_id"])
    ends = once.select(F.col("pu_location_id").alias("do_location_id"), F.col("borough").alias("borough_dropoff"))
    return trips.join(once, "pu_location_id", "left").join(ends, "do_location_id", "left")


def with_day_features(trips: DataFrame, features: Mapping[Sequence[str], DataFrame]) -> DataFrame:
    """Trips with the features of their day, borough, hour or zone: one left join for each set of keys whose columns trips have. Keys that
    repeat in a table would repeat trips, so one row of each counts."""
    for keys, found in features.items():
        if set(keys) <= set(trips.columns):
            trips = trips.join(found.dropDuplicates(list(keys)), list(keys), "left")
    return trips


def with_centroids(tracts: DataFrame, centroids: DataFrame, key: str = "zone_id") -> DataFrame:
    """Tracts with their centroid's coordinates; tracts without one stay."""
    return tracts.join(centroids.dropDuplicates([key]), key, "left")


def places(inspections: DataFrame, borough: str = "borough") -> DataFrame:
    """Inspections with their borough's name, and each row once."""
    return inspections.withColumn(borough, borough_name(borough)).dropDuplicates()


def events_by_hour(raw: DataFrame, time: str, borough: str, kind: str) -> DataFrame:
    """date, hour, borough, event_type, n_events of single events. Events without a type are left out."""
    known = raw.where(F.col(kind).isNotNull() & (F.trim(F.col(kind).cast("string")) != ""))
    return known.groupBy(F.to_date(time).alias("date"), F.hour(time).alias("hour"), F.col(borough).alias("borough"), F.col(kind).alias("event_type")).agg(F.count("*").alias("n_events"))


def hourly_samples(panel: DataFrame, zones: Sequence[int], value: str = "n_trips") -> DataFrame:
    """One row an hour: each zone's value, the sum of all, the zone with the most, and how many have as many."""
    whole = panel.groupBy(TIME).agg(F.sum(value).alias(f"all_{value}"))
    return wide(panel, zones, value).join(whole, TIME).join(busiest(panel, value), TIME)


def winner_zones(samples: DataFrame) -> DataFrame:
    """Zones that ever have the most."""
    return samples.select("zone").distinct()


def scoped(panel: DataFrame, zones: DataFrame) -> DataFrame:
    """The panel's rows of those zones."""
    return panel.join(zones.select(F.col("zone").alias("pu_location_id")), "pu_location_id", "left_semi")
