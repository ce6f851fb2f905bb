"""From source columns to standard trips."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import calendar, minutes_between, ratio

#: Rules that empty cells, in order: name, condition, cells. Later rules see what earlier ones left.
CELL_RULES = (
    ("duration", lambda: F.col("trip_duration_min") <= 0, ("trip_duration_min",)),
    ("distance", lambda: F.col("trip_distance") <= 0, ("trip_distance",)),
    ("total", lambda: F.col("total_amount_std") < -5, ("total_amount_std", "price_per_mile")),
    ("tip_pct", lambda: ~F.col("tip_pct").between(0, 3), ("tip_pct",)),
    ("speed", lambda: F.col("trip_distance") / (F.col("trip_duration_min") / 60) > 120, ("trip_distance", "trip_duration_min", "price_per_mile")),
)


def total_amount(total: Column, *parts: Column) -> Column:
    """The total, or else the sum of its parts with missing ones as 0."""
    return F.coalesce(total, sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)))


def both(a: Column, b: Column) -> Column:
    """The sum of two columns for the same thing, null only if both are."""
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def standardize(df: DataFrame, pickup: str = "pickup_datetime", dropoff: str = "dropoff_datetime") -> DataFrame:
    """Calendar columns, duration, ratios. Needs trip_distance, fare_amount, tip_amount and total_amount_std."""
    out = df.withColumns(calendar(pickup)).withColumn("trip_duration_min", minutes_between(pickup, dropoff))
    return out.withColumns({"tip_pct": ratio("tip_amount", "fare_amount"), "price_per_mile": ratio("total_amount_std", "trip_distance")})


def empty_bad_cells(df: DataFrame) -> DataFrame:
    for _, bad, cells in CELL_RULES:
        df = df.withColumn("_bad", F.coalesce(bad(), F.lit(False))).withColumns({c: F.when(~F.col("_bad"), F.col(c)) for c in cells}).drop("_bad")
    return df


def validity_flags(df: DataFrame, flags: Mapping[str, str] | None = None) -> DataFrame:
    """is_valid_for_<name>: whether the column that the use needs has a value."""
    flags = flags or {"demand": "pu_location_id", "price": "total_amount_std", "duration": "trip_duration_min", "distance": "trip_distance", "tip": "tip_pct"}
    return df.withColumns({f"is_valid_for_{name}": F.col(c).isNotNull().cast("int") for name, c in flags.items()})


def core_filter(df: DataFrame, years: tuple[int, int] | None = None, hour: str = "hour") -> DataFrame:
    keep = F.col("pickup_datetime").isNotNull() & F.col("pu_location_id").isNotNull() & F.col(hour).between(0, 23)
    return df.where(keep if years is None else keep & F.year("pickup_datetime").between(*years))


def tip_trips(df: DataFrame, amount: str = "tip_amount", fare: str = "fare_amount", year: int | None = None, months: tuple[int, int] = (1, 12), ride_tips: bool = False) -> DataFrame:
    """Trips that tip models learn from, with has_tip, peak and night flags and a Monday = 0 day for their features.

    A trip needs its keys, a fare above 0 and a valid tip share. Rides for hire report tips under other names; ride_tips lets those with
    a known tip take part although they have no valid share.
    """
    share = F.col("tip_pct").isNotNull() | (F.lit(ride_tips) & F.col(amount).isNotNull())
    keep = F.col("pickup_datetime").isNotNull() & F.col("pu_location_id").isNotNull() & F.col(amount).isNotNull() & (F.col(fare) > 0) & share
    if year is not None:
        keep = keep & (F.year("pickup_datetime") == year)
    keep = keep & F.month("pickup_datetime").between(*months)
    return df.where(keep).withColumns({"has_tip": (F.col(amount) > 0).cast("int"), "is_peak": F.col("hour").isin(7, 8, 9, 16, 17, 18, 19).cast("int"), "is_night": F.col("hour").between(0, 5).cast("int"), "weekday_monday0": F.weekday("pickup_datetime")})
