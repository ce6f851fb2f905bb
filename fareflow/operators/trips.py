"""From the three raw records to standard trips: 36 columns, one row for each trip."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .standardize import core_filter, standardize, total_amount


def first_of(df: DataFrame, names: tuple[str, ...], kind) -> Column:
    """The first value that there is of some columns, whatever their case; values that can't be read as the type are missing."""
    have = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{have[n.lower()]}`").try_cast(kind) for n in names if n.lower() in have]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def standard(df: DataFrame, service: str) -> DataFrame:
    """One service's raw records as standard trips. Absent columns are null; the total is the record's own or else the sum of its parts."""
    derived = {"service_type", "total_amount_std", "tip_pct", "price_per_mile", "trip_duration_min"}
    raw = [f for f in S.TRIP.fields if f.name not in derived and not f.name.startswith("is_valid_for_")]
    out = df.select(*[first_of(df, S.TRIP_NAMES.get(f.name, (f.name,)), f.dataType).alias(f.name) for f in raw]).withColumn("service_type", F.lit(service))
    parts = ("base_passenger_fare", "tip_amount", "tips", "tolls_amount", "tolls", "airport_fee", "congestion_surcharge")
    out = standardize(out.withColumn("total_amount_std", total_amount(F.col("total_amount"), *[F.col(c) for c in parts])))
    out = out.withColumns({f.name: F.lit(1) for f in S.TRIP.fields if f.name.startswith("is_valid_for_")})
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.TRIP.fields])


def standard_trips(raw: Mapping[str, DataFrame], years: tuple[int, int] | None = None) -> DataFrame:
    """All services' trips with a moment, a zone and an hour, of some years."""
    return core_filter(reduce(DataFrame.unionByName, [standard(df, service) for service, df in raw.items()]), years)


def of_month(trips: DataFrame, year: int, month: int) -> DataFrame:
    """Trips that belong to their file's month."""
    return trips.where((F.col("year") == year) & (F.col("month") == month))


def without_repeats(trips: DataFrame) -> DataFrame:
    """One record of each trip: those that agree in all columns of its identity are one."""
    return trips.dropDuplicates(list(S.TRIP_IDENTITY))
