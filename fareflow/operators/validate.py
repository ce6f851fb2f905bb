"""Row validation as ordered rules: data, not code, so that the same list filters, explains and counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import integral_or_one, minutes_between, strict, tolerant

Rules = Sequence[tuple[str, Column]]


def reason(rules: Rules) -> Column:
    """The name of the first rule that a row fails; null for a valid row. A rule whose condition is null fails."""
    return reduce(lambda out, rule: out.when(~strict(rule[1]), F.lit(rule[0])), rules[1:], F.when(~strict(rules[0][1]), F.lit(rules[0][0])))


def valid(df: DataFrame, rules: Rules) -> DataFrame:
    return df.where(reason(rules).isNull())


def rejections(df: DataFrame, rules: Rules) -> DataFrame:
    """reason, n: rows by the first rule they fail."""
    return df.select(reason(rules).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def taxi_rules(columns: Sequence[str], start: str, end: str, year: int | None = None, month: int | None = None) -> Rules:
    """Street-hailed trips. Rules on columns that the table lacks are left out."""
    have = set(columns)
    rules = [
        ("pickup_missing", F.col(start).isNotNull()),
        ("dropoff_missing", F.col(end).isNotNull()),
        ("dropoff_not_after_pickup", F.col(end) > F.col(start)),
        ("too_long", minutes_between(start, end) <= S.MAX_MINUTES),
        ("no_passengers", "passenger_count" not in have or tolerant("passenger_count", F.col("passenger_count") > 0)),
        ("no_distance", "trip_distance" not in have or tolerant("trip_distance", F.col("trip_distance") > 0)),
        *[(f"negative_{c}", tolerant(c, F.col(c) >= 0)) for c in ("fare_amount", *S.FEES, "total_amount") if c in have],
        ("fare_too_high", "fare_amount" not in have or tolerant("fare_amount", F.col("fare_amount") <= S.MAX_FARE)),
        ("total_too_high", "total_amount" not in have or tolerant("total_amount", F.col("total_amount") <= S.MAX_TOTAL)),
    ]
    if year is not None and month is not None:
        rules.insert(2, ("outside_month", (F.year(start) == year) & (F.month(start) == month)))
    return [(name, rule) for name, rule in rules if not isinstance(rule, bool)]


def ride_rules(columns: Sequence[str] = ("base_passenger_fare", "driver_pay"), year: int | None = None, month: int | None = None) -> Rules:
    """For-hire trips: order of the four moments, the driver's own clock within five minutes, no negative amounts. Caps hold for values
    that are there. Rules on amounts that the table lacks are left out."""
    pickup = F.col("pickup_datetime")
    in_month = [] if year is None or month is None else [("outside_month", (F.year(pickup) == year) & (F.month(pickup) == month))]
    return [
        *in_month,
        ("moments_missing", pickup.isNotNull() & F.col("dropoff_datetime").isNotNull()),
        ("dropoff_not_after_pickup", F.col("dropoff_datetime") > pickup),
        ("pickup_not_after_request", tolerant("request_datetime", pickup > F.col("request_datetime"))),
        ("pickup_before_scene", tolerant("on_scene_datetime", pickup >= F.col("on_scene_datetime"))),
        ("scene_before_request", F.col("on_scene_datetime").isNull() | F.col("request_datetime").isNull() | (F.col("on_scene_datetime") >= F.col("request_datetime"))),
        ("too_long", minutes_between("pickup_datetime", "dropoff_datetime") <= S.MAX_MINUTES),
        ("clock_differs", F.abs(F.col("trip_time") / 60 - minutes_between("pickup_datetime", "dropoff_datetime")) < 5),
        ("no_distance", tolerant("trip_miles", F.col("trip_miles") > 0)),
        *[(f"negative_{c}", tolerant(c, F.col(c) >= 0)) for c in S.RIDE_AMOUNTS if c in columns],
        ("fare_too_high", tolerant("base_passenger_fare", F.col("base_passenger_fare") <= S.MAX_FARE)),
        ("pay_too_high", tolerant("driver_pay", F.col("driver_pay") <= S.MAX_FARE)),
    ]


def weather_rules(year: int | None = None, month: int | None = None) -> Rules:
    in_month = [] if year is None or month is None else [("outside_month", (F.year("date") == year) & (F.month("date") == month))]
    return [
        *in_month,
        ("hour", F.col("hour").between(0, 23)),
        ("temperature", F.col("temp_c").between(-40, 55)),
        ("wind", F.col("wind_kmh").between(0, 300)),
        ("precipitation", F.coalesce(F.col("precip_mm"), F.lit(0.0)) >= 0),
    ]


def counted_events(df: DataFrame) -> DataFrame:
    """n_events as a whole number; what isn't one counts as one event."""
    return df.withColumn("n_events", integral_or_one("n_events"))


def event_rules(boroughs: Sequence[str] = (*S.BOROUGHS, "Ewr")) -> Rules:
    """Null types fail: they aren't taken for text."""
    return [("hour", F.col("hour").between(0, 23)), ("borough", F.col("borough").isin(*boroughs)), ("event_type", F.length(F.trim("event_type")) > 0)]


def rent_rules(outlier_free: Column, years: tuple[int, int] = (2023, 2024)) -> Rules:
    """Thirteen rules in order. outlier_free: the verdict of the interquartile test on the price."""
    price = F.col("price")
    # The names of the reasons, and their order, which is part of the rule.
    return [
        ("snapshot_missing", F.col("snapshot").isNotNull()),
        ("snapshot_year_out_of_range", F.year("snapshot").between(*years)),
        ("id_missing", F.col("id").isNotNull()),
        ("zone_id_invalid", F.col("zone_id").cast("string").rlike(S.TRACT)),
        ("id_zone_mismatch", F.col("id").isNull() | F.col("zone_id").isNull() | (F.col("id") == F.col("zone_id"))),
        ("zone_name_missing", F.col("zone_name").isNotNull()),
        ("neighborhood_missing", F.col("neighborhood").isNotNull()),
        ("price_invalid_or_unreasonable", (price > 0) & (price <= S.MAX_RENT)),
        ("price_outlier", outlier_free),
        ("latitude_out_of_bounds_or_missing", F.col("latitude").between(*S.LATITUDES)),
        ("longitude_out_of_bounds_or_missing", F.col("longitude").between(*S.LONGITUDES)),
        ("borough_invalid", F.col("borough").isin(*S.BOROUGHS)),
        ("room_type_missing", F.col("room_type").isNotNull()),
    ]


def restaurant_rules() -> Rules:
    return [
        ("camis", F.col("camis").isNotNull()),
        ("inspection_date", F.col("inspection_date").isNotNull()),
        ("borough", F.col("borough").isin(*S.BOROUGHS)),
        ("latitude", F.col("latitude").between(*S.LATITUDES)),
        ("longitude", F.col("longitude").between(*S.LONGITUDES)),
        ("score", tolerant("score", F.col("score").between(0, 200))),
        ("grade", tolerant("grade", F.col("grade").isin(*S.GRADES))),
    ]


def iqr_fence(df: DataFrame, value: str, by: Sequence[str] = (), factor: float = 3.0, least: int = 10) -> DataFrame:
    """df with in_fence: within factor times the interquartile range of the quartiles; all rows of a group with few values
    or without spread are. One small aggregate, joined back by broadcast only where there is no key."""
    q = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"), F.count(value).alias("_n"))
    spread = F.col("_q")[1] - F.col("_q")[0]
    inside = (F.col("_n") < least) | (spread <= 0) | F.col(value).between(F.col("_q")[0] - factor * spread, F.col("_q")[1] + factor * spread)
    joined = df.join(q, list(by), "left") if by else df.crossJoin(F.broadcast(q))  # one row
    return joined.withColumn("in_fence", strict(inside)).drop("_q", "_n")


def changed_cells(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """For each column, in how many rows of the key it differs, null-safely; and in how many rows any does."""
    joined = before.alias("b").join(after.alias("a"), key)
    differs = {c: ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in columns}
    return joined.agg(*[F.count_if(d).alias(f"changed_{c}") for c, d in differs.items()], F.count_if(reduce(lambda x, y: x | y, differs.values())).alias("changed_rows"))


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row of each key, the first in an order that must be total."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def accounted(df: DataFrame, rules: Rules, duplicates: Sequence[tuple[str, Sequence[str]]], *order: Column) -> DataFrame:
    """df with reason: the first rule that a row fails; for rows that fail none, the first set of keys under which another row comes
    before it in the order, rows that an earlier set put aside no longer counting; null for rows that stay."""
    out = df.withColumn("reason", reason(rules))
    for name, keys in duplicates:
        place = F.row_number().over(W.partitionBy(*keys, F.col("reason").isNull()).orderBy(*order))
        out = out.withColumn("_n", place).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("_n") > 1), F.lit(name)).otherwise(F.col("reason"))).drop("_n")
    return out


def known_only(df: DataFrame, column: str, valid: DataFrame, key: str) -> DataFrame:
    """df with values of the column that valid's key lacks made null; rows stay."""
    known = valid.select(F.col(key).alias("_known")).distinct()
    return df.join(known, F.col(column) == F.col("_known"), "left").withColumn(column, F.col("_known").cast(df.schema[column].dataType)).select(*df.columns)


def code_domains(df: DataFrame, domains: Mapping[str, Sequence]) -> DataFrame:
    """Values outside a column's domain become null."""
    return df.withColumns({c: F.when(F.col(c).isin(*values), F.col(c)) for c, values in domains.items()})


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that should be unique but aren't, with their rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
