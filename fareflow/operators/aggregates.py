"""Aggregates of trips, weather, city events, rents and restaurants.

Each is one ``groupBy``: partial sums before the shuffle, no repeated scans. Exact percentiles hold a group's distinct values;
``accuracy`` switches the ones over large groups to mergeable sketches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import within
from .validate import first_per_key

PRICE = "total_amount_std"


def priced(df: DataFrame, cap: float = 500.0, first: str | None = None, last: str | None = None) -> DataFrame:
    """Trips that price aggregates count: all keys there, hour in range, price above 0 and below the cap, date in a range."""
    keys = [c for c in ("date", "hour", "pu_location_id", "service_type", PRICE) if c in df.columns]
    keep = F.col("hour").between(0, 23) & (F.col(PRICE) > 0) & (F.col(PRICE) < cap)
    keep = keep if first is None and last is None else keep & within("date", first, last)
    return df.dropna(subset=keys).where(keep)


def daily_service(df: DataFrame) -> DataFrame:
    return df.groupBy("date", "service_type").agg(
        F.count("*").alias("num_trips"), F.avg(PRICE).alias("avg_price"), F.stddev_samp(PRICE).alias("std_price"), F.count_distinct("pu_location_id").alias("n_zones")
    )


def zone_hour_day(df: DataFrame, keys: Sequence[str] = (), least: int = 30) -> DataFrame:
    found = df.groupBy("pu_location_id", "hour", "date", *keys).agg(F.count("*").alias("num_trips"), F.avg(PRICE).alias("avg_price"), F.stddev_samp(PRICE).alias("std_price"))
    return found.where(F.col("num_trips") >= least)


def moments(df: DataFrame, keys: Sequence[str], value: str = PRICE) -> DataFrame:
    """n, sum and sum of squares: partial aggregates that later ones can add up."""
    x = F.col(value)
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"))


def merge_moments(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and sample deviation (null for one value) from partial moments."""
    added = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    spread = (F.col("squares") - F.col("total") * F.col("total") / F.col("n")) / (F.col("n") - 1)
    return added.select(*keys, "n", (F.col("total") / F.col("n")).alias("mean"), F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), spread))).alias("std"))


def price_variability(df: DataFrame, least: int = 100, accuracy: int | None = None) -> DataFrame:
    """Interquartile range by zone, hour and service with a score that favours busy cells, and z-scores over the result."""
    points = F.array(F.lit(0.25), F.lit(0.75))
    q = F.percentile(PRICE, points) if accuracy is None else F.percentile_approx(F.col(PRICE), points, accuracy)
    cells = df.groupBy("pu_location_id", "hour", "service_type").agg(F.count("*").alias("num_trips"), F.avg(PRICE).alias("avg_price"), q.alias("_q")).where(F.col("num_trips") >= least)
    cells = cells.withColumn("iqr", F.col("_q")[1] - F.col("_q")[0]).drop("_q").withColumn("biz_score", F.col("iqr") * F.log1p(F.col("num_trips")))
    cells = cells.withColumn("_log", F.log1p(F.col("num_trips")))
    whole = cells.agg(*[f(c).alias(f"{n}_{c}") for c in ("iqr", "_log") for n, f in (("m", F.avg), ("s", F.stddev_samp))])

    def z(c: str) -> Column:
        return F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0)

    out = cells.crossJoin(F.broadcast(whole))  # one row
    return out.withColumns({"z_sum": z("iqr") + z("_log"), "z_product": z("iqr") * z("_log")}).drop("_log", *whole.columns)


# City events


def collapse_events(events: DataFrame) -> DataFrame:
    """One row for each date, hour and borough; several types become one name for all."""
    kind = F.when(F.count_distinct("event_type") == 1, F.min("event_type")).otherwise("Mixed Events")
    return events.groupBy("date", "hour", "borough").agg(kind.alias("event_type"), F.sum("n_events").alias("n_events"))


def events_borough_hour(events: DataFrame, least: int = 1) -> DataFrame:
    found = events.groupBy("borough", "date", "hour").agg(F.sum("n_events").alias("n_events"), F.count_distinct("event_type").alias("n_event_types"))
    return found.where(F.col("n_events") >= least)


def events_daily(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("borough", "date").agg(F.sum("n_events").alias("n_events"), F.sum("n_event_types").alias("n_event_types"), F.max("n_events").alias("max_per_hour"))


def events_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", "date").agg(F.sum("n_events").alias("n_events"))


def events_hourly_pattern(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("borough", "hour").agg(
        F.avg("n_events").alias("mean_events"), F.coalesce(F.stddev_samp("n_events"), F.lit(0.0)).alias("std_events"), F.count_distinct("date").alias("n_days")
    )


# Weather


def weather_hour(weather: DataFrame) -> DataFrame:
    """By date and hour: means, sums, and the most frequent code (the smallest of equals)."""
    return weather.groupBy("date", "hour").agg(
        F.avg("temp_c").alias("temp_c"), F.avg("wind_kmh").alias("wind_kmh"), F.sum("precip_mm").alias("precip_mm"), F.sum("rain_mm").alias("rain_mm"),
        F.sum("snowfall_mm").alias("snowfall_mm"), F.mode("weather_code", True).alias("weather_code"),
    )


def weather_daily(weather: DataFrame) -> DataFrame:
    return weather.groupBy("date").agg(
        F.avg("temp_c").alias("temp_mean"), F.min("temp_c").alias("temp_min"), F.max("temp_c").alias("temp_max"), F.avg("wind_kmh").alias("wind_mean"),
        F.max("wind_kmh").alias("wind_max"), F.sum("precip_mm").alias("precip_mm"), F.sum("rain_mm").alias("rain_mm"), F.sum("snowfall_mm").alias("snowfall_mm"),
        F.mode("weather_code", True).alias("weather_code"),
    )


def weather_hourly_pattern(weather: DataFrame) -> DataFrame:
    return weather.groupBy("hour").agg(*[f(c).alias(f"{c}_{n}") for c in ("temp_c", "precip_mm", "wind_kmh") for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def weather_codes(weather: DataFrame) -> DataFrame:
    return weather.groupBy("weather_code").agg(F.count("*").alias("n_hours"))


def weather_features(weather: DataFrame) -> DataFrame:
    return weather.groupBy("date", "hour").agg(F.avg("temp_c").alias("temp_c"), F.avg("precip_mm").alias("precip_mm"))


def city_event_features(events: DataFrame) -> DataFrame:
    found = events.groupBy("date", "hour").agg(F.sum("n_events").alias("city_n_events"))
    return found.withColumn("city_has_event", (F.col("city_n_events") > 0).cast("int"))


# Rents and restaurants


def rent_by_zone(rent: DataFrame) -> DataFrame:
    """Inverse-variance weighted mean price where margins are known, else the plain mean; and the measures behind it."""
    sure = F.col("price_moe") > 0
    weight = F.when(sure, 1 / (F.col("price_moe") * F.col("price_moe")))
    return rent.groupBy("year", "zone_id").agg(
        F.coalesce(F.sum(F.when(sure, F.col("price") * weight)) / F.sum(weight), F.avg("price")).alias("rent_price_zone"),
        F.count_distinct("id").alias("n_tracts"),
        F.avg("price_moe").alias("mean_moe"),
        F.avg(F.when(F.col("price") > 0, F.col("price_moe") / F.col("price"))).alias("mean_relative_error"),
        (F.count_if(F.col("price_moe").isNull()) / F.count("*")).alias("moe_null_share"),
    )


def mean_available_price(listings: DataFrame, key: str, price: str, available: Column) -> DataFrame:
    """The mean price of available listings, or of all where none is."""
    return listings.groupBy(key).agg(F.coalesce(F.avg(F.when(available, F.col(price))), F.avg(price)).alias("mean_price"), F.count_if(available).alias("n_available"))


def restaurants_by_zone(inspections: DataFrame) -> DataFrame:
    """From each restaurant's last inspection of a year; a missing grade isn't an A."""
    last = first_per_key(inspections, ["year", "camis"], F.desc("inspection_date"), F.desc("score"), F.desc("grade"), F.desc("zone_id"))
    return last.groupBy("year", "zone_id").agg(
        F.count_distinct("camis").alias("n_restaurants_zone"), F.count_distinct("cuisine").alias("n_cuisines_zone"), F.avg("score").alias("mean_score"),
        F.avg(F.coalesce((F.col("grade") == "A").cast("double"), F.lit(0.0))).alias("grade_a_share"),
    )


def yearly_features(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("year", "zone_id").agg(F.avg(value).alias(value))


def latest_features(df: DataFrame, value: str) -> DataFrame:
    """Each zone's mean of its last year that has one."""
    by_year = df.where(F.col(value).isNotNull()).groupBy("zone_id", "year").agg(F.avg(value).alias(value))
    return by_year.groupBy("zone_id").agg(F.max("year").alias("year"), F.max_by(value, "year").alias(value))


def carried_and_imputed(rent: DataFrame, zones: DataFrame, years: Sequence[int], carry: dict[int, int], value: str = "rent_price_zone") -> DataFrame:
    """A full grid of years and zones. A year in carry takes the values of another; gaps take the mean of borough and year, then
    (after that fill) of the year, then of all."""
    moved = rent.where(~F.col("year").isin(*carry))
    for to, source in carry.items():
        moved = moved.unionByName(rent.where(F.col("year") == source).withColumn("year", F.lit(to)))
    grid = zones.select("zone_id", "borough").crossJoin(zones.sparkSession.createDataFrame([(int(y),) for y in years], "year int"))
    out = grid.join(moved.select("year", "zone_id", value), ["year", "zone_id"], "left")
    out = out.withColumn("_b", F.coalesce(value, F.avg(value).over(W.partitionBy("year", "borough"))))
    out = out.withColumn("_y", F.coalesce("_b", F.avg("_b").over(W.partitionBy("year"))))
    whole = out.agg(F.avg("_y").alias("_all"))
    return out.crossJoin(F.broadcast(whole)).select("year", "zone_id", "borough", F.coalesce("_y", "_all").alias(value))  # one row


# Tables behind the plots


def shares(df: DataFrame, key: str, digits: int = 1) -> DataFrame:
    """Rows by key with their percentage of all rows."""
    found = df.groupBy(key).agg(F.count("*").alias("n"))
    whole = found.agg(F.sum("n").alias("_all"))
    return found.crossJoin(F.broadcast(whole)).select(key, "n", F.round(F.col("n") * 100 / F.col("_all"), digits).alias("percent"))  # one row


def crosstab(df: DataFrame, rows: str, columns: str, levels: Sequence[str]) -> DataFrame:
    """Counts with a column for each level, 0 where there is none."""
    return df.groupBy(rows).pivot(columns, list(levels)).agg(F.count(F.lit(1))).fillna(0, list(levels))


def mean_of_means(df: DataFrame, keys: Sequence[str], outer: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("_m")).groupBy(outer).agg(F.avg("_m").alias(f"mean_{value}"), F.count("*").alias("n_cells"))


def box(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Least, quartiles, most and mean by key."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = df.groupBy(*keys).agg(F.min(value).alias("least"), q.alias("_q"), F.max(value).alias("most"), F.avg(value).alias("mean"))
    return found.select(*keys, "least", *[F.col("_q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))], "most", "mean")


def seeded_sample(df: DataFrame, fraction: float, key: str, seed: int = 42) -> DataFrame:
    """Rows whose key's seeded digest is below the fraction: the same rows on every run and any partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return df.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") < fraction * 2.0**32)


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """A report's rows with their place in a total order, and in that order."""
    return df.withColumn("place", F.row_number().over(W.orderBy(*order))).orderBy("place")


def residuals(df: DataFrame, truth: str, prediction: str, by: Sequence[str]) -> DataFrame:
    """The mean of truth less prediction by key."""
    return df.groupBy(*by).agg(F.avg(F.col(truth) - F.col(prediction)).alias("residual"))


def scan_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: rows read, and how many meet each condition, from one pass over them."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def dummies(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """A 0/1 column for each level seen in training, and one for null; other values have none, so any table gets the same columns."""
    x = F.col(column)
    flags = {f"{column}_{level}": F.coalesce((x == level).cast("int"), F.lit(0)) for level in levels}
    return df.withColumns(flags | {f"{column}_null": x.isNull().cast("int")}).drop(column)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in an order that must be total."""
    return df.orderBy(*order).limit(n)


def percent_change(df: DataFrame, keys: Sequence[str], flag: Column, value: Column) -> DataFrame:
    """The mean with and without the flag, and its change in percent; null where there is nothing to compare with."""
    found = df.groupBy(*keys).agg(F.avg(F.when(~flag, value)).alias("mean_without"), F.avg(F.when(flag, value)).alias("mean_with"))
    return found.withColumn("percent_change", F.when(F.col("mean_without") != 0, (F.col("mean_with") - F.col("mean_without")) * 100 / F.col("mean_without")))
