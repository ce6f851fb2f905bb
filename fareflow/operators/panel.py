"""Regular hourly panels: gap-free grids, lags, rolling means, leads, dimensions.

The grid is built from bounds and zones alone. All lags, rolls and leads of a zone share one window specification, so
Spark sorts once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import at_hour, calendar

ZONE, TIME = "pu_location_id", "timestamp_hour"


def by_zone():
    """The one window of all lags, rolls and leads."""
    return W.partitionBy(ZONE).orderBy(TIME)


def hourly_counts(trips: DataFrame, valid: Column | None = None) -> DataFrame:
    """Trips by zone and hour; valid: those that count."""
    trips = trips if valid is None else trips.where(valid & F.col(ZONE).isNotNull() & F.col("date").isNotNull() & F.col("hour").between(0, 23))
    return trips.groupBy(ZONE, at_hour("date", "hour").alias(TIME)).agg(F.count("*").alias("n_trips"))


def grid(cells: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Every zone at every hour from the first to the last; without zones, all that occur. One row of bounds, exploded."""
    bounds = cells.agg(F.min(TIME).alias("lo"), F.max(TIME).alias("hi"))
    hours = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias(TIME))
    zones = cells.select(ZONE).distinct() if zones is None else zones.select(ZONE).distinct()
    return zones.crossJoin(hours)


def filled(cells: DataFrame, zones: DataFrame | None = None, values: Mapping[str, float] | None = None) -> DataFrame:
    """The grid with the cells' values; gaps take the given values (0 for n_trips)."""
    values = values or {"n_trips": 0}
    out = grid(cells, zones).join(cells, [ZONE, TIME], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in values.items()})


def lag(c: str, n: int) -> Column:
    return F.lag(c, n).over(by_zone())


def rolling(c: str, n: int) -> Column:
    """The mean of the n hours before; null until there are n."""
    frame = by_zone().rowsBetween(-n, -1)
    return F.when(F.count(c).over(frame) == n, F.avg(c).over(frame))


def running(c: str, n: int) -> Column:
    """The mean of the last n hours, this one included, of however many there are."""
    return F.avg(c).over(by_zone().rowsBetween(1 - n, 0))


def with_history(panel: DataFrame, spec: Mapping[str, tuple[Sequence[int], Sequence[int]]]) -> DataFrame:
    """spec: column to (lags, rolls), named <column>_lag_<n> and <column>_roll_<n>."""
    return panel.withColumns({f"{c}_lag_{n}": lag(c, n) for c, (lags, _) in spec.items() for n in lags} | {f"{c}_roll_{n}": rolling(c, n) for c, (_, rolls) in spec.items() for n in rolls})


def with_targets(panel: DataFrame, c: str, horizons: Sequence[int] = (1, 3, 24)) -> DataFrame:
    return panel.withColumns({f"target_{c}_t{h}": F.lead(c, h).over(by_zone()) for h in horizons})


def history_columns(panel: DataFrame) -> list[str]:
    return [c for c in panel.columns if "_lag_" in c or "_roll_" in c]


def complete(panel: DataFrame, targets: bool = True) -> DataFrame:
    """Rows with their whole history and, on demand, their last target."""
    return panel.dropna(subset=history_columns(panel) + ([c for c in panel.columns if c.startswith("target_")][-1:] if targets else []))


def with_calendar(panel: DataFrame) -> DataFrame:
    return panel.withColumns(calendar(TIME)).withColumn("hour_block_3h", F.floor(F.col("hour") / 3).cast("int"))


def enriched(panel: DataFrame, weather: DataFrame | None = None, events: DataFrame | None = None, zone_years: DataFrame | None = None, zones: DataFrame | None = None) -> DataFrame:
    """Dimensions joined from the left. They are small and left to the planner's measured broadcast."""
    if zones is not None:
        panel = panel.join(zones.select(ZONE, "borough"), ZONE, "left")
    if weather is not None:
        panel = panel.join(weather, ["date", "hour"], "left")
    if events is not None:
        panel = panel.join(events, ["date", "hour"], "left").fillna(0, ["city_n_events", "city_has_event"])
    if zone_years is not None:
        panel = panel.join(zone_years.dropDuplicates(["year", ZONE]), ["year", ZONE], "left")
    return panel


def tail(panel: DataFrame, n: int = 168) -> DataFrame:
    """The last n rows of each zone: the history that a later run needs."""
    last = F.row_number().over(W.partitionBy(ZONE).orderBy(F.desc(TIME)))
    return panel.withColumn("_n", last).where(F.col("_n") <= n).drop("_n")


def wide(panel: DataFrame, zones: Sequence[int], value: str) -> DataFrame:
    """One row an hour, one column a zone. The zones are given, so no pass is spent on finding them."""
    return panel.groupBy(TIME).pivot(ZONE, list(zones)).agg(F.first(value)).select(TIME, *[F.col(str(z)).alias(f"z{z}_{value}") for z in zones])


def busiest(panel: DataFrame, value: str = "n_trips") -> DataFrame:
    """The zone with the most at each hour (of equals the smallest id), and how many have as many."""
    most = panel.groupBy(TIME).agg(F.max(value).alias("most"), F.min_by(ZONE, F.struct(-F.col(value), F.col(ZONE))).alias("zone"))
    ties = panel.join(most, TIME).where(F.col(value) == F.col("most")).groupBy(TIME).agg(F.count("*").alias("n_tied"))
    return most.join(ties, TIME)
