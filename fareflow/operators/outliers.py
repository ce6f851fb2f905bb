"""Outliers against context: quantiles of (zone, hour, weekend), else zone, else hour, else all, within a service's month."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..session import durable

QUANTILES = (0.01, 0.05, 0.95, 0.99)
VARIABLES = ("trip_duration_min", "trip_distance", "total_amount_std", "price_per_mile")
#: Thresholds belong to one service, year and month, whatever their scope.
KEYS = ("service_type", "year", "month")
SCOPES = {"primary": (*KEYS, "pu_location_id", "hour", "is_weekend"), "zone": (*KEYS, "pu_location_id"), "hour": (*KEYS, "hour"), "all": KEYS}


def quantiles(value: str, least: int, accuracy: int | None = None) -> Column:
    """The four quantiles, to six decimals (so that a value isn't beyond a threshold by the last bit of an interpolation); null for fewer
    values than least. accuracy: approximate ones, for groups too large to hold."""
    points = F.array(*[F.lit(q) for q in QUANTILES])
    found = F.percentile(value, points) if accuracy is None else F.percentile_approx(F.col(value), points, accuracy)
    return F.when(F.count(value) >= least, F.transform(found, lambda q: F.round(q, 6)))


def thresholds(df: DataFrame, scopes: Mapping[str, Sequence[str]], variables: Sequence[str] = VARIABLES, least: int = 30, accuracy: int | None = None, every: bool = True) -> dict[str, DataFrame]:
    """By scope: its keys, n_<variable> and q_<variable>; every: also groups that have too few values of all variables.

    The rows are evaluated once. One aggregate counts the values of all scopes; quantiles are then taken only of groups that have
    enough, all others never being gathered.
    """
    keys = list(dict.fromkeys(k for scope in scopes.values() for k in scope))
    measures, counts = [quantiles(v, least, accuracy).alias(f"q_{v}") for v in variables], [F.count(v).alias(f"n_{v}") for v in variables]
    if not keys:
        return {name: df.agg(*counts, *measures) for name in scopes}
    slim = durable(df.select(*keys, *variables))
    enough, out = F.greatest(*[F.col(f"n_{v}") for v in variables], F.lit(0)) >= least, {}
    held = slim.groupingSets([[F.col(k) for k in scope] for scope in scopes.values()], *keys).agg(F.grouping_id().alias("_scope"), *counts)
    held = durable(held if every else held.where(enough))
    for name, scope in scopes.items():
        absent = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in scope)
        mine = held.where(F.col("_scope") == absent).select(*scope, *[f"n_{v}" for v in variables])
        if scope:
            found = slim.join(mine.where(enough).select(*scope), list(scope), "left_semi").groupBy(*scope).agg(*measures)
            out[name] = mine.join(found, list(scope), "left")
        else:
            out[name] = mine.crossJoin(slim.agg(*measures))
    return out


def with_thresholds(df: DataFrame, variables: Sequence[str] = VARIABLES, least: int = 30, accuracy: int | None = None, scopes: Mapping[str, Sequence[str]] = SCOPES) -> DataFrame:
    """df with q_<variable>, the four thresholds of the narrowest scope that has enough values, and scope_<variable>, its name.

    Keys that the table lacks are left out. Scopes are bounded by months, zones, hours and weekend, so their joins are left to the
    planner, which broadcasts what it measures to be small.
    """
    scopes = {name: [k for k in scope if k in df.columns] for name, scope in scopes.items()}
    out = df
    for name, found in thresholds(df, scopes, variables, least, accuracy, every=False).items():
        found = found.select(*scopes[name], *[F.col(f"q_{v}").alias(f"_{name}_{v}") for v in variables])
        out = out.join(found, scopes[name], "left") if scopes[name] else out.crossJoin(F.broadcast(found))  # one row
    out = out.withColumns({f"scope_{v}": F.coalesce(*[F.when(F.col(f"_{n}_{v}").isNotNull(), n) for n in scopes]) for v in variables})
    out = out.withColumns({f"q_{v}": F.coalesce(*[F.col(f"_{n}_{v}") for n in scopes]) for v in variables})
    return out.drop(*[f"_{n}_{v}" for n in scopes for v in variables])


def treat(df: DataFrame, variables: Sequence[str] = VARIABLES) -> DataFrame:
    """Values beyond the outer thresholds become null, those between outer and inner ones are drawn to the inner; ratios are then
    worked out anew. <variable>_action says what happened."""
    plain = [v for v in variables if v != "price_per_mile"]
    out = df
    for v in plain:
        x, q = F.col(v), F.col(f"q_{v}")
        extreme, moderate = (x < q[0]) | (x > q[3]), (x < q[1]) | (x > q[2])
        action = F.when(extreme, "removed").when(moderate, "clamped").otherwise("kept")
        out = out.withColumn(f"{v}_action", action).withColumn(v, F.when(extreme, None).when(moderate, F.least(F.greatest(x, q[1]), q[2])).otherwise(x))
    return out.withColumns({"tip_pct": ratio("tip_amount", "fare_amount"), "price_per_mile": ratio("total_amount_std", "trip_distance")})


def actions(treated: DataFrame, variables: Sequence[str]) -> DataFrame:
    """variable, scope, n_removed, n_clamped: what treat did, by the scope whose thresholds it went by."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"scope_{v}").alias("scope"), F.col(f"{v}_action").alias("action")) for v in variables]))
    return treated.select(each.alias("e")).groupBy("e.variable", "e.scope").agg(F.count_if(F.col("e.action") == "removed").alias("n_removed"), F.count_if(F.col("e.action") == "clamped").alias("n_clamped"))
