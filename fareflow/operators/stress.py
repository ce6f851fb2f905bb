"""Stress of a zone-hour: demand and price variability against the training period, with labels that never look ahead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import at_hour
from ..session import durable
from .panel import TIME, ZONE

HORIZONS = (1, 3, 24)


def base(trips: DataFrame, price: str = "total_amount_std", valid: Column | None = None, accuracy: int | None = None) -> DataFrame:
    """By zone and hour: trips, mean price and interquartile range of valid prices above 0 (0 where there is none)."""
    ok = F.col(price) > 0 if valid is None else valid & (F.col(price) > 0)
    x, points = F.when(ok, F.col(price)), F.array(F.lit(0.25), F.lit(0.75))
    q = F.percentile(x, points) if accuracy is None else F.percentile_approx(x, points, accuracy)
    found = trips.groupBy(ZONE, at_hour("date", "hour").alias(TIME)).agg(F.count("*").alias("n_trips"), F.coalesce(F.avg(x), F.lit(0.0)).alias("avg_price"), q.alias("_q"))
    return found.withColumn("price_variability", F.greatest(F.lit(0.0), F.coalesce(F.col("_q")[1] - F.col("_q")[0], F.lit(0.0)))).drop("_q")


def split_bounds(panel: DataFrame, train: float = 0.7, val: float = 0.15, gap: int = 0) -> DataFrame:
    """One row: the last hour of training and of validation, and the first hours of validation and test, over distinct hours.
    Counts are cut off to whole hours; gap hours before validation and before test belong to none."""
    hours = panel.select(TIME).distinct().withColumn("n", F.row_number().over(W.orderBy(TIME)))
    total = F.max("n")
    n_train, n_val = F.floor(total * train), F.floor(total * val)
    cut = hours.agg(n_train.alias("a"), n_val.alias("b"))
    at = hours.crossJoin(F.broadcast(cut))  # one row
    return at.agg(
        F.max(F.when(F.col("n") <= F.col("a"), F.col(TIME))).alias("train_end"),
        F.min(F.when(F.col("n") > F.col("a") + gap, F.col(TIME))).alias("val_start"),
        F.max(F.when((F.col("n") > F.col("a") + gap) & (F.col("n") <= F.col("a") + gap + F.col("b")), F.col(TIME))).alias("val_end"),
        F.min(F.when(F.col("n") > F.col("a") + F.col("b") + 2 * gap, F.col(TIME))).alias("test_start"),
    )


def with_split(panel: DataFrame, bounds: DataFrame) -> DataFrame:
    """split: train, val, test, or gap."""
    t = F.col(TIME)
    out = panel.crossJoin(F.broadcast(bounds))  # one row
    split = F.when(t <= F.col("train_end"), "train").when((t >= F.col("val_start")) & (t <= F.col("val_end")), "val").when(t >= F.col("test_start"), "test").otherwise("gap")
    return out.withColumn("split", split).drop(*bounds.columns)


def scored(panel: DataFrame, train_end: DataFrame) -> DataFrame:
    """stress_score: the z-scores of ln(1 + trips) and of price variability, by the training period's mean and population
    deviation (1 where that isn't positive)."""
    out = panel.withColumn("_l", F.log1p("n_trips")).crossJoin(F.broadcast(train_end.select("train_end")))  # one row
    known = F.col(TIME) <= F.col("train_end")
    m = out.agg(*[f(F.when(known, F.col(c))).alias(n + c) for c in ("_l", "price_variability") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = out.crossJoin(F.broadcast(m))  # one row

    def z(c: str) -> Column:
        return (F.col(c) - F.col(f"m{c}")) / F.when(F.col(f"s{c}") > 0, F.col(f"s{c}")).otherwise(1.0)

    return out.withColumn("stress_score", z("_l") + z("price_variability")).drop("_l", "train_end", *m.columns)


def labelled(panel: DataFrame, train_end: DataFrame, quantile: float = 0.9, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """is_stress_now and is_stress_t<h> by thresholds of the training period, whose targets must lie in it as well."""
    by = W.partitionBy(ZONE).orderBy(TIME)
    out = panel.withColumns({f"target_stress_t{h}": F.lead("stress_score", h).over(by) for h in horizons}).crossJoin(F.broadcast(train_end.select("train_end")))  # one row
    ahead = {"now": ("stress_score", 0)} | {f"t{h}": (f"target_stress_t{h}", h) for h in horizons}
    known = {n: F.col(TIME) + F.expr(f"interval {h} hours") <= F.col("train_end") for n, (_, h) in ahead.items()}
    limits = out.agg(*[F.percentile(F.when(known[n], F.col(c)), F.lit(quantile)).alias(f"_{n}") for n, (c, _) in ahead.items()])
    out = out.crossJoin(F.broadcast(limits))  # one row
    return out.withColumns({f"is_stress_{n}": (F.col(c) >= F.col(f"_{n}")).cast("int") for n, (c, _) in ahead.items()}).drop("train_end", *limits.columns)


def slots(panel: DataFrame) -> DataFrame:
    """By zone, day of the week and hour: means, ninth deciles and rates; with borough, weather and events as far as the panel has them."""
    keys = [ZONE, *[c for c in ("borough",) if c in panel.columns], "day_of_week", "hour", *[c for c in ("hour_block_3h",) if c in panel.columns]]
    deciles = {c: F.percentile(c, F.lit(0.9)).alias(f"{c}_p90") for c in ("stress_score", "n_trips", "price_variability")}
    means = [F.avg(c).alias(f"{c}_mean") for c in ("stress_score", "n_trips", "price_variability", "avg_price", "temp_c", "precip_mm", "city_n_events") if c in panel.columns]
    means += [F.avg(F.col("city_has_event").cast("double")).alias("city_has_event_rate")] if "city_has_event" in panel.columns else []
    return panel.groupBy(*keys).agg(F.count("*").alias("n_obs"), F.avg(F.col("is_stress_now").cast("double")).alias("stress_rate"), *means, *deciles.values())


def baselines(panel: DataFrame, target: str = "target_stress_t1") -> DataFrame:
    """Predictions without a model: the score now; the training mean of zone, hour and weekend, else of borough, hour and weekend,
    else of the hour, else of all; and the training mean of all. Needs split and borough."""
    train = panel.where((F.col("split") == "train") & F.col(target).isNotNull())
    out = panel.withColumn("pred_persistence", F.col("stress_score"))
    scopes = {"zone": [ZONE, "hour", "is_weekend"], "borough": ["borough", "hour", "is_weekend"], "hour": ["hour"]}
    for name, keys in scopes.items():
        out = out.join(train.groupBy(*keys).agg(F.avg(target).alias(f"_{name}")), keys, "left")
    out = out.crossJoin(F.broadcast(train.agg(F.avg(target).alias("pred_global"))))  # one row
    return out.withColumn("pred_zone_hour_weekend", F.coalesce(*[f"_{n}" for n in scopes], "pred_global")).drop(*[f"_{n}" for n in scopes])


def regression_metrics(df: DataFrame, truth: str, predictions: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """model, n, mae, rmse, r2, one row a prediction column; all from one pass over the rows."""
    long = df.where(F.col(truth).isNotNull()).select(*by, F.col(truth).alias("y"), F.explode(F.array(*[F.struct(F.lit(p).alias("model"), F.col(p).alias("p")) for p in predictions])).alias("m")).select(*by, "y", "m.*").where("p is not null")
    e = F.col("y") - F.col("p")
    sums = long.groupBy(*by, "model").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("_se"), F.var_pop("y").alias("_v"))
    return sums.withColumn("r2", F.when(F.col("_v") > 0, 1 - F.col("_se") / (F.col("n") * F.col("_v")))).drop("_se", "_v")


def class_metrics(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall and f1 of 0/1 columns; 0 where one isn't defined."""
    y, p = F.col(truth) == 1, F.col(predicted) == 1
    counts = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    zero = F.lit(0.0)
    out = counts.withColumns({"accuracy": F.coalesce((F.col("n") - F.col("fp") - F.col("fn")) / F.nullif(F.col("n"), F.lit(0)), zero), "precision": F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), zero), "recall": F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), zero)})
    return out.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), zero), zero))


def top_classes(df: DataFrame, target: str, predictions: Sequence[str], quantile: float = 0.9) -> DataFrame:
    """df with is_top_<column> of target and predictions: whether it reaches the target's quantile among training rows. Needs split."""
    limit = df.where(F.col("split") == "train").agg(F.percentile(target, F.lit(quantile)).alias("_limit"))
    out = df.crossJoin(F.broadcast(limit))  # one row
    return out.withColumns({f"is_top_{c}": (F.col(c) >= F.col("_limit")).cast("int") for c in (target, *predictions)}).drop("_limit")


def overfit_gaps(reports: DataFrame, metric: str = "rmse") -> DataFrame:
    """model, its metric on train, val and test, and by how much the later parts are worse than training."""
    wide = reports.groupBy("model").pivot("split", ["train", "val", "test"]).agg(F.first(metric))
    return wide.withColumns({f"{s}_gap": F.col(s) - F.col("train") for s in ("val", "test")})


def best_model(reports: DataFrame, metric: str = "rmse", by: Sequence[str] = ()) -> DataFrame:
    """The model with the smallest metric (of equals the first by name): choose on validation, report test once."""
    return reports.groupBy(*by).agg(F.min_by("model", F.struct(metric, "model")).alias("model"), F.min(metric).alias(metric))


def row_split(panel: DataFrame, order: Sequence[str], train: float = 0.7, val: float = 0.15) -> DataFrame:
    """split by place in a total order instead of by hours: an hour can straddle two parts. Ranks come from counts of sorted ranges, so
    no task holds all rows."""
    parts = durable(panel.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    n = F.count("*")
    before = F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    ranges = parts.groupBy("_p").agg(n.alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    total = ranges.agg(F.sum("_n").alias("_all"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("_p").orderBy(*order))
    split = F.when(place <= F.floor(F.col("_all") * train), "train").when(place <= F.floor(F.col("_all") * train) + F.floor(F.col("_all") * val), "val").otherwise("test")
    return parts.join(F.broadcast(ranges), "_p").crossJoin(F.broadcast(total)).withColumn("split", split).drop("_p", "_n", "_before", "_all")  # a row a range; one row
