"""Queries around models: features, choices, errors and classes that SQL can check, and models whose rows are checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import dimensions as D
from ..operators import learning as L
from ..operators import panel as P
from ..operators import stress as S
from ..session import durable
from .adapters import TRIPS_LI, WEATHER, Catalogue, rounded, table, trips_li, weather
from .learning_queries import NUMBERS, _stress
from .panel_queries import BASELINE, GRID, Z, _baselines, _panel

query = Catalogue()


@query("SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2) THEN 0.0 ELSE value END AS a, CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE CAST(user_id AS DOUBLE) END AS b FROM events")
def finite_features(spark, sf):
    k = F.col("event_id") % 7
    bad = F.when(k == 0, F.lit(None)).when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    ev = table(spark, sf, "events").select("event_id", bad.alias("a"), F.when(F.col("event_id") % 2 != 0, F.col("user_id")).alias("b"))
    return L.finite(ev, ["a", "b"])


@query("SELECT * FROM (VALUES ('user_id', 'number'), ('value', 'number'), ('event_type', 'category'), ('late', 'category')) t(name, kind)")
def inferred_features(spark, sf):
    ev = table(spark, sf, "events").withColumns({"timestamp_hour": F.col("ts"), "target_value_t1": F.col("value"), "is_stress_t3": F.lit(1), "late": F.col("value") > 1, "split": F.lit("train")})
    numbers, categories = L.feature_columns(ev, drop=["event_id", "props"])
    return spark.createDataFrame([(n, "number") for n in numbers] + [(c, "category") for c in categories], "name string, kind string")


@query("SELECT * FROM (VALUES (2, 0.1), (4, 0.1), (6, 0.3)) t(depth, rate)".replace("0.1)", "CAST(0.1 AS DOUBLE))").replace("0.3)", "CAST(0.3 AS DOUBLE))"))
def grid_points(spark, sf):
    """Three of six, evenly spaced."""
    found = L.grid({"depth": [2, 4, 6], "rate": [0.1, 0.3]}, 3)
    return spark.createDataFrame([(g["depth"], g["rate"]) for g in found], "depth int, rate double")


PREDS = ("pred_persistence", "pred_zone_hour_weekend", "pred_global")
LONG = "l AS (" + " UNION ALL ".join(f"SELECT split, timestamp_hour, t1 AS y, '{m}' AS model, {m} AS p FROM preds WHERE t1 IS NOT NULL" for m in PREDS) + ")"


@query(f"WITH {BASELINE}, {LONG}, r AS (SELECT split, model, sqrt(avg((y - p) * (y - p))) AS e FROM l GROUP BY 1, 2), w AS (SELECT model, max(e) FILTER (split = 'train') AS train, max(e) FILTER (split = 'val') AS val, max(e) FILTER (split = 'test') AS test FROM r GROUP BY 1) SELECT model, round(train, 4) AS train, round(val, 4) AS val, round(test, 4) AS test, round(val - train, 4) AS val_gap, round(test - train, 4) AS test_gap FROM w")
def overfit_gaps(spark, sf):
    reports = S.regression_metrics(_baselines(spark, sf), "target_stress_t1", PREDS, ["split"])
    return rounded(S.overfit_gaps(reports))


@query(f"WITH {BASELINE}, tv AS (SELECT * FROM preds WHERE split = 'train' UNION ALL SELECT * FROM preds WHERE split = 'val') SELECT pu_location_id, count(*) AS n, round(avg(t1), 4) AS mean_target FROM tv WHERE t1 IS NOT NULL GROUP BY 1")
def train_and_val(spark, sf):
    p = _baselines(spark, sf).where("target_stress_t1 is not null")
    both = p.where("split = 'train'").unionByName(p.where("split = 'val'"))
    return rounded(both.groupBy("pu_location_id").agg(F.count("*").alias("n"), F.avg("target_stress_t1").alias("mean_target")))


@query(f"WITH {BASELINE} SELECT timestamp_hour, round(avg(t1 - pred_zone_hour_weekend), 4) AS residual FROM preds WHERE split = 'test' AND t1 IS NOT NULL GROUP BY 1")
def residuals_by_hour(spark, sf):
    p = _baselines(spark, sf).where("split = 'test' and target_stress_t1 is not null")
    return rounded(A.residuals(p, "target_stress_t1", "pred_zone_hour_weekend", ["timestamp_hour"]))


@query(f"WITH {BASELINE}, q AS (SELECT quantile_cont(t1, 0.9) AS c FROM preds WHERE split = 'train'), k AS (SELECT split, CAST(t1 >= c AS INT) AS y, CAST(pred_zone_hour_weekend >= c AS INT) AS p FROM preds, q WHERE t1 IS NOT NULL), mm AS (SELECT split, count(*) AS n, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn FROM k GROUP BY 1) SELECT split, n, tp, fp, fn, round((n - fp - fn) / n, 4) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM mm")
def baseline_classes(spark, sf):
    p = S.top_classes(_baselines(spark, sf), "target_stress_t1", ["pred_zone_hour_weekend"])
    return rounded(S.class_metrics(p, "is_top_target_stress_t1", "is_top_pred_zone_hour_weekend", ["split"]))


_SHARES = (0.0, 0.25, 0.5, 0.75, 1.0)


@query(f"WITH {BASELINE}, g AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS share), e AS (SELECT share, split, sqrt(avg((t1 - (share * pred_persistence + (1 - share) * pred_zone_hour_weekend)) ** 2)) AS rmse FROM preds, g WHERE t1 IS NOT NULL AND split IN ('val', 'test') GROUP BY 1, 2), b AS (SELECT share FROM e WHERE split = 'val' ORDER BY round(rmse, 6), share LIMIT 1) SELECT CAST(share AS DOUBLE) AS share, round(max(rmse) FILTER (split = 'val'), 4) AS val, round(max(rmse) FILTER (split = 'test'), 4) AS test FROM e SEMI JOIN b USING (share) GROUP BY 1")
def grid_choice(spark, sf):
    """Of five mixtures of two baselines that with the smallest error on validation; its test error is looked at once."""
    p = _baselines(spark, sf).withColumns({f"m_{s}": s * F.col("pred_persistence") + (1 - s) * F.col("pred_zone_hour_weekend") for s in _SHARES})
    reports = durable(S.regression_metrics(p.where("split in ('val', 'test')"), "target_stress_t1", [f"`m_{s}`" for s in _SHARES], ["split"]))
    best = S.best_model(reports.where("split = 'val'").withColumn("rmse", F.round("rmse", 6))).select("model")
    wide = reports.join(F.broadcast(best), "model").groupBy("model").pivot("split", ["val", "test"]).agg(F.first("rmse"))  # one row
    return rounded(wide.select(F.regexp_replace("model", "[m_`]", "").cast("double").alias("share"), "val", "test"))


WINNERS = f"""{GRID}, m AS (SELECT timestamp_hour, max(n_trips) AS most, CAST(sum(n_trips) AS BIGINT) AS all_n_trips FROM panel GROUP BY 1), best AS (SELECT p.timestamp_hour, most, all_n_trips, min(pu_location_id) AS zone, count(*) AS n_tied FROM panel p JOIN m ON p.timestamp_hour = m.timestamp_hour AND n_trips = most GROUP BY 1, 2, 3)"""


@query(f"WITH {WINNERS} SELECT b.*, " + ", ".join(f"max(n_trips) FILTER (pu_location_id = {z}) AS z{z}_n_trips" for z in range(1, 9)) + " FROM best b JOIN panel p ON b.timestamp_hour = p.timestamp_hour GROUP BY ALL")
def hourly_samples(spark, sf):
    return D.hourly_samples(durable(_panel(spark, sf)), range(1, 9))


@query(f"WITH {WINNERS}, w AS (SELECT DISTINCT zone FROM best WHERE timestamp_hour < '2024-01-01 06:00:00') SELECT pu_location_id, timestamp_hour, n_trips FROM panel SEMI JOIN w ON pu_location_id = zone")
def winner_scope(spark, sf):
    panel = durable(_panel(spark, sf))
    early = D.hourly_samples(panel.where("timestamp_hour < timestamp_ntz'2024-01-01 06:00:00'"), range(1, 9))
    return D.scoped(panel, D.winner_zones(early))


# A probability for each zone: how often it had the most at that hour of the day before the 22nd.
CHANCES = f"""{WINNERS}, tr AS (SELECT hour(timestamp_hour) AS h, zone, count(*) AS n FROM best WHERE timestamp_hour < '2024-01-22' GROUP BY 1, 2), zs AS (SELECT DISTINCT pu_location_id AS label FROM panel), te AS (SELECT timestamp_hour, zone AS truth, hour(timestamp_hour) AS h FROM best WHERE timestamp_hour >= '2024-01-22'), chances AS (
  SELECT te.timestamp_hour, truth, label, coalesce(n, 0) AS p, row_number() OVER (PARTITION BY te.timestamp_hour ORDER BY coalesce(n, 0) DESC, label) AS k FROM te CROSS JOIN zs LEFT JOIN tr ON tr.h = te.h AND tr.zone = label)"""


def _chances(spark, sf):
    panel = durable(_panel(spark, sf))
    best = durable(P.busiest(panel).withColumn("h", F.hour("timestamp_hour")))
    train = best.where("timestamp_hour < timestamp_ntz'2024-01-22 00:00:00'").groupBy("h", F.col("zone").alias("label")).agg(F.count("*").alias("n"))
    later = best.where("timestamp_hour >= timestamp_ntz'2024-01-22 00:00:00'").select("timestamp_hour", "h", F.col("zone").alias("truth"))
    every = later.crossJoin(F.broadcast(panel.select(F.col("pu_location_id").alias("label")).distinct()))  # the zones
    return every.join(train, ["h", "label"], "left").select("timestamp_hour", "truth", "label", F.coalesce("n", F.lit(0)).alias("p"))


@query(f"WITH {CHANCES}, o AS (SELECT timestamp_hour, min(k) FILTER (label = truth) AS place FROM chances GROUP BY 1) SELECT count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN place <= {k} THEN 1 ELSE 0 END), 4) AS top_{k}" for k in (1, 3, 5)) + " FROM o")
def zone_top_k(spark, sf):
    return rounded(L.ranked_hits(_chances(spark, sf), "timestamp_hour", "label", "truth"))


@query(f"WITH {CHANCES}, c AS (SELECT truth, label AS prediction, count(*) AS n FROM chances WHERE k = 1 GROUP BY 1, 2) SELECT truth, prediction, n, round(n / sum(n) OVER (PARTITION BY truth), 4) AS share FROM c")
def zone_confusion(spark, sf):
    c = _chances(spark, sf)
    guess = c.groupBy("timestamp_hour", "truth").agg(F.max_by("label", F.struct("p", -F.col("label"))).alias("prediction"))
    return rounded(L.confusion(guess, "truth", "prediction"))


@query(f"WITH {WEATHER}, w AS (SELECT *, CAST(month(date) AS INT) AS month FROM weather) SELECT month, round(min(temp_c), 4) AS least, round(quantile_cont(temp_c, 0.25), 4) AS q1, round(quantile_cont(temp_c, 0.5), 4) AS median, round(quantile_cont(temp_c, 0.75), 4) AS q3, round(max(temp_c), 4) AS most, round(avg(temp_c), 4) AS mean FROM w GROUP BY 1")
def weather_months(spark, sf):
    return rounded(A.box(weather(spark, sf).withColumn("month", F.month("date")), ["month"], "temp_c"))


@query(f"WITH {TRIPS_LI}, s AS (SELECT year, avg(tip_amount) AS t FROM trips GROUP BY year, pu_location_id), m AS (SELECT year, CASE WHEN max(t) OVER y = min(t) OVER y THEN 0.5 ELSE (t - min(t) OVER y) / (max(t) OVER y - min(t) OVER y) END AS x FROM s WINDOW y AS (PARTITION BY year)) SELECT CASE WHEN x <= 0.2 THEN 'low' WHEN x <= 0.4 THEN 'medium_low' WHEN x <= 0.6 THEN 'medium' WHEN x <= 0.8 THEN 'medium_high' ELSE 'high' END AS label, count(*) AS n FROM m GROUP BY 1")
def label_distribution(spark, sf):
    from ..functions.columns import five_levels
    from ..operators.indices import min_max

    zones = trips_li(spark, sf).groupBy("year", "pu_location_id").agg(F.avg("tip_amount").alias("t"))
    return zones.select(five_levels(min_max("t")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


# Models: their rows are checked.


@query()
def gbt_refit(spark, sf):
    """Train alone, then train and validation together: errors by split, what they lose beyond training, and the first importances."""
    p = _stress(spark, sf)
    out = []
    for name, known in (("train", p.where("split = 'train'")), ("train_val", p.where("split in ('train', 'val')"))):
        model = L.fit(known, L.gradient_boosting("target_stress_t1"), "target_stress_t1", NUMBERS)
        reports = S.regression_metrics(L.predict(model, p, NUMBERS).withColumnRenamed("prediction", name), "target_stress_t1", [name], ["split"])
        first = L.importances(model, NUMBERS)[0]
        out.append(S.overfit_gaps(reports).withColumns({"first_feature": F.lit(first[0]), "first_importance": F.lit(first[1])}))
    return out[0].unionByName(out[1])


@query()
def stress_classifiers(spark, sf):
    """Boosted trees with weights against class frequency, and a network, on the class of the next hour."""
    p = _stress(spark, sf).where("is_stress_t1 is not null")
    train, later = durable(L.balanced(p.where("split = 'train'"), "is_stress_t1")), p.where("split <> 'train'")
    boosted = L.predict(L.fit(train, L.boosted_classifier("is_stress_t1"), "is_stress_t1", NUMBERS), later, NUMBERS)
    net = L.predict(L.network(train, "is_stress_t1", NUMBERS, ["borough"] if "borough" in p.columns else []), later, NUMBERS)
    report = lambda df, name: S.class_metrics(df, "is_stress_t1", "prediction", ["split"]).withColumn("model", F.lit(name))
    return report(boosted, "boosted").unionByName(report(net, "network"))


@query()
def forest_importance(spark, sf):
    """How much the error rises when a feature's values are dealt anew."""
    p = _stress(spark, sf)
    model = L.fit(p.where("split = 'train'"), L.random_forest("target_stress_t1"), "target_stress_t1", NUMBERS)
    return L.permutation_importance(model, p.where("split = 'test'"), "target_stress_t1", NUMBERS, NUMBERS[:6])


@query()
def tip_models(spark, sf):
    """For the last quarters of two years: median, elastic net, forest and boosted trees; chosen by the error on validation."""
    numbers, out = ("fare_amount", "trip_distance", "passenger_count", "hour", "day_of_week"), None
    for year in (1996, 1997):
        t = trips_li(spark, sf).where((F.col("year") == year) & (F.col("month") >= 10) & (F.col("fare_amount") > 0))
        day = F.dayofmonth("pickup_datetime")
        t = durable(t.withColumn("split", F.when(F.col("month") < 12, "train").when(day <= 15, "val").otherwise("test")).select(*numbers, "tip_amount", "split"))
        train = t.where("split = 'train'")
        found = t.crossJoin(F.broadcast(train.agg(F.percentile("tip_amount", F.lit(0.5)).alias("median"))))  # one row
        for name, estimator in L.tip_models("tip_amount").items():
            found = L.predict(L.fit(train, estimator, "tip_amount", numbers), found, numbers).withColumnRenamed("prediction", name).drop("features")
        reports = durable(S.regression_metrics(found, "tip_amount", ["median", "elastic_net", "random_forest", "gradient_boosting"], ["split"]))
        chosen = S.best_model(reports.where("split = 'val'"), "mae").select("model")
        mine = reports.join(F.broadcast(chosen.withColumn("chosen", F.lit(True))), "model", "left").withColumns({"chosen": F.coalesce("chosen", F.lit(False)), "year": F.lit(year)})  # one row
        out = mine if out is None else out.unionByName(mine)
    return out
