"""Queries of the map, the forecast and the dashboard, over the slots of the stress panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import serving as V
from ..session import durable
from .adapters import Catalogue, rounded
from .panel_queries import SLOTS, slot_panel

query = Catalogue()

# Scores are cut to digits before anything compares them: both engines then see the same ties.
SCORES = f"""{SLOTS}, q AS (SELECT quantile_cont(stress_score_mean, 0.05) AS a, quantile_cont(stress_score_mean, 0.95) AS b FROM slots), scores AS (
  SELECT pu_location_id AS zone, day_of_week, hour, round(least(1, greatest(0, (stress_score_mean - a) / (b - a))), 4) AS score FROM slots, q)"""


def _scores(spark, sf):
    slots = slot_panel(spark, sf).select(F.col("pu_location_id").alias("zone"), "day_of_week", "hour", F.col("stress_score_mean").alias("raw"))
    return durable(rounded(V.calibrated(slots).drop("raw")))


LEVEL = "CASE WHEN score IS NULL THEN NULL WHEN score <= 0.33 THEN 'low' WHEN score <= 0.66 THEN 'medium' ELSE 'high' END AS level"


@query(f"WITH {SLOTS} SELECT pu_location_id, hour, day_of_week, round(quantile_cont(n_trips_mean, 0.5), 4) AS n_trips_mean, round(quantile_cont(stress_rate, 0.5), 4) AS stress_rate FROM slots GROUP BY 1, 2, 3")
def web_features_median(spark, sf):
    return rounded(V.median_features(slot_panel(spark, sf), ["pu_location_id", "hour", "day_of_week"], ["n_trips_mean", "stress_rate"]))


@query(f"WITH {SCORES} SELECT * FROM scores")
def calibrated_scores(spark, sf):
    return _scores(spark, sf)


@query(f"WITH {SCORES} SELECT zone, day_of_week, hour, score, {LEVEL} FROM scores WHERE day_of_week = 2 AND hour = 8")
def serve_map(spark, sf):
    return V.zone_map(_scores(spark, sf), 2, 8)


@query(f"WITH {SCORES} SELECT zone, day_of_week, hour, score, {LEVEL} FROM scores WHERE hour = 8")
def serve_map_fallback(spark, sf):
    return V.zone_map(_scores(spark, sf).where("day_of_week <> 2"), 2, 8).unionByName(V.zone_map(_scores(spark, sf).where("hour = 8"), 2, 8))


@query(f"WITH {SCORES}, r(zone, day_of_week, hour) AS (VALUES (1, 2, 8), (3, 9, 8), (5, 2, 30), (77, 1, 4), (77, 1, 99)), c AS (SELECT r.zone, r.day_of_week, r.hour, CASE WHEN r.zone = s.zone AND r.hour = s.hour AND r.day_of_week = s.day_of_week THEN 0 WHEN r.zone = s.zone AND r.hour = s.hour THEN 1 WHEN r.zone = s.zone THEN 2 WHEN s.zone IS NOT NULL THEN 3 END AS match, s.score, row_number() OVER (PARTITION BY r.zone, r.day_of_week, r.hour ORDER BY CASE WHEN r.zone = s.zone AND r.hour = s.hour AND r.day_of_week = s.day_of_week THEN 0 WHEN r.zone = s.zone AND r.hour = s.hour THEN 1 WHEN r.zone = s.zone THEN 2 ELSE 3 END, s.zone, s.day_of_week, s.hour) AS k FROM r LEFT JOIN scores s ON r.zone = s.zone OR r.hour = s.hour) SELECT zone, day_of_week, hour, match, score, {LEVEL} FROM c WHERE k = 1")
def serve_predict(spark, sf):
    asked = spark.createDataFrame([(1, 2, 8), (3, 9, 8), (5, 2, 30), (77, 1, 4), (77, 1, 99)], "zone int, day_of_week int, hour int")
    return V.predictions(_scores(spark, sf), asked)


AHEAD = f"{SCORES}, slots_ahead AS (SELECT z.zone, o AS hour_offset, (23 + o) % 24 AS hour, CAST((7 - 1 + floor((23 + o) / 24)) % 7 + 1 AS INT) AS day_of_week FROM (VALUES (1), (4)) z(zone), (VALUES (0), (2), (4), (6), (12), (24)) t(o)), f AS (SELECT slots_ahead.*, score FROM slots_ahead LEFT JOIN scores USING (zone, day_of_week, hour))"


@query(f"WITH {AHEAD} SELECT zone, day_of_week, hour, hour_offset, 0 AS match, score, {LEVEL} FROM f")
def serve_forecast(spark, sf):
    return V.forecast(_scores(spark, sf), [1, 4], 7, 23)


@query(f"WITH {AHEAD}, b AS (SELECT zone, hour_offset FROM f QUALIFY row_number() OVER (PARTITION BY zone ORDER BY score DESC, hour_offset) = 1) SELECT zone, max(b.hour_offset) AS peak_offset, max(score) AS peak_score, round(avg(score), 4) AS mean_score FROM f JOIN b USING (zone) GROUP BY 1")
def forecast_summary(spark, sf):
    return rounded(V.forecast_summary(V.forecast(_scores(spark, sf), [1, 4], 7, 23)))


@query(f"WITH {SCORES}, shown AS (SELECT * FROM scores WHERE day_of_week = 2 AND hour = 8) SELECT count(*) AS n_zones, count(*) FILTER (score > 0.8) AS n_critical, count(*) FILTER (score <= 0.2) AS n_stable, round(count(*) FILTER (score > 0.8) * 100 / count(*), 4) AS percent_critical, round(avg(score), 4) AS mean_score, round(avg(score) FILTER (score > 0.8), 4) AS mean_critical, (SELECT zone FROM shown ORDER BY score DESC, zone LIMIT 1) AS max_zone, (SELECT zone FROM shown ORDER BY score, zone LIMIT 1) AS min_zone FROM shown")
def kpi_cards(spark, sf):
    return rounded(V.kpis(V.zone_map(_scores(spark, sf), 2, 8)))


FIVE = "CASE WHEN score IS NULL THEN 'no_data' WHEN score <= 0.2 THEN 'low' WHEN score <= 0.4 THEN 'medium_low' WHEN score <= 0.6 THEN 'medium' WHEN score <= 0.8 THEN 'medium_high' ELSE 'high' END AS level"


@query(f"WITH {SCORES} SELECT zone, day_of_week, hour, score, {FIVE} FROM scores WHERE day_of_week = 2 AND hour = 8 ORDER BY score DESC, zone LIMIT 4")
def alerts(spark, sf):
    return V.alerts(V.zone_map(_scores(spark, sf), 2, 8).drop("level"))


@query(f"WITH {SCORES}, shown AS (SELECT * FROM scores WHERE day_of_week = 2 AND hour = 8), w AS (SELECT 'worst' AS side, zone, score FROM shown ORDER BY score DESC, zone LIMIT 5), b AS (SELECT 'best' AS side, zone, score FROM shown ORDER BY score, zone LIMIT 5) SELECT * FROM w UNION ALL SELECT * FROM b")
def best_and_worst(spark, sf):
    return V.best_and_worst(V.zone_map(_scores(spark, sf), 2, 8))


@query(f"WITH {SCORES}, h AS (SELECT hour, round(avg(score), 6) AS m FROM scores GROUP BY 1) SELECT (SELECT hour FROM h ORDER BY m, hour LIMIT 1) AS best_hour, (SELECT hour FROM h ORDER BY m DESC, hour LIMIT 1) AS worst_hour")
def hour_extremes(spark, sf):
    return V.hour_extremes(_scores(spark, sf))


@query(f"WITH {SCORES}, h AS (SELECT hour, round(avg(score), 3) AS mean_score FROM scores WHERE day_of_week = 2 AND hour IN (8, 10, 12, 14, 16, 18) GROUP BY 1), d AS (SELECT (SELECT mean_score FROM h ORDER BY hour DESC LIMIT 1) - (SELECT mean_score FROM h ORDER BY hour LIMIT 1) AS d) SELECT hour, mean_score, CASE WHEN abs(d) <= 0.02 THEN 'stable' WHEN d > 0 THEN 'rising' ELSE 'falling' END AS trend FROM h, d")
def day_profile(spark, sf):
    return V.day_profile(_scores(spark, sf), 2)


@query(f"WITH {SCORES}, l AS (SELECT hour, {FIVE} FROM scores) SELECT hour, " + ", ".join(f"count(*) FILTER (level = '{x}') AS {x}" for x in ("low", "medium_low", "medium", "medium_high", "high")) + " FROM l GROUP BY 1")
def hour_levels(spark, sf):
    from ..operators.aggregates import crosstab

    return crosstab(_scores(spark, sf).withColumn("level", C.five_levels("score")), "hour", "level", ["low", "medium_low", "medium", "medium_high", "high"])
