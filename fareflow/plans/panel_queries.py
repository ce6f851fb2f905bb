"""Queries over hourly panels: demand, stress, baselines, patterns and indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import indices as I
from ..operators import panel as P
from ..operators import stress as S
from ..session import durable
from .adapters import CITY_EVENTS, RENT, RESTAURANTS, TRIPS_EV, TRIPS_LI, WEATHER, ZONES_EV, Catalogue, city_events, rent, restaurants, rounded, trips_ev, trips_li, weather, zones_ev

query = Catalogue()

GRID = f"""{TRIPS_EV}, cells AS (SELECT pu_location_id, date + to_hours(hour) AS timestamp_hour, count(*) AS n_trips FROM trips GROUP BY ALL), grid AS (
  SELECT pu_location_id, timestamp_hour FROM (SELECT DISTINCT pu_location_id FROM cells), (SELECT unnest(generate_series(min(timestamp_hour), max(timestamp_hour), INTERVAL 1 HOUR)) AS timestamp_hour FROM cells)), panel AS (
  SELECT g.*, coalesce(n_trips, 0) AS n_trips FROM grid g LEFT JOIN cells USING (pu_location_id, timestamp_hour))"""
Z = "PARTITION BY pu_location_id ORDER BY timestamp_hour"


def _roll(c: str, n: int) -> str:
    w = f"OVER ({Z} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({c}) {w} = {n} THEN avg({c}) {w} END"


def _panel(spark, sf):
    return P.filled(P.hourly_counts(trips_ev(spark, sf)))


@query(f"WITH {GRID} SELECT * FROM panel")
def hourly_grid(spark, sf):
    return _panel(spark, sf)


DEMAND = f"""{GRID}, feats AS (SELECT *, lag(n_trips, 1) OVER ({Z}) AS n_trips_lag_1, lag(n_trips, 24) OVER ({Z}) AS n_trips_lag_24, lag(n_trips, 168) OVER ({Z}) AS n_trips_lag_168, {_roll("n_trips", 3)} AS n_trips_roll_3, {_roll("n_trips", 24)} AS n_trips_roll_24,
  lead(n_trips, 1) OVER ({Z}) AS target_n_trips_t1, lead(n_trips, 3) OVER ({Z}) AS target_n_trips_t3, lead(n_trips, 24) OVER ({Z}) AS target_n_trips_t24 FROM panel)"""


def _demand(spark, sf):
    return P.with_targets(P.with_history(_panel(spark, sf), {"n_trips": ((1, 24, 168), (3, 24))}), "n_trips")


@query(f"WITH {DEMAND} SELECT pu_location_id, timestamp_hour, n_trips, n_trips_lag_1, n_trips_lag_24, n_trips_lag_168, round(n_trips_roll_3, 4) AS n_trips_roll_3, round(n_trips_roll_24, 4) AS n_trips_roll_24 FROM feats WHERE n_trips_lag_168 IS NOT NULL")
def demand_features(spark, sf):
    p = P.complete(_demand(spark, sf), targets=False)
    return rounded(p.drop(*[c for c in p.columns if c.startswith("target_")]))


@query(f"WITH {DEMAND} SELECT pu_location_id, timestamp_hour, n_trips, target_n_trips_t1, target_n_trips_t3, target_n_trips_t24 FROM feats WHERE target_n_trips_t24 IS NOT NULL")
def demand_targets(spark, sf):
    p = P.with_targets(_panel(spark, sf), "n_trips")
    return p.where("target_n_trips_t24 is not null")


@query(f"""WITH {DEMAND}, {ZONES_EV}, {WEATHER}, {CITY_EVENTS}, e AS (SELECT date, hour, CAST(sum(n_events) AS BIGINT) AS n FROM city_events GROUP BY 1, 2), c AS (
  SELECT *, CAST(timestamp_hour AS DATE) AS date, CAST(hour(timestamp_hour) AS INT) AS hour FROM feats WHERE n_trips_lag_168 IS NOT NULL AND target_n_trips_t24 IS NOT NULL)
SELECT pu_location_id, borough, date, hour, CAST(floor(hour / 3) AS INT) AS hour_block_3h, n_trips, round(temp_c, 4) AS temp_c, precip_mm, coalesce(n, 0) AS city_n_events, CASE WHEN n > 0 THEN 1 ELSE 0 END AS city_has_event, target_n_trips_t24
FROM c LEFT JOIN zones USING (pu_location_id) LEFT JOIN weather USING (date, hour) LEFT JOIN e USING (date, hour)""")
def demand_enriched(spark, sf):
    p = P.with_calendar(P.complete(_demand(spark, sf)))
    p = P.enriched(p, A.weather_features(weather(spark, sf)), A.city_event_features(city_events(spark, sf)), zones=zones_ev(spark, sf))
    return rounded(p.select("pu_location_id", "borough", "date", "hour", "hour_block_3h", "n_trips", "temp_c", "precip_mm", "city_n_events", "city_has_event", "target_n_trips_t24"))


@query(f"WITH {GRID} SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY pu_location_id ORDER BY timestamp_hour DESC) <= 168")
def history_tail(spark, sf):
    return P.tail(_panel(spark, sf))


@query(f"WITH {GRID} SELECT pu_location_id, timestamp_hour, round(avg(n_trips) OVER ({Z} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 4) AS smooth FROM panel")
def running_mean(spark, sf):
    return rounded(_panel(spark, sf).select("pu_location_id", "timestamp_hour", P.running("n_trips", 24).alias("smooth")))


@query(f"WITH {GRID} SELECT timestamp_hour, " + ", ".join(f"max(n_trips) FILTER (pu_location_id = {z}) AS z{z}_n_trips" for z in range(1, 9)) + " FROM panel GROUP BY 1")
def wide_zone_features(spark, sf):
    return P.wide(_panel(spark, sf), range(1, 9), "n_trips")


@query(f"WITH {GRID}, m AS (SELECT timestamp_hour, max(n_trips) AS most FROM panel GROUP BY 1) SELECT p.timestamp_hour, most, min(pu_location_id) AS zone, count(*) AS n_tied FROM panel p JOIN m ON p.timestamp_hour = m.timestamp_hour AND n_trips = most GROUP BY 1, 2")
def max_demand_zone(spark, sf):
    return P.busiest(_panel(spark, sf))


BASE = f"""{TRIPS_EV}, cells AS (SELECT pu_location_id, date + to_hours(hour) AS timestamp_hour, count(*) AS n_trips, coalesce(avg(total_amount_std) FILTER (total_amount_std > 20), 0) AS avg_price,
    greatest(0, coalesce(quantile_cont(total_amount_std, 0.75) FILTER (total_amount_std > 20) - quantile_cont(total_amount_std, 0.25) FILTER (total_amount_std > 20), 0)) AS price_variability FROM trips GROUP BY 1, 2), grid AS (
  SELECT pu_location_id, timestamp_hour FROM (SELECT DISTINCT pu_location_id FROM cells), (SELECT unnest(generate_series(min(timestamp_hour), max(timestamp_hour), INTERVAL 1 HOUR)) AS timestamp_hour FROM cells)), panel AS (
  SELECT g.*, coalesce(n_trips, 0) AS n_trips, coalesce(avg_price, 0) AS avg_price, coalesce(price_variability, 0) AS price_variability FROM grid g LEFT JOIN cells USING (pu_location_id, timestamp_hour))"""


def _base(spark, sf):
    """Bounds, moments and limits are each taken from the panel, so it is written down once."""
    cells = S.base(trips_ev(spark, sf), valid=F.col("total_amount_std") > 20)
    return durable(P.filled(durable(cells), values={"n_trips": 0, "avg_price": 0.0, "price_variability": 0.0}))


@query(f"WITH {BASE} SELECT pu_location_id, timestamp_hour, n_trips, round(avg_price, 4) AS avg_price, round(price_variability, 4) AS price_variability FROM panel")
def stress_base(spark, sf):
    return rounded(_base(spark, sf))


@query(f"""WITH {BASE} SELECT pu_location_id, timestamp_hour, round(lag(price_variability, 24) OVER ({Z}), 4) AS pv_lag_24, round({_roll("price_variability", 24)}, 4) AS pv_roll_24, round({_roll("avg_price", 24)}, 4) AS price_roll_24 FROM panel""")
def stress_history(spark, sf):
    p = P.with_history(_base(spark, sf), {"price_variability": ((1, 24), (3, 24)), "avg_price": ((1, 24), (24,))})
    return rounded(p.select("pu_location_id", "timestamp_hour", F.col("price_variability_lag_24").alias("pv_lag_24"), F.col("price_variability_roll_24").alias("pv_roll_24"), F.col("avg_price_roll_24").alias("price_roll_24")))


SPLIT = """hours AS (SELECT timestamp_hour, row_number() OVER (ORDER BY timestamp_hour) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT timestamp_hour FROM panel)), bounds AS (
  SELECT max(timestamp_hour) FILTER (n <= floor(total * CAST(0.7 AS DOUBLE))) AS train_end, min(timestamp_hour) FILTER (n > floor(total * CAST(0.7 AS DOUBLE))) AS val_start,
    max(timestamp_hour) FILTER (n <= floor(total * CAST(0.7 AS DOUBLE)) + floor(total * CAST(0.15 AS DOUBLE))) AS val_end, min(timestamp_hour) FILTER (n > floor(total * CAST(0.7 AS DOUBLE)) + floor(total * CAST(0.15 AS DOUBLE))) AS test_start FROM hours)"""


@query(f"WITH {BASE}, {SPLIT} SELECT * FROM bounds")
def temporal_split(spark, sf):
    return S.split_bounds(_base(spark, sf))


@query(f"WITH {BASE}, hours AS (SELECT timestamp_hour, row_number() OVER (ORDER BY timestamp_hour) AS n FROM (SELECT DISTINCT timestamp_hour FROM panel)), k AS (SELECT floor(max(n) * CAST(0.7 AS DOUBLE)) AS a, floor(max(n) * CAST(0.15 AS DOUBLE)) AS b FROM hours), s AS (SELECT timestamp_hour, CASE WHEN n <= a THEN 'train' WHEN n > a + 24 AND n <= a + 24 + b THEN 'val' WHEN n > a + b + 48 THEN 'test' ELSE 'gap' END AS split FROM hours, k) SELECT split, count(*) AS n_rows FROM panel JOIN s USING (timestamp_hour) GROUP BY 1")
def split_with_gap(spark, sf):
    p = _base(spark, sf)
    return S.with_split(p, S.split_bounds(p, gap=24)).groupBy("split").agg(F.count("*").alias("n_rows"))


SCORE = f"""{BASE}, {SPLIT}, m AS (SELECT avg(ln(1 + n_trips)) AS ma, stddev_pop(ln(1 + n_trips)) AS sa, avg(price_variability) AS mb, stddev_pop(price_variability) AS sb FROM panel, bounds WHERE timestamp_hour <= train_end), scored AS (
  SELECT panel.*, (ln(1 + n_trips) - ma) / CASE WHEN sa > 0 THEN sa ELSE 1 END + (price_variability - mb) / CASE WHEN sb > 0 THEN sb ELSE 1 END AS stress_score FROM panel, m)"""


def _scored(spark, sf):
    p = _base(spark, sf)
    bounds = durable(S.split_bounds(p))
    return S.scored(p, bounds), bounds


@query(f"WITH {SCORE} SELECT pu_location_id, timestamp_hour, round(stress_score, 4) AS stress_score FROM scored")
def stress_score(spark, sf):
    return rounded(_scored(spark, sf)[0].select("pu_location_id", "timestamp_hour", "stress_score"))


LABELS = f"""{SCORE}, ahead AS (SELECT *, lead(stress_score, 1) OVER ({Z}) AS t1, lead(stress_score, 3) OVER ({Z}) AS t3, lead(stress_score, 24) OVER ({Z}) AS t24 FROM scored), cut AS (
  SELECT quantile_cont(stress_score, 0.9) FILTER (timestamp_hour <= train_end) AS c0, quantile_cont(t1, 0.9) FILTER (timestamp_hour + INTERVAL 1 HOUR <= train_end) AS c1,
    quantile_cont(t3, 0.9) FILTER (timestamp_hour + INTERVAL 3 HOUR <= train_end) AS c3, quantile_cont(t24, 0.9) FILTER (timestamp_hour + INTERVAL 24 HOUR <= train_end) AS c24 FROM ahead, bounds), labels AS (
  SELECT ahead.*, CAST(stress_score >= c0 AS INT) AS is_stress_now, CAST(t1 >= c1 AS INT) AS is_stress_t1, CAST(t3 >= c3 AS INT) AS is_stress_t3, CAST(t24 >= c24 AS INT) AS is_stress_t24 FROM ahead, cut)"""


def _labelled(spark, sf):
    p, bounds = _scored(spark, sf)
    return durable(S.labelled(durable(p), bounds)), bounds


@query(f"WITH {LABELS} SELECT pu_location_id, timestamp_hour, round(t24, 4) AS target_stress_t24, is_stress_now, is_stress_t1, is_stress_t3, is_stress_t24 FROM labels")
def stress_labels(spark, sf):
    return rounded(_labelled(spark, sf)[0].select("pu_location_id", "timestamp_hour", "target_stress_t24", "is_stress_now", "is_stress_t1", "is_stress_t3", "is_stress_t24"))


CAL = "CAST(dayofweek(timestamp_hour) + 1 AS INT) AS day_of_week, CAST(hour(timestamp_hour) AS INT) AS hour, CAST(dayofweek(timestamp_hour) IN (0, 6) AS INT) AS is_weekend"
SLOTS = f"""{LABELS}, {ZONES_EV}, {WEATHER}, {CITY_EVENTS}, city AS (SELECT date, hour, sum(n_events) AS n FROM city_events GROUP BY 1, 2), dated AS (SELECT *, CAST(timestamp_hour AS DATE) AS date, {CAL} FROM labels), slots AS (
  SELECT pu_location_id, borough, day_of_week, hour, CAST(floor(hour / 3) AS INT) AS hour_block_3h, count(*) AS n_obs, avg(is_stress_now) AS stress_rate, avg(stress_score) AS stress_score_mean, avg(n_trips) AS n_trips_mean, avg(price_variability) AS price_variability_mean, avg(avg_price) AS avg_price_mean,
  avg(temp_c) AS temp_c_mean, avg(precip_mm) AS precip_mm_mean, avg(coalesce(n, 0)) AS city_n_events_mean, avg(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS city_has_event_rate,
  quantile_cont(stress_score, 0.9) AS stress_score_p90, quantile_cont(n_trips, 0.9) AS n_trips_p90, quantile_cont(price_variability, 0.9) AS price_variability_p90
  FROM dated LEFT JOIN zones USING (pu_location_id) LEFT JOIN weather USING (date, hour) LEFT JOIN city USING (date, hour) GROUP BY 1, 2, 3, 4, 5)"""
MEASURES = ("stress_rate", "stress_score_mean", "n_trips_mean", "price_variability_mean", "avg_price_mean", "temp_c_mean", "precip_mm_mean", "city_n_events_mean", "city_has_event_rate", "stress_score_p90", "n_trips_p90", "price_variability_p90")


def _enriched(spark, sf):
    """The labelled panel with calendar, borough, weather and events."""
    p = P.with_calendar(_labelled(spark, sf)[0])
    return P.enriched(p, A.weather_features(weather(spark, sf)), A.city_event_features(city_events(spark, sf)), zones=zones_ev(spark, sf))


def slot_panel(spark, sf):
    return durable(S.slots(_enriched(spark, sf)))


@query(f"WITH {SLOTS} SELECT pu_location_id, borough, day_of_week, hour, hour_block_3h, n_obs, " + ", ".join(f"round({c}, 4) AS {c}" for c in MEASURES) + " FROM slots")
def stress_slot_panel(spark, sf):
    return rounded(slot_panel(spark, sf))


@query(f"WITH {SLOTS}, {RENT}, {RESTAURANTS}, r AS (SELECT CAST(year + 1 AS INT) AS year, zone_id, avg(price) AS rent FROM rent GROUP BY 1, 2), q AS (SELECT 2024 AS year, zone_id, count(DISTINCT camis) AS nr FROM restaurants GROUP BY 1, 2) SELECT pu_location_id, timestamp_hour, borough, round(temp_c, 4) AS temp_c, precip_mm, coalesce(n, 0) AS city_n_events, CASE WHEN n > 0 THEN 1 ELSE 0 END AS city_has_event, round(rent, 4) AS rent_price_zone, nr AS n_restaurants_zone, is_stress_now FROM dated LEFT JOIN zones USING (pu_location_id) LEFT JOIN weather USING (date, hour) LEFT JOIN city USING (date, hour) LEFT JOIN r ON pu_location_id = r.zone_id AND year(timestamp_hour) = r.year LEFT JOIN q ON pu_location_id = q.zone_id AND year(timestamp_hour) = q.year")
def stress_enriched(spark, sf):
    rents = A.yearly_features(rent(spark, sf), "price").select((F.col("year") + 1).alias("year"), F.col("zone_id").alias("pu_location_id"), F.col("price").alias("rent_price_zone"))
    eaten = restaurants(spark, sf).groupBy(F.lit(2024).alias("year"), F.col("zone_id").alias("pu_location_id")).agg(F.count_distinct("camis").alias("n_restaurants_zone"))
    p = P.enriched(P.enriched(_enriched(spark, sf), zone_years=rents), zone_years=eaten)
    return rounded(p.select("pu_location_id", "timestamp_hour", "borough", "temp_c", "precip_mm", "city_n_events", "city_has_event", "rent_price_zone", "n_restaurants_zone", "is_stress_now"))


BASELINE = f"""{LABELS}, {ZONES_EV}, full_ AS (SELECT l.*, {CAL}, borough, CASE WHEN timestamp_hour <= train_end THEN 'train' WHEN timestamp_hour BETWEEN val_start AND val_end THEN 'val' WHEN timestamp_hour >= test_start THEN 'test' ELSE 'gap' END AS split
  FROM labels l LEFT JOIN zones USING (pu_location_id), bounds), tr AS (SELECT * FROM full_ WHERE split = 'train' AND t1 IS NOT NULL), pz AS (SELECT pu_location_id, hour, is_weekend, avg(t1) AS p FROM tr GROUP BY 1, 2, 3), pb AS (SELECT borough, hour, is_weekend, avg(t1) AS p FROM tr GROUP BY 1, 2, 3),
  ph AS (SELECT hour, avg(t1) AS p FROM tr GROUP BY 1), pg AS (SELECT avg(t1) AS p FROM tr), preds AS (
  SELECT f.*, stress_score AS pred_persistence, coalesce(pz.p, pb.p, ph.p, pg.p) AS pred_zone_hour_weekend, pg.p AS pred_global FROM full_ f LEFT JOIN pz ON f.pu_location_id = pz.pu_location_id AND f.hour = pz.hour AND f.is_weekend = pz.is_weekend
  LEFT JOIN pb ON f.borough = pb.borough AND f.hour = pb.hour AND f.is_weekend = pb.is_weekend LEFT JOIN ph ON f.hour = ph.hour, pg)"""


def _baselines(spark, sf):
    p, bounds = _labelled(spark, sf)
    p = S.with_split(P.with_calendar(p).join(zones_ev(spark, sf), "pu_location_id", "left"), bounds)
    return S.baselines(durable(p))


@query(f"WITH {BASELINE} SELECT pu_location_id, timestamp_hour, split, round(pred_persistence, 4) AS pred_persistence, round(pred_zone_hour_weekend, 4) AS pred_zone_hour_weekend, round(pred_global, 4) AS pred_global FROM preds")
def baseline_predictions(spark, sf):
    return rounded(_baselines(spark, sf).select("pu_location_id", "timestamp_hour", "split", "pred_persistence", "pred_zone_hour_weekend", "pred_global"))


@query(f"WITH {BASELINE}, l AS (" + " UNION ALL ".join(f"SELECT split, t1 AS y, '{m}' AS model, {m} AS p FROM preds WHERE t1 IS NOT NULL" for m in ("pred_persistence", "pred_zone_hour_weekend", "pred_global")) + ") SELECT split, model, count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 4) AS r2 FROM l GROUP BY 1, 2")
def baseline_metrics(spark, sf):
    return rounded(S.regression_metrics(_baselines(spark, sf), "target_stress_t1", ["pred_persistence", "pred_zone_hour_weekend", "pred_global"], ["split"]))


@query(f"WITH {LABELS}, c AS (SELECT count(*) AS n, count(*) FILTER (is_stress_t1 = 1 AND is_stress_now = 1) AS tp, count(*) FILTER (is_stress_t1 <> 1 AND is_stress_now = 1) AS fp, count(*) FILTER (is_stress_t1 = 1 AND is_stress_now <> 1) AS fn FROM labels WHERE is_stress_t1 IS NOT NULL) SELECT n, tp, fp, fn, round((n - fp - fn) / n, 4) AS accuracy, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c")
def class_metrics(spark, sf):
    return rounded(S.class_metrics(_labelled(spark, sf)[0], "is_stress_t1", "is_stress_now"))


@query(f"WITH {BASELINE}, l AS (" + " UNION ALL ".join(f"SELECT split, t1 AS y, '{m}' AS model, {m} AS p FROM preds WHERE t1 IS NOT NULL" for m in ("pred_persistence", "pred_zone_hour_weekend", "pred_global")) + "), r AS (SELECT split, model, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse FROM l WHERE split IN ('val', 'test') GROUP BY 1, 2) SELECT split, model, rmse FROM r QUALIFY row_number() OVER (PARTITION BY split ORDER BY rmse, model) = 1")
def best_baseline(spark, sf):
    found = S.regression_metrics(_baselines(spark, sf), "target_stress_t1", ["pred_persistence", "pred_zone_hour_weekend", "pred_global"], ["split"]).where("split in ('val', 'test')")
    return S.best_model(rounded(found), by=["split"])


DAILY = f"{TRIPS_EV}, daily AS (SELECT pu_location_id, hour, date, count(*) AS num_trips, avg(total_amount_std) AS avg_price, stddev_samp(total_amount_std) AS std_price FROM trips WHERE total_amount_std > 0 AND total_amount_std < 500 GROUP BY 1, 2, 3 HAVING count(*) >= 2)"


@query(f"""WITH {DAILY}, c AS (SELECT pu_location_id, hour, avg(num_trips) AS num_trips_avg, coalesce(stddev_samp(num_trips), 0) AS num_trips_std, min(num_trips) AS num_trips_min, max(num_trips) AS num_trips_max, count(*) AS num_trips_count, avg(avg_price) AS avg_price_mean, avg(std_price) AS std_price_mean FROM daily GROUP BY 1, 2), v AS (
  SELECT *, CASE WHEN num_trips_avg > 0 THEN num_trips_std / num_trips_avg ELSE 0 END AS cv FROM c), zt AS (SELECT pu_location_id, quantile_cont(num_trips_avg, 1 / 3) AS a, quantile_cont(num_trips_avg, 2 / 3) AS b, count(DISTINCT num_trips_avg) AS d FROM v GROUP BY 1), g AS (SELECT quantile_cont(cv, 0.33) AS a, quantile_cont(cv, 0.66) AS b FROM v), l AS (
  SELECT v.*, CASE WHEN d < 3 THEN 'Media' WHEN num_trips_avg <= zt.a THEN 'Baja' WHEN num_trips_avg <= zt.b THEN 'Media' ELSE 'Alta' END AS demand_level, CASE WHEN cv <= g.a THEN 'Predecible' WHEN cv <= g.b THEN 'Variable' ELSE 'Volátil' END AS stability FROM v JOIN zt USING (pu_location_id), g), p AS (
  SELECT *, CASE demand_level WHEN 'Alta' THEN 3 WHEN 'Media' THEN 2 ELSE 1 END * CASE stability WHEN 'Predecible' THEN 3 WHEN 'Variable' THEN 2 ELSE 1 END AS operational_priority FROM l)
SELECT pu_location_id, hour, round(num_trips_avg, 4) AS num_trips_avg, round(num_trips_std, 4) AS num_trips_std, num_trips_min, num_trips_max, num_trips_count, round(avg_price_mean, 4) AS avg_price_mean, round(std_price_mean, 4) AS std_price_mean, round(cv, 4) AS cv, demand_level, stability, operational_priority,
  CASE WHEN operational_priority >= 7 THEN 'Crítica' WHEN operational_priority >= 4 THEN 'Alta' ELSE 'Baja' END AS operational_priority_label FROM p""")
def demand_patterns(spark, sf):
    return rounded(I.demand_patterns(A.zone_hour_day(A.priced(trips_ev(spark, sf)), least=2), least=2))


def _score(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN max({c}) OVER y = min({c}) OVER y THEN 0.5 ELSE ({c} - min({c}) OVER y) / (max({c}) OVER y - min({c}) OVER y) END END"


def _weighted(weights: dict) -> str:
    top = " + ".join(f"coalesce({c} * {w}, 0)" for c, w in weights.items())
    bottom = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0 END" for c, w in weights.items())
    return f"CASE WHEN {bottom} > 0 THEN ({top}) / ({bottom}) END"


@query(f"""WITH {TRIPS_LI}, {RENT}, {RESTAURANTS}, base AS (SELECT year, pu_location_id, count(*) AS trip_volume, avg(tip_amount) AS a, avg(tip_amount / fare_amount) AS b, CAST(avg(passenger_count) AS DOUBLE) AS c FROM trips WHERE tip_amount >= 0 AND passenger_count BETWEEN 0 AND 8 GROUP BY 1, 2), r AS (
  SELECT CAST(year - 27 AS INT) AS year, zone_id, coalesce(sum(CASE WHEN price_moe > 0 THEN price / (price_moe * price_moe) END) / sum(CASE WHEN price_moe > 0 THEN 1 / (price_moe * price_moe) END), avg(price)) AS rent FROM rent GROUP BY 1, 2), l AS (
  SELECT * FROM restaurants QUALIFY row_number() OVER (PARTITION BY year, camis ORDER BY inspection_date DESC, score DESC, grade DESC, zone_id DESC) = 1), q AS (SELECT year, zone_id, count(DISTINCT camis) AS nr, count(DISTINCT cuisine) AS nc FROM l GROUP BY 1, 2), j AS (
  SELECT base.*, rent, nr, nc FROM base LEFT JOIN r ON base.year = r.year AND pu_location_id = r.zone_id LEFT JOIN q ON base.year = q.year AND pu_location_id = q.zone_id), s AS (
  SELECT *, {_score("a")} AS tip_amount_score, {_score("b")} AS tip_pct_score, {_score("c")} AS passenger_score, {_score("trip_volume")} AS trip_volume_score, {_score("rent")} AS rent_score, {_score("nr")} AS restaurants_score, {_score("nc")} AS cuisines_score FROM j WINDOW y AS (PARTITION BY year)), w AS (
  SELECT *, {_weighted(I.CORE)} AS core, {_weighted(I.EXTERNAL)} AS ext FROM s), x AS (SELECT *, CASE WHEN ext IS NOT NULL THEN 0.75 * core + 0.25 * ext ELSE core END AS raw FROM w), f AS (SELECT *, {_score("raw")} AS score FROM x WINDOW y AS (PARTITION BY year))
SELECT year, pu_location_id, trip_volume, round(core, 4) AS core_taxi_score, round(ext, 4) AS external_score, round(score, 4) AS socioeconomic_score, CASE WHEN score IS NULL THEN 'Sin datos' WHEN score <= 0.2 THEN 'Bajo' WHEN score <= 0.4 THEN 'Medio-bajo' WHEN score <= 0.6 THEN 'Medio' WHEN score <= 0.8 THEN 'Medio-alto' ELSE 'Alto' END AS socioeconomic_label FROM f""")
def socioeconomic_index(spark, sf):
    trips = trips_li(spark, sf).withColumn("tip_pct", F.col("tip_amount") / F.col("fare_amount"))
    rents = A.rent_by_zone(rent(spark, sf)).withColumn("year", F.col("year") - 27)  # brought to the years of the orders
    found = I.socioeconomic_index(I.tip_base(trips), rents, A.restaurants_by_zone(restaurants(spark, sf)))
    return rounded(found.select("year", "pu_location_id", "trip_volume", "core_taxi_score", "external_score", "socioeconomic_score", "socioeconomic_label"))


@query(f"WITH {TRIPS_LI} SELECT year, pu_location_id, count(*) AS trip_volume, round(avg(tip_amount), 4) AS avg_tip_amount, round(quantile_cont(tip_amount, 0.5), 4) AS median_tip_amount, round(avg(CASE WHEN tip_amount > 0 THEN 1 ELSE 0 END), 4) AS tip_share FROM trips WHERE tip_amount >= 0 AND passenger_count BETWEEN 0 AND 8 GROUP BY 1, 2")
def tip_base(spark, sf):
    trips = trips_li(spark, sf).withColumn("tip_pct", F.col("tip_amount") / F.col("fare_amount"))
    return rounded(I.tip_base(trips).select("year", "pu_location_id", "trip_volume", "avg_tip_amount", "median_tip_amount", "tip_share"))
