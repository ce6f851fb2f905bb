"""Rule tables, edge cases and properties on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fareflow import schemas as S
from fareflow.functions import columns as C
from fareflow.operators import aggregates as A
from fareflow.operators import indices as I
from fareflow.operators import learning, trips
from fareflow.operators import outliers as O
from fareflow.operators import panel as P
from fareflow.operators import stress as T
from fareflow.operators import validate as V
from fareflow.sources import tables
from fareflow.streaming import hourly


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_taxi_rules_name_the_first_failure(spark):
    day = dt.datetime(2024, 1, 1, 8)
    ok = dict(a=day, b=day + dt.timedelta(minutes=10), passenger_count=1, trip_distance=1.0, fare_amount=10.0, total_amount=12.0, tip_amount=1.0)
    bad = {
        "pickup_missing": {"a": None}, "dropoff_missing": {"b": None}, "dropoff_not_after_pickup": {"b": day}, "too_long": {"b": day + dt.timedelta(hours=7)}, "no_passengers": {"passenger_count": 0},
        "no_distance": {"trip_distance": 0.0}, "negative_tip_amount": {"tip_amount": -1.0}, "fare_too_high": {"fare_amount": 401.0}, "total_too_high": {"total_amount": 501.0},
    }
    nulls = {"passenger_count": None, "trip_distance": None, "fare_amount": None, "total_amount": None, "tip_amount": None}
    data = [("valid", ok), ("valid", ok | nulls), *[(name, ok | change) for name, change in bad.items()]]
    df = spark.createDataFrame([(w, *r.values()) for w, r in data], "want string, a timestamp_ntz, b timestamp_ntz, passenger_count long, trip_distance double, fare_amount double, total_amount double, tip_amount double")
    rules = V.taxi_rules(df.columns, "a", "b")
    assert all(want == (got or "valid") for want, got in values(df.withColumn("r", V.reason(rules)), "want", "r"))
    assert V.valid(df, rules).count() == 2
    assert V.valid(df, V.taxi_rules(df.columns, "a", "b", 2024, 2)).count() == 0


def test_rides_cap_fares_and_keep_flags(spark):
    day = dt.datetime(2024, 1, 1, 8)
    rows = [(day, day + dt.timedelta(minutes=5), None, None, 300, 1.0, f, 1.0) for f in (10.0, 401.0, None)]
    df = spark.createDataFrame(rows, "pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, request_datetime timestamp_ntz, on_scene_datetime timestamp_ntz, trip_time long, trip_miles double, base_passenger_fare double, driver_pay double")
    assert [r for (r,) in values(df.withColumn("r", V.reason(V.ride_rules())), "r")] == [None, "fare_too_high", None]
    flags = spark.createDataFrame([("Y",), ("x",), (None,)], "store_and_fwd_flag string")
    assert values(V.code_domains(flags, {"store_and_fwd_flag": S.FLAGS}), "store_and_fwd_flag") == [("Y",), (None,), (None,)]


def test_money_text_and_names(spark):
    df = spark.createDataFrame([("$1,234.50", "  st. george/new o'neil "), ("1.234,50", "nan"), ("12,5", ""), ("abc", None)], "m string, t string")
    got = values(df.select(C.money("m").alias("m"), C.title_case(C.clean_text("t")).alias("t")), "m", "t")
    assert got[0] == (1234.5, "St. George/New O'Neil") and got[1][0] == 1234.5 and got[2][0] == 12.5 and got[3][0] is None
    assert [t for _, t in got[1:3]] == [None, None] or [t for _, t in got[1:3]] == ["", ""]
    levels = spark.createDataFrame([(None,), (0.2,), (0.81,)], "x double").select(C.five_levels("x").alias("l"), C.rain_bin("x").alias("r"))
    assert values(levels, "l", "r") == [("no_data", "unknown"), ("low", "light"), ("high", "light")]


def test_conform_finds_names_in_any_case(spark):
    df = spark.createDataFrame([("7", "x", 1)], "vendorid string, trip_distance string, extra_thing int")
    out = tables.conform(df, S.YELLOW, {"fare_amount": ["base_fare"]})
    assert out.columns == S.YELLOW.fieldNames()
    assert values(out, "VendorID", "trip_distance", "fare_amount") == [(7, None, None)]


def test_first_source_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, day string")
    with pytest.raises(FileNotFoundError):
        tables.first_source(spark, [("parquet", f"{tmp_path}/none")])
    for _ in range(2):
        tables.write_partitioned(df, f"{tmp_path}/t", ["day"])
    tables.write_partitioned(df.where("x = 2").withColumn("x", F.lit(3)), f"{tmp_path}/t", ["day"])
    got = tables.first_source(spark, [("parquet", f"{tmp_path}/none"), ("parquet", f"{tmp_path}/t")])
    assert sorted(values(got, "x", "day")) == [(1, "a"), (3, "b")]
    assert tables.missing_partitions(df, got.where("day = 'a'"), ["day"]).count() == 1
    with pytest.raises(ValueError):
        tables.write_partitioned(df, f"{tmp_path}/t", ["nope"])


def test_lags_and_rolls_wait_for_whole_windows(spark):
    start = dt.datetime(2024, 1, 1)
    hours = [h for h in range(30) if h not in (10, 11, 12)]
    cells = spark.createDataFrame([(1, start + dt.timedelta(hours=h), h) for h in hours], "pu_location_id int, timestamp_hour timestamp_ntz, n_trips long")
    p = P.with_targets(P.with_history(P.filled(cells), {"n_trips": ((1,), (3,))}), "n_trips", (1,)).orderBy("timestamp_hour")
    rows = p.collect()
    assert len(rows) == 30 and [r["n_trips"] for r in rows[10:13]] == [0, 0, 0]
    assert [r["n_trips_roll_3"] for r in rows[:4]] == [None, None, None, 1.0]
    assert all(a["target_n_trips_t1"] == b["n_trips"] and b["n_trips_lag_1"] == a["n_trips"] for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize(("n", "known"), [(29, False), (30, True)])
def test_threshold_cascade(spark, n, known):
    rows = [(1, 1, 0, float(i)) for i in range(n)] + [(2, 2, 0, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "pu_location_id int, hour int, is_weekend int, v double")
    q = O.with_thresholds(df, ["v"], least=30).where("pu_location_id = 1").select("q_v").first()[0]
    assert (q[3] < 30) == known  # the narrow scope's own quantile, or that of all rows


def test_thresholds_belong_to_a_month(spark):
    rows = [(s, y, m, 1, 8, 0, float(base + i)) for s, y, m, base in (("a", 2024, 1, 0), ("a", 2024, 2, 1000), ("b", 2024, 1, 5000)) for i in range(40)]
    df = spark.createDataFrame(rows, "service_type string, year int, month int, pu_location_id int, hour int, is_weekend int, trip_distance double").withColumns({"tip_amount": F.lit(1.0), "fare_amount": F.lit(10.0), "total_amount_std": F.lit(10.0)})
    treated = O.treat(O.with_thresholds(df, ["trip_distance"]), ["trip_distance"])
    assert treated.where("trip_distance_action = 'removed'").groupBy("service_type", "month").count().count() == 3
    assert values(O.actions(treated, ["trip_distance"]), "scope", "n_removed", "n_clamped") == [("primary", 6, 6)]


def test_raw_records_become_standard_trips(spark):
    day = dt.datetime(2024, 3, 2, 10)
    yellow = spark.createDataFrame([(day, day + dt.timedelta(minutes=30), "7", 10.0, 2.0, None, 1.25), (day, day, None, 1.0, 0.0, 9.0, None), (None, day, "7", 1.0, 0.0, 9.0, None)], "tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, PULocationID string, fare_amount double, tip_amount double, total_amount double, Airport_fee double")
    rides = spark.createDataFrame([(day, day, 7, 3.5, None, 8.0, 1.0)], "pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, PULocationID long, trip_miles double, trip_distance double, base_passenger_fare double, tips double")
    out = trips.standard_trips({"yellow": yellow, "fhvhv": rides}, (2024, 2025))
    assert out.columns == S.TRIP.fieldNames() and len(out.columns) == 36 and [f.dataType for f in out.schema] == [f.dataType for f in S.TRIP]
    got = sorted(values(out, "service_type", "total_amount_std", "trip_distance", "tip_pct", "trip_duration_min", "is_weekend", "airport_fee"))
    assert got == [("fhvhv", 9.0, 3.5, None, 0.0, 1, None), ("yellow", 3.25, None, 0.2, 30.0, 1, 1.25)]
    assert trips.standard_trips({"yellow": yellow}, (2025, 2025)).count() == 0
    assert trips.without_repeats(out.unionAll(out)).count() == 2 and trips.of_month(out, 2024, 4).count() == 0


def test_rides_with_negative_amounts_fail(spark):
    day = dt.datetime(2024, 1, 1, 8)
    kinds = ", ".join(f"{c} double" for c in S.RIDE_AMOUNTS)
    rows = [(day, day + dt.timedelta(minutes=5), None, None, 300, 1.0, *[-1.0 if c == bad else None for c in S.RIDE_AMOUNTS]) for bad in S.RIDE_AMOUNTS]
    df = spark.createDataFrame(rows, f"pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, request_datetime timestamp_ntz, on_scene_datetime timestamp_ntz, trip_time long, trip_miles double, {kinds}")
    assert [r for (r,) in values(df.withColumn("r", V.reason(V.ride_rules(df.columns))), "r")] == [f"negative_{c}" for c in S.RIDE_AMOUNTS]
    assert {r for (r,) in values(df.withColumn("r", V.reason(V.ride_rules(df.columns, 2024, 2))), "r")} == {"outside_month"}


def test_title_case_keeps_long_words(spark):
    word = "x" * 1_200_000
    assert spark.createDataFrame([(word,)], "t string").select(F.length(C.title_case("t"))).first()[0] == len(word)


def test_row_split_is_stable_where_execution_coalesces(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("k"), "id").repartition(7)
    got = sorted(values(T.row_split(df, ["k"]), "k", "split"))
    assert [s for _, s in got] == ["train"] * 700 + ["val"] * 150 + ["test"] * 150


def test_search_takes_the_later_rows_error(spark):
    rows = [(float(i), 3.0 * i, "train" if i < 60 else "val") for i in range(80)]
    df = spark.createDataFrame(rows, "x double, y double, split string")
    best = learning.search(df.where("split = 'train'"), df.where("split = 'val'"), learning.elastic_net, learning.grid({"regParam": [0.0, 50.0]}), "y", ["x"])
    assert best[0] == {"regParam": 0.0}


def test_terciles_and_priority(spark):
    day = dt.date(2024, 1, 1)
    rows = [(z, h, day, n, 1.0, 0.0) for z, vs in ((1, range(1, 8)), (2, (5, 5, 6))) for h, n in enumerate(vs)]
    got = I.demand_patterns(spark.createDataFrame(rows, "pu_location_id int, hour int, date date, num_trips long, avg_price double, std_price double"), 1)
    levels = {(r["pu_location_id"], r["hour"]): r["demand_level"] for r in got.collect()}
    assert [levels[1, h] for h in range(7)] == ["Baja"] * 3 + ["Media"] * 2 + ["Alta"] * 2
    assert {levels[2, h] for h in range(3)} == {"Media"}


def test_min_max_and_available_weights(spark):
    df = spark.createDataFrame([(1, 3.0, None), (1, 3.0, 1.0), (2, None, 2.0), (2, 0.0, None), (2, 4.0, None)], "year int, a double, b double")
    got = values(df.select(I.min_max("a").alias("m")), "m")
    assert sorted(got, key=str) == sorted([(0.5,), (0.5,), (None,), (0.0,), (1.0,)], key=str)
    assert [x for (x,) in values(df.select(I.weighted_available({"a": 3.0, "b": 1.0}).alias("w")), "w")] == [3.0, 2.5, 2.0, 0.0, 4.0]


def test_weighted_rent(spark):
    rows = [(2024, 1, 1, 100.0, 1.0), (2024, 1, 2, 200.0, 2.0), (2024, 2, 3, 100.0, None), (2024, 2, 4, 300.0, None), (2024, 3, 5, 50.0, 0.0)]
    got = dict(values(A.rent_by_zone(spark.createDataFrame(rows, "year int, zone_id int, id long, price double, price_moe double")), "zone_id", "rent_price_zone"))
    assert got == {1: pytest.approx((100 + 200 / 4) / (1 + 1 / 4)), 2: 200.0, 3: 50.0}


def test_split_truncates_and_labels_dont_leak(spark):
    start = dt.datetime(2024, 1, 1)
    panel = spark.createDataFrame([(1, start + dt.timedelta(hours=h), h + 1, float(h)) for h in range(10)], "pu_location_id int, timestamp_hour timestamp_ntz, n_trips long, price_variability double")
    bounds = T.split_bounds(panel)
    sizes = dict(values(T.with_split(panel, bounds).groupBy("split").count(), "split", "count"))
    assert sizes == {"train": 7, "val": 1, "test": 2}
    later = panel.withColumn("n_trips", F.when(F.col("timestamp_hour") > F.lit(start + dt.timedelta(hours=6)).cast("timestamp_ntz"), 10**6).otherwise(F.col("n_trips")))
    first = lambda p: values(T.scored(p, bounds).orderBy("timestamp_hour").limit(7), "stress_score")
    assert first(panel) == first(later)


def test_empty_inputs(spark):
    trips = spark.createDataFrame([], "date date, hour int, pu_location_id int, service_type string, total_amount_std double")
    assert A.daily_service(trips).count() == A.price_variability(trips).count() == P.filled(P.hourly_counts(trips)).count() == 0


def test_streaming_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=7 * i), i % 3, 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "pickup_datetime timestamp_ntz, pu_location_id int, total_amount_std double")
    df.write.parquet(f"{tmp_path}/in")
    stream = hourly.hourly_demand(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    hourly.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    closed = spark.read.parquet(f"{tmp_path}/out")
    want = df.groupBy("pu_location_id", C.hour_start("pickup_datetime").alias("timestamp_hour")).agg(F.count("*").alias("n_trips"))
    assert closed.count() > 60
    assert closed.select("pu_location_id", "timestamp_hour", "n_trips").exceptAll(want).count() == 0
