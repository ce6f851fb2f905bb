"""Canonical schemas, value domains and physical limits."""

from __future__ import annotations

from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

_TYPES = {"long": LongType(), "int": IntegerType(), "double": DoubleType(), "string": StringType(), "date": DateType(), "timestamp_ntz": TimestampNTZType()}


def _struct(ddl: str) -> StructType:
    """Spark's own parser needs a session, and this module is imported before there is one."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in ddl.split(","))])



# Column names and types of the public trip records.
YELLOW = _struct(
    "VendorID long, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, passenger_count long, trip_distance double, RatecodeID long, "
    "store_and_fwd_flag string, PULocationID long, DOLocationID long, payment_type long, fare_amount double, extra double, mta_tax double, tip_amount double, "
    "tolls_amount double, improvement_surcharge double, total_amount double, congestion_surcharge double, airport_fee double, cbd_congestion_fee double"
)
GREEN = _struct(
    "VendorID long, lpep_pickup_datetime timestamp_ntz, lpep_dropoff_datetime timestamp_ntz, store_and_fwd_flag string, RatecodeID long, PULocationID long, "
    "DOLocationID long, passenger_count long, trip_distance double, fare_amount double, extra double, mta_tax double, tip_amount double, tolls_amount double, "
    "improvement_surcharge double, total_amount double, payment_type long, trip_type long, congestion_surcharge double, cbd_congestion_fee double"
)
FHVHV = _struct(
    "hvfhs_license_num string, dispatching_base_num string, originating_base_num string, request_datetime timestamp_ntz, on_scene_datetime timestamp_ntz, "
    "pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, PULocationID long, DOLocationID long, trip_miles double, trip_time long, "
    "base_passenger_fare double, tolls double, bcf double, sales_tax double, congestion_surcharge double, airport_fee double, tips double, driver_pay double, "
    "shared_request_flag string, shared_match_flag string, access_a_ride_flag string, wav_request_flag string, wav_match_flag string, cbd_congestion_fee double"
)
WEATHER = _struct("date date, hour int, temp_c double, precip_mm double, rain_mm double, snowfall_mm double, wind_kmh double, weather_code int")
CITY_EVENTS = _struct("date date, hour int, borough string, event_type string, n_events int")

# The columns of a standard trip.
TRIP = _struct(
    "service_type string, pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, date date, year int, month int, hour int, day_of_week int, is_weekend int, week_of_year int, "
    "pu_location_id int, do_location_id int, trip_distance double, trip_duration_min double, total_amount_std double, total_amount double, fare_amount double, tip_amount double, "
    "tips double, tip_pct double, price_per_mile double, tolls_amount double, tolls double, congestion_surcharge double, airport_fee double, base_passenger_fare double, trip_miles double, "
    "VendorID int, passenger_count int, RatecodeID int, payment_type int, is_valid_for_demand int, is_valid_for_price int, is_valid_for_duration int, is_valid_for_distance int, is_valid_for_tip int"
)
# Columns in which two records of one trip agree.
TRIP_IDENTITY = (
    "service_type", "pickup_datetime", "dropoff_datetime", "pu_location_id", "do_location_id", "trip_distance", "total_amount_std",
    "fare_amount", "tip_amount", "VendorID", "passenger_count", "RatecodeID", "payment_type",
)
# Names of a trip's moments and zones in the three records.
TRIP_NAMES = {
    "pickup_datetime": ("tpep_pickup_datetime", "lpep_pickup_datetime", "pickup_datetime"),
    "dropoff_datetime": ("tpep_dropoff_datetime", "lpep_dropoff_datetime", "dropoff_datetime"),
    "pu_location_id": ("PULocationID", "pu_location_id"),
    "do_location_id": ("DOLocationID", "do_location_id"),
    "trip_distance": ("trip_distance", "trip_miles"),
}

# Codes that are in use.
VENDORS = {"yellow": (1, 2, 6, 7), "green": (1, 2, 6)}
RATECODES = (1, 2, 3, 4, 5, 6)
PAYMENTS = (0, 1, 2, 3, 4)
TRIP_TYPES = (1, 2)
FLAGS = ("Y", "N")
LICENSES = ("HV0002", "HV0003", "HV0004", "HV0005")
BOROUGHS = ("Bronx", "Brooklyn", "Manhattan", "Queens", "Staten Island")
GRADES = ("A", "B", "C", "N", "P", "Z", "G")
TRACT = r"^36(?:005|047|061|081|085)\d{6}$"

# Limits of the validation rules.
MAX_MINUTES, MAX_FARE, MAX_TOTAL, MAX_RENT = 360.0, 400.0, 500.0, 10_000.0
LATITUDES, LONGITUDES = (40.4, 41.0), (-74.3, -73.6)
RIDE_AMOUNTS = ("base_passenger_fare", "tolls", "bcf", "sales_tax", "congestion_surcharge", "airport_fee", "tips", "driver_pay", "cbd_congestion_fee")
FEES = ("extra", "mta_tax", "tip_amount", "tolls_amount", "improvement_surcharge", "congestion_surcharge", "airport_fee", "cbd_congestion_fee")
