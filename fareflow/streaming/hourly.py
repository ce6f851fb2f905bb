"""Streaming variants of the hourly aggregates: an extension, the batch operators being the definition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_demand(trips: DataFrame, late: str = "2 hours", time: str = "pickup_datetime") -> DataFrame:
    """Trips by zone and hour of event time. Hours close when the watermark has passed them; later rows are dropped."""
    stamped = trips.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    found = stamped.groupBy(F.window("_t", "1 hour"), "pu_location_id").agg(F.count("*").alias("n_trips"), F.sum("total_amount_std").alias("total"))
    return found.select("pu_location_id", F.col("window.start").cast("timestamp_ntz").alias("timestamp_hour"), "n_trips", "total")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Works off what is there and ends; a rerun with the same checkpoint goes on from where it was."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
