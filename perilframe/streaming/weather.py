"""The daily transforms over a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_stream(records: DataFrame, late: str = "2 days") -> DataFrame:
    """(station, day, kind): mean value of each day's records; records later than ``late`` are dropped.

    records has station, ts (timestamp), datatype and value; append mode emits a day once it is closed.
    """
    days = records.withWatermark("ts", late).groupBy("station", "datatype", F.window("ts", "1 day").alias("w"))
    return days.agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")).select("station", "datatype", F.col("w.start").cast("date").alias("day"), "value", "n")
