"""Requests as a stream: each id counts once, and daily numbers close when their day can't grow any more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accepted(requests: DataFrame, delay: str = "7 days") -> DataFrame:
    """The first row of each ``request`` id of a stream with an event time ``at``.

    Repeats that come within ``delay`` go; the state of older ids is dropped, so its size depends on the delay and not on
    the stream's length. A row without an id is a request of its own; rows without a time are left out.
    """
    own = F.coalesce(F.concat(F.lit("id:"), F.col("request")), F.expr("concat('none:', uuid())"))
    timed = requests.filter("at IS NOT NULL").withColumn("_own", own).withWatermark("at", delay)
    return timed.dropDuplicatesWithinWatermark(["_own"]).drop("_own")


def daily_counts(requests: DataFrame, delay: str = "7 days") -> DataFrame:
    """(med, day, n) of accepted requests, given out once a day is older than ``delay``."""
    days = accepted(requests, delay).groupBy("med", F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return days.select("med", F.to_date("w.start").alias("day"), "n")
