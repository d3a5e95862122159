"""Structured Streaming jobs over event files; the same code runs on any streaming source."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import Registry
from ..sources.bridge import read

registry = Registry()


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event files of a folder as a stream."""
    schema = read(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums by kind in tumbling windows; rows later than the watermark are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def usage(events: DataFrame, cap: int = 3, late: str = "1 day") -> DataFrame:
    """Calls of each user in a UTC day against a cap; a cap of 0 or less is none."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id").agg(F.count("*").alias("calls"))
    return grouped.select(F.col("window.start").alias("day"), "user_id", "calls", (F.lit(cap > 0) & (F.col("calls") > cap)).alias("over_cap"))


def first_deliveries(events: DataFrame, within: str = "7 days") -> DataFrame:
    """The first delivery of each article within the watermark."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["event_id"])


def feed_health(events: DataFrame, failures: int = 3) -> DataFrame:
    """Last good value of each feed and whether its breaker is open, kept in state by feed.

    The rows that a trigger brings for a feed are put in order together.
    """

    def follow(key, batches, state):
        good, bad = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind, value in rows[["event_type", "value"]].itertuples(index=False):
            failed = kind == "error" or pd.isna(value)
            good, bad = (good, bad + 1) if failed else (float(value), 0)
        state.update((good, bad))
        yield pd.DataFrame({"user_id": [key[0]], "last_good": [good], "failures": [bad], "is_open": [bad >= failures]})

    return events.groupBy("user_id").applyInPandasWithState(follow, "user_id long, last_good double, failures long, is_open boolean", "good double, bad long", "update", "NoTimeout")


@registry.add("stream_window_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_window_counts(spark, sf_dir):
    """window_counts() as a batch: the same transformation on the whole table."""
    return window_counts(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@registry.add("stream_usage", "SELECT date_trunc('day', ts) AS day, user_id, count(*) AS calls, count(*) > 3 AS over_cap FROM events GROUP BY ALL")
def stream_usage(spark, sf_dir):
    return usage(read(spark, sf_dir, "events"))
