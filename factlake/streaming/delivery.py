"""Streams into files: first deliveries of articles, and ledgers that a replayed batch does not change."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import Registry
from ..sources.scratch import folder
from ..sources.sinks import batch_sink, read_batches
from .jobs import event_stream, first_deliveries
from .ordered import drained

registry = Registry()


def into_ledger(rows: DataFrame, path: str, by: str) -> None:
    """Drains a stream into a ledger, a batch after the other, each once."""
    query = rows.writeStream.foreachBatch(batch_sink(path, by)).option("checkpointLocation", f"{path}/state-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination()


@registry.add("stream_first_deliveries", "SELECT event_id, min(user_id) AS user_id, min(event_type) AS event_type FROM events GROUP BY event_id")
def stream_first_deliveries(spark, sf_dir):
    """Every event delivered twice, kept once."""
    stream = event_stream(spark, sf_dir)
    return drained(first_deliveries(stream.union(stream))).select("event_id", "user_id", "event_type")


@registry.add("stream_ledger", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_ledger(spark, sf_dir):
    """Events drained twice into one ledger by kind, the second time as a replay of the same batches."""
    path = f"{folder(spark)}/ledger-{uuid.uuid4().hex}"
    rows = event_stream(spark, sf_dir).select("event_id", "user_id", "value", "event_type")
    for _ in range(2):
        into_ledger(rows, path, "event_type")
    ledger = read_batches(spark, path, "event_id long, user_id long, value double, event_type string", "event_type")
    return ledger.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))
