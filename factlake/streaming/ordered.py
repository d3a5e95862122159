"""Stateful jobs that follow the events of a key in the order of their time, whatever batches bring them.

Events wait in state until the watermark has passed them, so what a batch holds decides nothing; a
timer wakes the key when the first of them is due. What is kept for a key is one small row and the
events younger than the watermark; idle keys are forgotten by a timer.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..registry import Registry
from ..sources.scratch import folder
from .jobs import event_stream

registry = Registry()

#: The state store that timers and lists of state need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = "at long, event_id long, event_type string, value double"


class InOrder(StatefulProcessor):
    """Events of a key by time, then id, once the watermark has passed them; times are in milliseconds."""

    kept: str  # schema of the row kept for a key

    def follow(self, own: tuple | None, events: list[tuple], now: int) -> tuple[tuple | None, list[tuple], int | None]:
        """(what is kept now, rows to give out, when to look again) after these events; now is the watermark."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.own = handle.getValueState("own", self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = lambda v: None if v is None or v != v else float(v)  # noqa: E731  # null numbers arrive as NaN
        events = [(int(r["at"]), int(r["event_id"]), r["event_type"], known(r["value"])) for r in rows]
        if events:
            self.waiting.appendList(events)
            self.handle.registerTimer(min(e[0] for e in events))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        events = sorted((tuple(e) for e in self.waiting.get()), key=lambda e: e[:2])
        ready, rest = [e for e in events if e[0] <= now], [e for e in events if e[0] > now]
        before = self.own.get()  # each call to state is a message to the JVM, so none is made twice
        own, out, again = self.follow(before, ready, now)
        if ready:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if own is not None:
            self.own.update(own)
        elif before is not None:
            self.own.clear()
        for at in {rest[0][0] if rest else None, again} - {None}:
            if at > now:
                self.handle.registerTimer(at)
        for row in out:
            yield self.row(key[0], *row)

    def close(self) -> None:
        pass


class Breaker(InOrder):
    """A breaker that opens at so many failures in a row and half-opens after a pause without an event."""

    kept = "good double, bad long, opened long, last long"
    row = Row("user_id", "at", "event_id", "state", "failures", "last_good")

    def __init__(self, failures: int, pause: int, keep: int):
        self.failures, self.pause, self.keep = failures, pause, keep

    def follow(self, own, events, now):
        good, bad, opened, last = own or (None, 0, None, None)
        out = []

        def half_open(until):
            nonlocal bad, opened
            if opened is not None and until - opened >= self.pause:
                out.append((opened + self.pause, None, "half_open", 0, good))
                bad, opened = 0, None

        for at, event_id, kind, value in events:
            half_open(at)
            if last is not None and at - last >= self.keep:
                good, bad, opened = None, 0, None
            last = at
            if kind == "error" or value is None:
                bad += 1
                opened = at if bad >= self.failures else None
            else:
                good, bad, opened = value, 0, None
            out.append((at, event_id, "closed" if opened is None else "open", bad, good))
        half_open(now)
        if last is not None and opened is None and now - last >= self.keep:
            return None, out, None
        return (good, bad, opened, last), out, None if last is None else opened + self.pause if opened is not None else last + self.keep


class FixedWindow(InOrder):
    """At most so many calls of a key in a window that begins with its first call."""

    kept = "start long, calls long"
    row = Row("user_id", "at", "event_id", "call", "allowed")

    def __init__(self, limit: int, window: int):
        self.limit, self.window = max(1, limit), max(1, window)

    def follow(self, own, events, now):
        start, calls = own or (None, 0)
        out = []
        for at, event_id, _, _ in events:
            if start is None or at - start >= self.window:
                start, calls = at, 0
            calls += 1
            out.append((at, event_id, calls, calls <= self.limit))
        if start is None or now - start >= self.window:
            return None, out, None
        return (start, calls), out, start + self.window


def _followed(events: DataFrame, processor: InOrder, schema: str, late: str) -> DataFrame:
    """Events with null time, key or id are in no key's order and are left out."""
    whole = events.where("ts IS NOT NULL AND user_id IS NOT NULL AND event_id IS NOT NULL").withColumn("ts", F.date_trunc("millisecond", "ts"))
    rows = whole.withWatermark("ts", late).select("ts", "user_id", F.unix_millis("ts").alias("at"), "event_id", "event_type", "value")
    out = rows.groupBy("user_id").transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.withColumn("at", F.timestamp_millis("at"))


def feed_breaker(events: DataFrame, failures: int = 3, pause_seconds: float = 30, keep_days: float = 30, late: str = "0 seconds") -> DataFrame:
    """(user_id, at, event_id, state, failures, last_good) after each event of a feed, and when its breaker half-opens.

    An error or a null value is a failure. `failures` of them in a row open the breaker (state
    open), a further one keeps it open; a good value closes it; a pause without an event half-opens
    it, with a row that has no event_id. A feed without events for keep_days is forgotten. Rows of
    a feed come in the order of their time once the watermark has passed them; the session's state
    store must be STORE.
    """
    processor = Breaker(failures, int(pause_seconds * 1000), int(keep_days * 86_400_000))
    return _followed(events, processor, "user_id long, at long, event_id long, state string, failures long, last_good double", late)


def limited_calls(events: DataFrame, limit: int = 10, window_seconds: float = 60, late: str = "0 seconds") -> DataFrame:
    """(user_id, at, event_id, call, allowed): each call's number in its key's fixed window, and whether the limit allows it."""
    return _followed(events, FixedWindow(limit, int(window_seconds * 1000)), "user_id long, at long, event_id long, call long, allowed boolean", late)


def drained(rows: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a streaming frame gives for what its sources hold now, from files in the shared folder."""
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    path = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        rows.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(rows.schema).parquet(path)


_EVENTS_SQL = "e AS (SELECT user_id, event_id, event_type, value, epoch_ms(CAST(ts AS TIMESTAMP)) AS ms FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_id IS NOT NULL)"
_FOLD = "{{'ms': {at}, 'failed': {failed}, 'value': {value}, 'good': {good}, 'bad': {bad}, 'opened': {opened}, 'opens': {opens}, 'halves': {halves}}}"


def _fold_sql(pause: int, failures: int) -> str:
    none, zero = "CAST(NULL AS {})", "CAST(0 AS BIGINT)"
    big, real = none.format("BIGINT"), none.format("DOUBLE")
    first = _FOLD.format(at=big, failed="false", value=real, good=real, bad=zero, opened=big, opens=zero, halves=zero)
    event = _FOLD.format(at="ms", failed="event_type = 'error' OR value IS NULL", value="value", good=real, bad=zero, opened=big, opens=zero, halves=zero)
    half = f"coalesce(x.ms - s.opened >= {pause}, false)"
    bad = f"CASE WHEN NOT x.failed THEN 0 WHEN {half} THEN 1 ELSE s.bad + 1 END"
    step = _FOLD.format(at="x.ms", failed="x.failed", value="x.value", good="CASE WHEN x.failed THEN s.good ELSE x.value END", bad=bad, opened=f"CASE WHEN {bad} >= {failures} THEN x.ms END", opens=f"s.opens + CAST({bad} >= {failures} AS BIGINT)", halves=f"s.halves + CAST({half} AS BIGINT)")
    return f"list_reduce(list_prepend({first}, list({event} ORDER BY ms, event_id)), lambda s, x: {step})"


@registry.add(
    "stream_feed_breaker",
    f"""WITH {_EVENTS_SQL}, f AS (SELECT user_id, count(*) AS events, {_fold_sql(86_400_000, 2)} AS s FROM e GROUP BY user_id), m AS (SELECT max(ms) AS now FROM e)
    SELECT user_id, events, s.opens AS opens, s.halves + CAST(coalesce(now - s.opened >= 86400000, false) AS BIGINT) AS half_opens, s.good AS last_good FROM f, m""",
)
def stream_feed_breaker(spark, sf_dir):
    """Feeds with two failures in a row and a day's pause: how often each was open or half-open, and its last good value."""
    log = drained(feed_breaker(event_stream(spark, sf_dir), failures=2, pause_seconds=86_400))
    count = lambda state: F.count(F.when(F.col("state") == state, 1))
    return log.groupBy("user_id").agg(F.count("event_id").alias("events"), count("open").alias("opens"), count("half_open").alias("half_opens"), F.max_by("last_good", F.struct("at", "event_id")).alias("last_good"))


@registry.add(
    "stream_limited_calls",
    f"""WITH {_EVENTS_SQL}, f AS (SELECT user_id, list_reduce(list_prepend({{'ms': CAST(NULL AS BIGINT), 'start': CAST(NULL AS BIGINT), 'n': CAST(0 AS BIGINT), 'no': CAST(0 AS BIGINT), 'windows': CAST(0 AS BIGINT)}}, list({{'ms': ms, 'start': CAST(NULL AS BIGINT), 'n': CAST(0 AS BIGINT), 'no': CAST(0 AS BIGINT), 'windows': CAST(0 AS BIGINT)}} ORDER BY ms, event_id)),
      lambda s, x: CASE WHEN s.start IS NULL OR x.ms - s.start >= 43200000 THEN {{'ms': x.ms, 'start': x.ms, 'n': CAST(1 AS BIGINT), 'no': s.no, 'windows': s.windows + 1}} ELSE {{'ms': x.ms, 'start': s.start, 'n': s.n + 1, 'no': s.no + CAST(s.n + 1 > 2 AS BIGINT), 'windows': s.windows}} END) AS s FROM e GROUP BY user_id)
    SELECT user_id, s.windows AS windows, s.no AS refused FROM f""",
)
def stream_limited_calls(spark, sf_dir):
    """Two calls of a user in twelve hours: windows begun and calls refused."""
    log = drained(limited_calls(event_stream(spark, sf_dir), limit=2, window_seconds=43_200))
    return log.groupBy("user_id").agg(F.count(F.when(F.col("call") == 1, 1)).alias("windows"), F.count(F.when(~F.col("allowed"), 1)).alias("refused"))
