"""Stateful streams by files in several batches against plain loops in the order of time."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest

from factlake.streaming.ordered import drained, feed_breaker, limited_calls

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events(n=240):
    rng = random.Random(20)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([200, 1_000, 9_000, 40_000])
        kind = rng.choice(["error", "error", "ok"])
        rows.append((i, at, rng.randrange(4), kind, None if rng.random() < 0.1 else float(i)))
    rows += [(n, rows[-1][1], 1, "error", 1.0), (n + 1, rows[-1][1], 1, "ok", 2.0)]  # a tie
    return rows


def stream(spark, tmp_path, rows, batches, seed=1):
    """Rows in files that a batch each reads, out of order by less than ten seconds."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[1] + rng.random() * 9_000)
    size = -(-len(rows) // batches)
    for k in range(batches):
        part = pd.DataFrame([(i, START + timedelta(milliseconds=at), u, t, v) for i, at, u, t, v in rows[k * size : (k + 1) * size]], columns=["event_id", "ts", "user_id", "event_type", "value"])
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def ms(t):
    return round((t.replace(tzinfo=timezone.utc) - START).total_seconds() * 1000)


def breaker_log(rows, failures, pause, until):
    out = []
    for user in {r[2] for r in rows}:
        bad, opened, good = 0, None, None
        own = sorted((r for r in rows if r[2] == user and r[1] <= until), key=lambda r: (r[1], r[0]))
        for i, at, _, kind, value in [*own, (None, until, user, None, None)]:
            if opened is not None and at - opened >= pause:
                out.append((user, opened + pause, None, "half_open", 0, good))
                bad, opened = 0, None
            if i is None:
                continue
            if kind == "error" or value is None:
                bad += 1
                opened = at if bad >= failures else None
            else:
                bad, opened, good = 0, None, value
            out.append((user, at, i, "open" if opened is not None else "closed", bad, good))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 5])
def test_breaker_is_the_same_in_any_batches(spark, tmp_path, batches):
    rows = events()
    log = drained(feed_breaker(stream(spark, tmp_path, rows, batches), 3, 30, late="10 seconds")).collect()
    got = sorted(((r.user_id, ms(r.at), r.event_id, r.state, r.failures, r.last_good) for r in log), key=repr)
    assert got == breaker_log(rows, 3, 30_000, max(r[1] for r in rows) - 10_000)
    assert {s for _, _, _, s, _, _ in got} == {"open", "closed", "half_open"}


def test_idle_feeds_are_forgotten(spark, tmp_path):
    rows = [(1, 0, 1, "ok", 5.0), (2, 1_000, 1, "error", 1.0), (3, 900_000, 1, "error", 1.0), (4, 905_000, 2, "ok", 1.0), (5, 906_000, 2, "ok", 1.0)]
    log = drained(feed_breaker(stream(spark, tmp_path, rows, 3), 2, 30, keep_days=0.01)).collect()
    assert {(r.event_id, r.state, r.failures, r.last_good) for r in log if r.user_id == 1} == {(1, "closed", 0, 5.0), (2, "closed", 1, 5.0), (3, "closed", 1, None)}


@pytest.mark.parametrize("batches", [1, 4])
def test_fixed_windows(spark, tmp_path, batches):
    rows = events()
    log = drained(limited_calls(stream(spark, tmp_path, rows, batches, seed=3), 3, 60, late="10 seconds")).collect()
    until, want = max(r[1] for r in rows) - 10_000, []
    for user in {r[2] for r in rows}:
        start, n = None, 0
        for i, at, *_ in sorted((r for r in rows if r[2] == user and r[1] <= until), key=lambda r: (r[1], r[0])):
            if start is None or at - start >= 60_000:
                start, n = at, 0
            n += 1
            want.append((user, at, i, n, n <= 3))
    assert sorted((r.user_id, ms(r.at), r.event_id, r.call, r.allowed) for r in log) == sorted(want)
    assert {r.allowed for r in log} == {True, False}
