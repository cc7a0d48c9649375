"""Watermarks from several partitions against a step-by-step version."""

import random

import pytest

from riskloom.operators.lateness import partition_watermarks, with_partition_lateness

SCHEMA = "arrival_batch long, source string, arrived_ms long, ts_ms long"


def brute(rows, disorder, idle):
    times = {}
    for batch, _, at, _ in rows:
        times[batch] = max(times.get(batch, at), at)
    sources = {r[1] for r in rows}
    opened = times[min(times)]
    out, so_far = {}, None
    for batch in sorted(times):
        lows = []
        for source in sources:
            before = [r for r in rows if r[1] == source and r[0] < batch]
            heard = max((times_of(rows, r[0], source) for r in before), default=opened)
            if times[batch] - heard < idle:
                lows.append(max((r[3] for r in before), default=None))
        if lows and None not in lows:
            so_far = min(lows) if so_far is None else max(so_far, min(lows))
        out[batch] = None if so_far is None else so_far - disorder
    return out


def times_of(rows, batch, source):
    return max(r[2] for r in rows if r[0] == batch and r[1] == source)


def marks(spark, rows, disorder=30, idle=100):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r[0]: r[1] for r in partition_watermarks(df, "arrival_batch", "source", "arrived_ms", disorder, idle).collect()}


def test_the_slowest_partition_holds_the_watermark_until_it_is_idle(spark):
    rows = [(b, "fast", b * 40, 1000 + b * 10) for b in range(12)]
    rows += [(0, "slow", 0, 500), (1, "slow", 40, 700)] + [(b, "slow", b * 40, 1040 + b) for b in (9, 10)]
    found = marks(spark, rows)
    assert found[0] is None
    assert found[1] == 470 and found[2] == 670 and found[3] == 670  # the slower one counts
    assert found[4] == 1000  # 120 ms after its last row it is idle: the newest of the other one
    assert found[9] == found[10] == found[11] == 1050  # it is back with older times; the watermark does not move back
    assert found == brute(rows, 30, 100)


def test_a_partition_without_rows_holds_back_at_first(spark):
    rows = [(b, "a", b * 40, 100 + b) for b in range(6)] + [(5, "b", 200, 90)]
    found = marks(spark, rows)
    assert found[1] is found[2] is None and found[3] == 72
    assert found == brute(rows, 30, 100)


@pytest.mark.parametrize("seed", range(3))
def test_same_as_step_by_step(spark, seed):
    rng = random.Random(seed)
    rows = []
    now = 1_700_000_000_000
    for batch in range(40):
        now += rng.choice([5, 30, 60, 250])
        for source in rng.sample(["a", "b", "c", None], rng.randrange(0, 4)):
            rows += [(batch, source, now, 1000 + batch * 20 + rng.randrange(-200, 200)) for _ in range(rng.randrange(1, 4))]
    rows = [r for r in rows if r[1] is not None]
    assert marks(spark, rows) == brute(rows, 30, 100)


def test_rows_without_batch_and_lateness(spark):
    rows = [(0, "a", 0, 1000), (1, "a", 40, 960), (1, "a", 40, 969), (1, "a", 40, 971), (None, "a", 40, 1), (2, "a", 80, 970)]
    found = with_partition_lateness(spark.createDataFrame(rows, SCHEMA), "arrival_batch", "source", "arrived_ms", 30, 100, 10).collect()
    assert sorted((r["ts_ms"], r["lateness"]) for r in found) == [
        (1, "ON_TIME"), (960, "LATE"), (969, "TOLERATED"), (970, "TOLERATED"), (971, "ON_TIME"), (1000, "ON_TIME"),
    ]
    assert marks(spark, spark.createDataFrame([], SCHEMA).collect() or [(0, "a", 0, 1)]) == {0: None}
