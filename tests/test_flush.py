"""Flush batches against a loop over the rows."""

import random

import pytest

from riskloom.operators.flush import flush_batches

SCHEMA = "writer string, t long, id long"


def brute(rows, most, within):
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        mine = sorted((t, i) for k, t, i in rows if k == key and t is not None)
        batches = []
        for t, i in mine:
            if batches and len(batches[-1]) < most and t < batches[-1][0][0] + within:
                batches[-1].append((t, i))
            else:
                batches.append([(t, i)])
        out += [(key, n, len(b), b[0][1], b[0][0], b[-1][0]) for n, b in enumerate(batches, start=1)]
    return sorted(out)


@pytest.mark.parametrize("most, within, slice_rows", [(5, 20, 16), (500, 200, 10**6), (1, 7, 3), (40, 3, 40), (7, 10**9, 8)])
def test_same_as_a_loop(spark, most, within, slice_rows):
    rng = random.Random(most)
    rows, t = [], 0
    for i in range(600):
        t += rng.choice([0, 0, 1, 2, 3, 30])
        rows.append((rng.choice(["hot"] * 8 + ["a", "b"]), t, i))
    rows += [("one", 5, 9000), (None, 5, 9001), ("a", None, 9002), ("same", 77, 1), ("same", 77, 2), ("same", 77, 3)]
    rng.shuffle(rows)
    found = flush_batches(spark.createDataFrame(rows, SCHEMA), "writer", "t", "id", most_rows=most, within_ms=within, slice_rows=slice_rows)
    assert sorted(map(tuple, found.collect())) == brute(rows, most, within)


def test_empty_and_limits(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert flush_batches(empty, "writer", "t", "id").count() == 0
    with pytest.raises(ValueError):
        flush_batches(empty, "writer", "t", "id", most_rows=0)
