"""The id index: same answers as a plain set, few files opened, merges, repeated batches."""

import numpy as np

from riskloom.sinks.id_index import MERGE, IdIndex, bloom, may_hold


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "transaction_id string")


def test_false_positives_of_a_filter():
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63, (4, 50_000), dtype=np.int64)
    bits = bloom(h[0], h[1])
    assert may_hold(bits, h[0], h[1]).all()
    assert may_hold(bits, h[2], h[3]).mean() < 0.015
    assert len(bits) * 8 <= 10 * 50_000 + 8
    assert not may_hold(bloom(h[0][:0], h[1][:0]), h[2], h[3]).any()


def test_known_ids_over_many_batches(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "ids"), buckets=8)
    stored = {}
    assert index.known(ids(spark, ["a"]), 5).collect() == []
    for batch in range(MERGE + 3):
        mine = [f"t{batch}-{i}" for i in range(40)]
        index.add(ids(spark, mine), batch)
        stored |= dict.fromkeys(mine, batch)
    levels = [u["level"] for u in index.units()]
    assert levels.count(1) == 1 and levels.count(0) == 3 and len(levels) == 4
    asked = ["t0-1", "t3-7", "t10-39", "t99-1", "none", "t3-7"]
    found = {tuple(r) for r in index.known(ids(spark, asked), 100).collect()}
    assert found == {("t0-1", 0), ("t3-7", 3), ("t10-39", 10)}
    probe = index.last_probe
    assert probe.opened <= 3 + probe.in_vain and probe.in_vain <= 2 and probe.opened < probe.files
    assert {tuple(r) for r in index.known(ids(spark, asked), 3).collect()} == {("t0-1", 0)}  # earlier batches only
    everything = index.known(ids(spark, [*stored, "x", "y"]), 100).collect()
    assert {tuple(r) for r in everything} == set(stored.items()) and len(everything) == len(stored)


def test_a_repeated_batch_replaces_its_own(spark, tmp_path):
    index = IdIndex(spark, f"file://{tmp_path}/ids", buckets=4)
    for batch in range(MERGE + 1):
        index.add(ids(spark, [f"b{batch}"]), batch)
    index.add(ids(spark, ["other"]), MERGE)  # the newest one is never merged, so it can be replaced
    assert {r[0] for r in index.known(ids(spark, ["b0", f"b{MERGE}", "other"]), 99).collect()} == {"b0", "other"}
    index.add(ids(spark, []), MERGE + 1)
    assert index.known(ids(spark, ["other"]), 99).count() == 1


def test_one_preparation_of_ids_serves_two_indexes(spark, tmp_path):
    first, second = (IdIndex(spark, str(tmp_path / name), buckets=4) for name in ("first", "second"))
    first.add(ids(spark, ["a", "b"]), 0)
    made = []

    def asked():
        if not made:
            made.append(first.asked(ids(spark, ["a", "c", "a"])))
        return made[0]

    assert second.known(ids(spark, ["a"]), 1, asked).collect() == [] and not made  # nothing to look up
    second.add(ids(spark, ["c"]), 0)
    assert [tuple(r) for r in first.known(ids(spark, ["a", "c"]), 1, asked).collect()] == [("a", 0)]
    assert [tuple(r) for r in second.known(ids(spark, ["a", "c"]), 1, asked).collect()] == [("c", 0)]
