"""Bounded runs of the streaming form: going on after a stop, and what stays in the state."""

from payloads import payload

from riskloom.config import EngineConfig
from riskloom.sources.log import from_payloads
from riskloom.sources.segment_log import append_to_log
from riskloom.streaming.replay import replay, state_of


def feed(spark, path, *payloads):
    rows = from_payloads(spark, payloads)
    append_to_log(rows.selectExpr("cast(null as string) as key", "value", "partition").coalesce(1), path)


def rows_of(run):
    return sorted((r["transaction_id"], r["lateness"], r["risk_score"]) for r in run.evaluated.collect())


def test_a_second_run_goes_on_where_the_first_stopped(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "run")
    config = EngineConfig(allowed_lateness_seconds=60)
    feed(spark, log, *[payload(f"b{i}", seconds=5 * i, amount=1000) for i in (2, 0, 1)], "poison", payload("b0", seconds=1))
    run = replay(spark, log, folder, config=config)
    assert rows_of(run) == []  # all within the disorder allowed
    waiting = state_of(spark, run.checkpoint, "waiting").selectExpr("sum(size(user_map_value.rows)) as n").first()["n"]
    assert waiting == 3 and state_of(spark, run.checkpoint, "seen").count() == 3
    feed(spark, log, payload("clock", "other", seconds=100))
    run = replay(spark, log, folder, config=config)
    assert rows_of(run) == [("b0", "ON_TIME", 0), ("b1", "ON_TIME", 0), ("b2", "ON_TIME", 0)]
    feed(spark, log, payload("tolerated", seconds=12, amount=4000), payload("late", seconds=9), payload("b1", seconds=300))
    run = replay(spark, log, folder, config=config)
    assert rows_of(run)[3:] == [("late", "LATE", None), ("tolerated", "TOLERATED", 40)]  # 7,000 in ten minutes
    assert rows_of(replay(spark, log, folder, config=config)) == rows_of(run)  # nothing new, nothing again
    assert state_of(spark, run.checkpoint, "history").where("key.customer_id <> 'other'").count() == 4


def test_two_state_partitions_for_each_core(spark, tmp_path):
    log, folder = str(tmp_path / "log"), tmp_path / "run"
    feed(spark, log, payload("a"), payload("clock", "other", seconds=100))
    few = 2 * spark.sparkContext.defaultParallelism
    given = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(few + 5))
    try:
        run = replay(spark, log, str(folder))
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(few + 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", given)
    assert rows_of(run) == [("a", "ON_TIME", 0)]
    assert {len([p for p in (folder / "checkpoint/state" / n).iterdir() if p.name.isdigit()]) for n in ("0", "1")} == {few}
