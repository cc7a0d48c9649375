"""The events as every query reads them."""

import datetime as dt

from riskloom.plans import streams
from riskloom.sources.segment_log import Log, read_log
from riskloom.sources.tables import events_as_messages, read_events


def events(spark, tmp_path, count):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=i), i % 7, "view", 1.5, '{"k": 3}') for i in range(count)]
    shape = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_a_file_of_one_row_group_is_dealt_over_all_cores(spark, tmp_path):
    table = read_events(spark, events(spark, tmp_path, 400))
    counts = [r["count"] for r in table.selectExpr("spark_partition_id() as task").groupBy("task").count().collect()]
    assert len(counts) >= spark.sparkContext.defaultParallelism and max(counts) <= 2 * 400 // len(counts)
    assert table.count() == 400


def test_the_log_is_written_in_short_segments_in_the_order_of_arrival(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "SEGMENT_ROWS", 50, raising=False)
    sf_dir = events(spark, tmp_path, 1_000)
    path, most = streams.arrival_log(spark, sf_dir)
    assert most == 25
    segments = Log(path).newest().segments
    assert sum(s.rows for s in segments) == 1_000 and max(s.rows for s in segments) <= 100

    def turn(i):
        return i + (200 if i % 11 == 0 else 50 if i % 7 == 0 else 0), i

    sent = {(r["partition"], r["offset"]): r["value"] for r in events_as_messages(read_events(spark, sf_dir)).collect()}
    got = {(r["partition"], r["offset"]): r["value"] for r in read_log(spark, path).collect()}
    for p in range(4):
        order = sorted(range(p, 1_000, 4), key=turn)
        assert [got[p, o] for o in range(len(order))] == [sent[p, i // 4] for i in order]
