"""The log in a folder: offsets, limits, restarts, repeated and unfinished batches."""

import json

import pytest

from riskloom.sources.segment_log import FORMAT, Log, LogStreamReader, LogStreamWriter, Segment, Written, append_to_log, read_log, register


def records(spark, rows):
    return spark.createDataFrame(rows, "key string, value binary, partition int")


def numbered(spark, n, partitions=3, start=0):
    rows = [(None if i % 5 == 0 else f"k{i % 7}", f"v{i}".encode(), i % partitions) for i in range(start, start + n)]
    return records(spark, rows).repartition(partitions, "partition").sortWithinPartitions("value")


def found(df):
    return sorted((r["partition"], r["offset"], bytes(r["value"])) for r in df.collect())


def check_offsets(rows):
    by = {}
    for p, offset, _ in rows:
        by.setdefault(p, []).append(offset)
    assert all(offsets == list(range(len(offsets))) for offsets in by.values())


def test_batch_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    register(spark)
    assert read_log(spark, path).count() == 0
    append_to_log(numbered(spark, 100), path)
    append_to_log(numbered(spark, 50, start=100, partitions=5), f"file://{path}")
    rows = found(read_log(spark, path))
    check_offsets(rows)
    assert sorted(v for *_, v in rows) == sorted(f"v{i}".encode() for i in range(150))
    assert {p for p, *_ in rows} == {0, 1, 2, 3, 4}
    first = read_log(spark, path, topic="t").where("partition = 0 and offset = 0").first()
    assert first["topic"] == "t" and (first["key"] is None or first["key"].startswith("k"))
    with pytest.raises(Exception, match="only appended"):
        records(spark, []).select("key", "value").write.format(FORMAT).mode("overwrite").option("path", path).save()


def test_partition_from_the_key(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(k, f"{k}-{i}".encode()) for i in range(5) for k in ("a", "b", None, "é")]
    append_to_log(spark.createDataFrame(rows, "key string, value binary").coalesce(1), path, partitions=3)
    at = {}
    for r in read_log(spark, path).orderBy("partition", "offset").collect():
        at.setdefault(r["key"], []).append((r["partition"], bytes(r["value"]).decode()[-1]))
    for key, seen in at.items():
        assert len({p for p, _ in seen}) == 1 and [n for _, n in seen] == list("01234")
    assert at[None][0][0] == 0


class Run:
    """A stream that collects batches; stopped and started again with the same checkpoint."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.path, self.checkpoint, self.options = spark, str(tmp_path / "log"), str(tmp_path / "checkpoint"), options
        self.batches = []

    def go(self):
        stream = read_log(self.spark, self.path, streaming=True, **self.options)
        query = stream.writeStream.foreachBatch(lambda df, n: self.batches.append(found(df))).option("checkpointLocation", self.checkpoint).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return [b for b in self.batches if b]


def test_stream_with_limit_new_partitions_and_restart(spark, tmp_path):
    run = Run(spark, tmp_path, most=7, position=str(tmp_path / "position"))
    append_to_log(numbered(spark, 60, partitions=2), run.path)
    batches = run.go()
    assert [len(b) for b in batches] == [14, 14, 14, 14, 4]
    assert [(p, o) for p, o, _ in batches[1]] == [(p, o) for p in (0, 1) for o in range(7, 14)]
    append_to_log(numbered(spark, 40, partitions=4, start=60), run.path)  # two partitions are new
    batches = run.go()
    rows = sorted(r for b in batches for r in b)
    check_offsets(rows)
    assert len(rows) == 100 and len(set(rows)) == 100
    assert run.go() == batches  # nothing new


def test_stream_without_limit(spark, tmp_path):
    run = Run(spark, tmp_path)
    append_to_log(numbered(spark, 30), run.path)
    assert len(run.go()) == 1
    append_to_log(numbered(spark, 6, start=30), run.path)
    assert [len(b) for b in run.go()] == [30, 6]


def test_a_planned_batch_that_did_not_run_is_not_skipped(tmp_path):
    log = Log(str(tmp_path / "log"))
    log.append([Segment(0, "x.parquet", 20)])
    options = {"path": str(tmp_path / "log"), "maxOffsetsPerPartition": "8", "position": str(tmp_path / "position")}
    reader = LogStreamReader(options, None)
    assert reader.latestOffset() == reader.latestOffset() == {"0": 8}  # asked twice, planned once
    [part] = reader.partitions({}, {"0": 8})
    assert (part.skip, part.take, part.first) == (0, 8, 0)
    again = LogStreamReader(options, None)  # the process was lost; Spark plans the same batch again, then asks on
    assert [(p.skip, p.take) for p in again.partitions({}, {"0": 8})] == [(0, 8)]
    assert again.latestOffset() == {"0": 16}
    assert [(p.skip, p.take) for p in again.partitions({"0": 8}, {"0": 16})] == [(8, 8)]
    with pytest.raises(ValueError):
        LogStreamReader({"path": "x", "maxOffsetsPerPartition": "8"}, None)


def test_only_needed_commits_are_read(tmp_path):
    log = Log(str(tmp_path / "log"))
    for i in range(20):
        log.append([Segment(i % 2, f"{i}.parquet", 10)])
    fresh = Log(str(tmp_path / "log"))
    parts = list(fresh.between({"0": 95, "1": 95}, {"0": 100, "1": 100}))
    assert sorted(s.file for s in parts) == ["18.parquet", "19.parquet"] and len(fresh._known) <= 4


def stream_out(spark, source, path, checkpoint):
    register(spark)
    stream = spark.readStream.schema("key string, value binary").parquet(source)
    query = stream.writeStream.format(FORMAT).option("path", path).option("writer", "w").option("checkpointLocation", checkpoint).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_stream_writes_each_record_once_after_a_lost_commit(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "log", "checkpoint"))
    spark.createDataFrame([(f"k{i}", f"v{i}".encode()) for i in range(50)], "key string, value binary").write.mode("append").parquet(source)
    stream_out(spark, source, path, checkpoint)
    rows = found(read_log(spark, path))
    assert len(rows) == 50
    for name in (tmp_path / "checkpoint/commits").iterdir():  # the job died after the log's commit, before its own
        if not name.name.startswith(".") and name.name != "metadata" or name.name.startswith(".0"):
            name.unlink()
    stream_out(spark, source, path, checkpoint)
    assert found(read_log(spark, path)) == rows
    spark.createDataFrame([("new", b"one more")], "key string, value binary").write.mode("append").parquet(source)
    stream_out(spark, source, path, checkpoint)
    rows = found(read_log(spark, path))
    assert len(rows) == 51
    check_offsets(rows)


def test_uncommitted_and_aborted_files_stay_unseen(spark, tmp_path):
    path = str(tmp_path / "log")
    append_to_log(numbered(spark, 9), path)
    before = found(read_log(spark, path))
    import pyarrow as pa

    writer = LogStreamWriter({"path": path, "writer": "w"})
    batch = pa.RecordBatch.from_pydict({"key": ["a"], "value": [b"x"]})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    assert found(read_log(spark, path)) == before  # a task has written, nothing is committed
    writer.abort([lost, None], 0)
    assert not (tmp_path / "log/data" / lost.segments[0][1]).exists()
    writer.commit([kept, None], 0)
    repeated = writer.write(iter([batch]))
    writer.commit([repeated], 0)
    assert len(found(read_log(spark, path))) == len(before) + 1
    assert not (tmp_path / "log/data" / repeated.segments[0][1]).exists()
    writer.commit([Written([])], 1)  # an empty batch counts as done
    assert json.loads((tmp_path / "log/commits" / f"{2:020d}.json").read_text())["writers"] == {"w": 1}


def test_topics_as_logs_hold_a_repeated_batch_once(spark, tmp_path):
    from payloads import payload

    from riskloom.config import EngineConfig
    from riskloom.sinks.ledger import FileLedger
    from riskloom.sinks.topics import TopicSinks
    from riskloom.sources.log import from_payloads
    from riskloom.streaming.job import run_batch

    topics = TopicSinks(EngineConfig(), FORMAT, str(tmp_path / "topics"))
    ledger = FileLedger(spark, str(tmp_path / "tables"))
    raw = from_payloads(spark, [payload(f"b{i}", seconds=5 * i, amount=1000) for i in range(6)] + ["poison"])
    for batch in (0, 0, 1):  # a repeat, then the same messages as a batch of their own
        run_batch(raw, EngineConfig(), ledger, topics, batch_id=batch)
    config = topics.config
    for topic, records in ((config.risk_topic, 12), (config.alerts_topic, 2), (config.invalid_topic, 2)):
        rows = found(read_log(spark, f"{topics.folder}/{topic}"))
        check_offsets(rows)
        assert len(rows) == records
    with pytest.raises(Exception, match="go together"):
        raw.selectExpr("cast(null as string) as key", "value").write.format(FORMAT).mode("append").option("path", str(tmp_path / "x")).option("writer", "w").save()
