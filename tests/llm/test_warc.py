import base64
import gzip
import hashlib
import io

import pytest

from riskloom.llm import warc_format as w
from riskloom.llm.warc import read_archives, write_archives


def pages(spark):
    rows = [(i, f"http://x.example/{i}", f"<p>page {i % 7}</p>" * (i % 5)) for i in range(60)]
    rows += [(100, None, None), (101, "http://x.example/a\r\nX-Bad: 1 ü", ""), (102, "u", "<p>é汉</p>" * 60_000), (None, "n", "<p>page 3</p>" * 3)]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string"), rows


def expected(rows, min_bytes=0):
    largest, size = {}, lambda h: len((h or "").encode())
    for i, _, html in rows:
        if i is not None:
            largest[html or ""] = max(i, largest.get(html or "", -1))
    out = {}
    for i, _, html in rows:
        keeper = largest.get(html or "")
        again = size(html) >= min_bytes and keeper is not None and keeper != i
        out[i] = ("revisit" if again else "response", keeper if again else None, base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode())
    return out


@pytest.mark.parametrize("options", [{}, {"min_bytes": 20, "archive_bytes": 700}])
def test_round_trip(spark, tmp_path, options):
    df, rows = pages(spark)
    manifest = write_archives(df, str(tmp_path / "warc"), **options)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    records = read_archives(manifest, str(tmp_path / "warc")).collect()
    assert all(r["error"] is None for r in records)
    plain = lambda x: None if x in (None, "urn:page:") else int(x.removeprefix("urn:page:"))
    found = {plain(r["record_id"]): (r["record_type"], plain(r["refers_to"]), r["payload_digest"]) for r in records}
    assert len(records) == len(rows) and found == expected(rows, options.get("min_bytes", 0))
    html = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r["payload"]) == html[plain(r["record_id"])] for r in records if r["record_type"] == "response")
    assert not [p for p in (tmp_path / "warc").iterdir() if p.name.startswith(".part")]


def test_members_are_gzip_and_headers_stay_whole():
    record = w.response("urn:page:1", w.safe_uri("http://a\r\nEvil: 1", "x"), "2024-01-01T00:00:00Z", b"body\r\n\r\nmore")
    fields, block = w.parse(gzip.decompress(record))
    assert "evil" not in fields and w.payload_of(fields, block) == b"body\r\n\r\nmore"
    assert record == w.response("urn:page:1", w.safe_uri("http://a\r\nEvil: 1", "x"), "2024-01-01T00:00:00Z", b"body\r\n\r\nmore")


class Slow(io.BytesIO):
    def read(self, n=-1):
        return super().read(3)  # members and headers lie across reads


def test_incremental_reading_and_damage():
    records = [w.response(f"urn:page:{i}", "u", "2024-01-01T00:00:00Z", bytes([65 + i]) * 300) for i in range(4)]
    whole = list(w.members(Slow(b"".join(records))))
    assert [o for o, _ in whole] == [sum(map(len, records[:k])) for k in range(4)]
    assert [w.payload_of(*w.parse(c))[:1] for _, c in whole] == [b"A", b"B", b"C", b"D"]
    broken = bytearray(records[1])
    broken[len(broken) // 2] ^= 255
    found = list(w.members(io.BytesIO(records[0] + bytes(broken) + records[2])))
    good = [c for _, c in found if not isinstance(c, w.BadRecord)]
    assert any(isinstance(c, w.BadRecord) for _, c in found)
    assert [w.payload_of(*w.parse(c))[:1] for c in (good[0], good[-1])] == [b"A", b"C"]
    cut = list(w.members(io.BytesIO(records[0] + records[1][:-9])))
    assert isinstance(cut[1][1], w.BadRecord)
    assert list(w.members(io.BytesIO(b""))) == []


@pytest.mark.parametrize("old,new", [(b"Content-Length: 7", b"Content-Length: 6"), (b"abcdefg", b"abcdefx"), (b"WARC/1.1", b"HTTP/1.1"), (b"Content-Length: 7\r\n", b"")])
def test_framing_and_digests_are_checked(old, new):
    content = gzip.decompress(w.member([("WARC-Type", "resource")], b"abcdefg"))
    assert w.parse(content)[1] == b"abcdefg"
    with pytest.raises(w.BadRecord):
        w.parse(content.replace(old, new, 1))


def test_empty_table(spark, tmp_path):
    df, _ = pages(spark)
    assert read_archives(write_archives(df.limit(0), str(tmp_path / "none")), str(tmp_path / "none")).count() == 0


def test_a_reading_task_for_each_archive_by_default(spark, tmp_path):
    """Also where Spark joins small partitions, as an ordinary session does."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        df = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>" * 50) for i in range(400)], "page_id long, url string, html string")
        folder = str(tmp_path / "warc")
        manifest = write_archives(df, folder, archive_bytes=2_000)
        archives = manifest.count()
        records = read_archives(manifest, folder)
        from pyspark.sql import functions as F

        tasks = records.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("file").alias("files")).collect()
        assert archives > 10 and len(tasks) == archives and all(t["files"] == 1 for t in tasks)
        assert records.count() == 400
    finally:
        spark.conf.set(name, before)
