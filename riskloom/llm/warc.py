"""WARC archives: a writer with revisit records and a sequential reader.

Writer: payload digests are grouped (the largest id of a digest is combined before the shuffle), pages meet the decision
for their digest, and each task writes its sorted pages to archives of its own in a folder that all executors share. An
archive is written under the name of the attempt and renamed at the end, so a task that runs again replaces its files by
equal ones. Reader: archives are dealt to tasks; each is read as a stream, gzip member by gzip member, so that a task holds
one record. Block and payload digests are verified.

Folders go through ``pyarrow.fs``: local and mounted paths, and object stores or HDFS where its libraries are installed.

Defined results: a null payload is an empty one; a null address becomes the record id; rows without id give records
without id and revisit a row with an id if there is one with their payload; rows that repeat the keeper's id and payload
are all responses. A damaged record gives a row with ``error`` set, and the reader goes on with the next one it finds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import warc_format as w
from riskloom.llm.shared import require, small_batches, stored
from riskloom.session import shared_folder

_MANIFEST = "file string, records long, bytes long"
_RECORD = (
    "file string, offset long, record_type string, record_id string, uri string, date string, payload binary, "
    "payload_digest string, refers_to string, error string"
)


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def decisions(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``id, digest, keeper`` of the rows that are revisits."""
    sized = pages.select("id", "digest").filter(F.col("bytes") >= min_bytes)
    groups = sized.groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).filter("n > 1")
    met = sized.join(groups, "digest").filter(F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper")))
    return met.select("id", "digest", "keeper").distinct()


def write_archives(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    uri: str = "url",
    payload: str = "html",
    *,
    min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = 1 << 30,
) -> DataFrame:
    """Writes a record for each row and returns the stored manifest ``file, records, bytes``."""
    require(pages, (key, uri, payload))
    small_batches(pages.sparkSession)
    body = F.coalesce(pages[payload], F.lit("")).cast("binary")
    rows = pages.select(
        pages[key].cast("long").alias("id"), pages[uri].alias("uri"), body.alias("payload"), F.sha1(body).alias("digest"), F.length(body).alias("bytes")
    )
    revisits = decisions(rows, min_bytes).select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "keeper")
    met = rows.join(revisits, rows["id"].eqNullSafe(revisits["rid"]) & (rows["digest"] == revisits["rdigest"]), "left")
    ready = met.select("id", "uri", "payload", "keeper").sortWithinPartitions("id", "uri", "payload")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        context = TaskContext.get()
        out, sink, written, records, number = [], None, 0, 0, 0

        def close() -> None:
            nonlocal sink, number
            sink.close()
            system.move(temporary, final)
            out.append((final, records, written))
            sink, number = None, number + 1

        for batch in batches:
            for page, address, data, keeper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    name = f"part-{context.partitionId():06d}-{number:04d}.warc.gz"
                    final = f"{root}/{name}"
                    temporary = f"{root}/.{name}.{context.taskAttemptId()}"
                    sink = system.open_output_stream(temporary, compression=None)
                    head = w.info(name, date)
                    sink.write(head)
                    written, records = len(head), 0
                record_id = f"urn:page:{'' if page is None else page}"
                target = w.safe_uri(address, record_id)
                if keeper is None:
                    record = w.response(record_id, target, date, data)
                else:
                    record = w.revisit(record_id, target, date, w.digest(data), f"urn:page:{keeper}")
                sink.write(record)
                written += len(record)
                records += 1
                if written >= archive_bytes:
                    close()
        if sink is not None:
            close()
        columns = list(zip(*out, strict=True)) or [[], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "records", "bytes"])

    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)
    return stored(ready.mapInArrow(write, _MANIFEST), "warc-manifest")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the archives named in ``file``, except those that describe the archive.

    An archive is read in sequence, so there is a task for each: a given number of partitions, as a list of names is
    so small that Spark would otherwise read all archives in one task.
    """
    require(files, ("file",))
    names = [part.split()[0] for part in _RECORD.split(", ")]
    kinds = [pa.binary() if n == "payload" else pa.int64() if n == "offset" else pa.string() for n in names]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(folder)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, size = [], 0
                with system.open_input_stream(file, compression=None, buffer_size=w.CHUNK) as stream:
                    for offset, content in w.members(stream):
                        row = _row(file, offset, content)
                        if row is None:
                            continue
                        rows.append(row)
                        size += len(row[6] or b"")
                        if len(rows) >= 256 or size >= 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                yield batch_of(rows)

    named = files.select("file").distinct()
    return named.repartition(max(1, named.count())).mapInArrow(read, _RECORD)


def _row(file: str, offset: int, content) -> tuple | None:
    try:
        if isinstance(content, w.BadRecord):
            raise content
        fields, block = w.parse(content)
        kind = fields.get("warc-type")
        if kind == "warcinfo":
            return None
        payload = w.payload_of(fields, block) if kind == "response" else None
    except w.BadRecord as error:
        return (file, offset, "invalid", None, None, None, None, None, None, str(error))
    plain = [fields.get(n, "").strip("<>") or None for n in ("warc-record-id", "warc-target-uri", "warc-date", "warc-refers-to")]
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return (file, offset, kind, plain[0], plain[1], plain[2], payload, stated, plain[3], None)


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
