"""A partitioned log in a shared folder, as a Spark data source that can be read and written, in batches and as a stream.

    data/<unique name>.parquet          segments: records of one partition, in order
    commits/<number>.json               commits: segments with their first offsets, the ends of all partitions

A segment counts only when a commit names it, and a commit appears as a whole or not at all. So readers see committed
batches only; files of failed tasks stay unseen. Offsets of a partition are numbered through without gaps, in the order of
the commits. Each commit also holds the last batch of each writer: a stream that repeats a batch after a failure finds
it done, drops the new files and commits nothing, which leaves each record in the log once.

Reading as a stream: a query's checkpoint holds the offsets and wins on restart; the first run starts at the earliest
ones. New partitions are found with the commit that brings them. ``maxOffsetsPerPartition`` bounds a micro-batch. Spark
asks a Python source only for the newest offset, so the source itself must remember how far it has gone: it writes the
end of each planned batch to the file ``position``, before the batch runs.

One committer at a time for each log. The driver holds the ends of the partitions and the commits of one batch, never records.
Paths are local ones or URIs that ``pyarrow.fs`` can open.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

FORMAT = "segment_log"
RECORD = "key string, value binary, topic string, partition int, offset bigint"
_ROWS_PER_READ = 10_000


class Folder:
    """A folder of a local or remote file system."""

    def __init__(self, path: str) -> None:
        if "://" in path or path.startswith("file:"):
            self.files, self.root = fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
        else:
            self.files, self.root = fs.LocalFileSystem(), os.path.abspath(path)
        self.root = self.root.rstrip("/")

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, name: str) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(self.at(name), allow_not_found=True))
        return sorted(x.base_name for x in found if not x.base_name.startswith("."))

    def read(self, name: str) -> bytes:
        with self.files.open_input_stream(self.at(name)) as stream:
            return stream.readall()

    def replace(self, name: str, content: bytes) -> None:
        """Writes a file that appears as a whole."""
        target = self.at(name)
        folder, _, base = target.rpartition("/")
        self.files.create_dir(folder, recursive=True)
        hidden = f"{folder}/.{base}-{uuid.uuid4().hex}"
        with self.files.open_output_stream(hidden) as stream:
            stream.write(content)
        self.files.move(hidden, target)

    def drop(self, names: Sequence[str]) -> None:
        for name in names:
            if self.files.get_file_info(self.at(name)).type == fs.FileType.File:
                self.files.delete_file(self.at(name))


@dataclass(frozen=True)
class Segment:
    partition: int
    file: str
    rows: int
    first: int = 0

    @property
    def end(self) -> int:
        return self.first + self.rows


@dataclass(frozen=True)
class Commit:
    number: int
    segments: tuple[Segment, ...]
    ends: dict[str, int]
    writers: dict[str, int]

    def to_json(self) -> bytes:
        body = {"segments": [[s.partition, s.file, s.rows, s.first] for s in self.segments], "ends": self.ends, "writers": self.writers}
        return json.dumps(body).encode()

    @staticmethod
    def from_json(number: int, content: bytes) -> Commit:
        body = json.loads(content)
        return Commit(number, tuple(Segment(*x) for x in body["segments"]), body["ends"], body["writers"])


NOTHING = Commit(-1, (), {}, {})


class Log:
    """The commits of a log."""

    def __init__(self, path: str) -> None:
        self.folder = Folder(path)
        self._known: dict[int, Commit] = {}

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.folder.names("commits") if n.endswith(".json")]

    def commit_of(self, number: int) -> Commit:
        if number not in self._known:
            self._known[number] = Commit.from_json(number, self.folder.read(f"commits/{number:020d}.json"))
        return self._known[number]

    def newest(self) -> Commit:
        numbers = self.numbers()
        return self.commit_of(numbers[-1]) if numbers else NOTHING

    def between(self, start: dict[str, int], end: dict[str, int]) -> Iterator[Segment]:
        """Segments with offsets from ``start`` up to ``end``, newest first; older commits than needed are not read."""
        for number in reversed(self.numbers()):
            commit = self.commit_of(number)
            for segment in commit.segments:
                p = str(segment.partition)
                if segment.end > start.get(p, 0) and segment.first < end.get(p, 0):
                    yield segment
            if all(commit.ends.get(p, 0) <= start.get(p, 0) for p in commit.ends):
                return

    def append(self, segments: Sequence[Segment], writer: str | None = None, batch: int | None = None) -> bool:
        """Commits new segments behind the present ones; False if the writer has committed this batch before."""
        last = self.newest()
        if writer is not None and last.writers.get(writer, -1) >= batch:
            return False
        ends, placed = dict(last.ends), []
        for s in segments:
            first = ends.get(str(s.partition), 0)
            placed.append(Segment(s.partition, s.file, s.rows, first))
            ends[str(s.partition)] = first + s.rows
        writers = last.writers if writer is None else last.writers | {writer: batch}
        commit = Commit(last.number + 1, tuple(placed), ends, writers)
        self.folder.replace(f"commits/{commit.number:020d}.json", commit.to_json())
        return True


@dataclass
class Slice(InputPartition):
    """Records of a segment: ``skip`` of them left out, ``take`` read."""

    partition: int
    file: str
    first: int
    skip: int
    take: int


def slices(log: Log, start: dict[str, int], end: dict[str, int]) -> list[Slice]:
    out = []
    for s in log.between(start, end):
        lo = max(start.get(str(s.partition), 0), s.first)
        hi = min(end.get(str(s.partition), 0), s.end)
        out.append(Slice(s.partition, s.file, s.first, lo - s.first, hi - lo))
    return sorted(out, key=lambda x: (x.partition, x.first))


class _Reading:
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.topic = options["path"], options.get("topic", "transaction.events")

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # how Spark asks for a table without partitions
            return
        folder = Folder(self.path)
        skip, take, at = partition.skip, partition.take, partition.first + partition.skip
        with folder.files.open_input_file(folder.at(f"data/{partition.file}")) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=_ROWS_PER_READ, columns=["key", "value"]):
                if not take:
                    return
                part = batch.slice(min(skip, batch.num_rows), take)
                skip -= min(skip, batch.num_rows)
                n = part.num_rows
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("key"),
                            part.column("value"),
                            pa.array([self.topic] * n, pa.string()),
                            pa.array([partition.partition] * n, pa.int32()),
                            pa.array(range(at, at + n), pa.int64()),
                        ],
                        names=["key", "value", "topic", "partition", "offset"],
                    )
                take -= n
                at += n


class LogReader(_Reading, DataSourceReader):
    """All committed records."""

    def partitions(self) -> Sequence[InputPartition]:
        log = Log(self.path)
        return slices(log, {}, log.newest().ends)


class LogStreamReader(_Reading, DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        super().__init__(options, schema)
        given = options.get("maxOffsetsPerPartition")
        self.limit = None if given is None else int(given)
        self.position = options.get("position")
        if self.limit is not None and not self.position:
            raise ValueError("maxOffsetsPerPartition needs a file for the option position")
        if self.limit is not None and self.limit < 1:
            raise ValueError("maxOffsetsPerPartition must be at least 1")
        self.log = Log(self.path)
        self._planned: dict[str, int] | None = None

    def _place(self) -> tuple[Folder, str]:
        folder, _, name = self.position.rpartition("/")
        return Folder(folder), name

    def _last_planned(self) -> dict[str, int]:
        if self._planned is None:
            folder, name = self._place()
            there = name in folder.names("")
            self._planned = json.loads(folder.read(name)) if there else {}
        return self._planned

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        ends = self.log.newest().ends
        if self.limit is None:
            return ends
        at = self._last_planned()
        return {p: min(end, at.get(p, 0) + self.limit) for p, end in ends.items()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if self.limit is not None:
            self._planned = {p: max(n, self._last_planned().get(p, 0)) for p, n in end.items()}
            folder, name = self._place()
            folder.replace(name, json.dumps(self._planned).encode())
        return slices(self.log, start, end)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    segments: list[tuple[int, str, int]]


class _Writing:
    """Records go to the partition that the column ``partition`` names, or else to one that follows from the key; within a
    task they keep their order. Records without a key go to partition 0."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.count = int(options.get("partitions", "4"))

    def _partitions(self, batch: pa.RecordBatch) -> list[int]:
        if "partition" in batch.schema.names:
            return batch.column("partition").fill_null(0).to_pylist()
        return [0 if k is None else zlib.crc32(k if isinstance(k, bytes) else k.encode()) % self.count for k in batch.column("key").to_pylist()]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder = Folder(self.path)
        folder.files.create_dir(folder.at("data"), recursive=True)
        schema = pa.schema([("key", pa.string()), ("value", pa.binary())])
        name, open_files, rows = uuid.uuid4().hex, {}, {}
        try:
            for batch in iterator:
                to = pa.array(self._partitions(batch), pa.int32())
                for p in sorted(set(to.to_pylist())):
                    part = batch.filter(pc.equal(to, p))
                    if p not in open_files:
                        stream = folder.files.open_output_stream(folder.at(f"data/{name}-{p}.parquet"))
                        open_files[p] = stream, pq.ParquetWriter(stream, schema)
                        rows[p] = 0
                    open_files[p][1].write_table(pa.table([part.column("key").cast(pa.string()), part.column("value").cast(pa.binary())], schema=schema))
                    rows[p] += part.num_rows
        finally:
            for stream, writer in open_files.values():
                writer.close()
                stream.close()
        return Written([(p, f"{name}-{p}.parquet", n) for p, n in rows.items()])

    def _segments(self, messages: Sequence[Written | None]) -> list[Segment]:
        return [Segment(*s) for m in messages if m is not None for s in m.segments]

    def _drop(self, messages: Sequence[Written | None]) -> None:
        Folder(self.path).drop([f"data/{s.file}" for s in self._segments(messages)])


class LogWriter(_Writing, DataSourceArrowWriter):
    """With the options ``writer`` and ``batch`` a batch counts once, as a stream's does; without them each write counts."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.writer, batch = options.get("writer"), options.get("batch")
        self.batch = None if batch is None else int(batch)
        if (self.writer is None) != (self.batch is None):
            raise ValueError("writer and batch go together")

    def commit(self, messages) -> None:
        segments = self._segments(messages)
        if (segments or self.writer) and not Log(self.path).append(segments, self.writer, self.batch):
            self._drop(messages)

    def abort(self, messages) -> None:
        self._drop(messages)


class LogStreamWriter(_Writing, DataSourceStreamArrowWriter):
    """``writer`` names the stream; its batches count once, however often they are repeated."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.writer = options.get("writer", "stream")

    def commit(self, messages, batchId: int) -> None:
        if not Log(self.path).append(self._segments(messages), self.writer, batchId):
            self._drop(messages)

    def abort(self, messages, batchId: int) -> None:
        self._drop(messages)


class SegmentLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogStreamReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a log is only appended to")
        return LogWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> LogStreamWriter:
        return LogStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SegmentLogSource)


def read_log(
    spark: SparkSession, path: str, *, streaming: bool = False, topic: str = "transaction.events", most: int | None = None, position: str | None = None
) -> DataFrame:
    """Records with their coordinates: all committed ones, or as a stream with ``most`` records of a partition a batch."""
    register(spark)
    reader = (spark.readStream if streaming else spark.read).format(FORMAT).option("path", path).option("topic", topic)
    if most is not None:
        reader = reader.option("maxOffsetsPerPartition", most).option("position", position)
    return reader.load()


def append_to_log(records: DataFrame, path: str, *, partitions: int = 4) -> None:
    """Appends ``key, value`` (and perhaps ``partition``) records as one commit."""
    register(records.sparkSession)
    columns = ["key", "value"] + ["partition"] * ("partition" in records.columns)
    records.select(*columns).write.format(FORMAT).mode("append").option("path", path).option("partitions", partitions).save()
