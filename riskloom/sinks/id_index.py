"""Which ids are stored, and in which batch: an index of hash buckets with a Bloom filter for each file.

    units/<name>/entries/bucket=<n>/     ids and the batch that stored them
    units/<name>/filters/                for each bucket the filter of its ids
    index/manifest.json                  the units that count, and their levels

A batch adds one unit. A lookup reads the filters of the buckets that its ids fall into, about ten bits for each stored id
there, and opens only files whose filter says yes to one of its ids: a file for each id that is stored, and for one id
in a hundred and each unit by mistake. ``MERGE`` units of a level are merged into one of the next, so an id meets at most
``MERGE`` units a level and is rewritten once a level. A unit counts when the manifest names it, which is replaced
as a whole; a repeated batch replaces its own unit.

The driver holds the list of units and, for a lookup, the list of files to open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import staged
from riskloom.sources.segment_log import Folder

BITS_PER_ID = 10
HASHES = 7
MERGE = 8
_ENTRY = "transaction_id string, batch bigint"
_FILTER = "bucket int, ids bigint, bits binary"


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), F.col("transaction_id")), F.lit(buckets)).cast("int")


def _places(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """The bits of each id: ``HASHES`` rows."""
    step = h2.view(np.uint64) | np.uint64(1)
    return np.stack([(h1.view(np.uint64) + np.uint64(k) * step) % np.uint64(size) for k in range(HASHES)])


def bloom(h1: np.ndarray, h2: np.ndarray) -> bytes:
    size = max(64, -(-len(h1) * BITS_PER_ID // 8) * 8)
    flags = np.zeros(size, dtype=bool)
    flags[_places(h1, h2, size).ravel()] = True
    return np.packbits(flags).tobytes()


def may_hold(bits: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    flags = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return flags[_places(h1, h2, len(flags))].all(axis=0)


def _hashed(ids: DataFrame, buckets: int) -> DataFrame:
    return ids.select(
        "*", bucket_of(buckets).alias("bucket"), F.xxhash64("transaction_id").alias("h1"), F.xxhash64(F.lit(1), F.col("transaction_id")).alias("h2")
    )


@dataclass
class Probe:
    """What a lookup did: files that exist in its buckets, files opened, files opened in vain."""

    files: int = 0
    opened: int = 0
    in_vain: int = 0


@dataclass
class IdIndex:
    spark: SparkSession
    root: str
    buckets: int = 64
    last_probe: Probe = field(default_factory=Probe)

    def __post_init__(self) -> None:
        self._folder = Folder(self.root)

    def units(self) -> list[dict]:
        """The units that count: ``name``, ``level``, ``first`` and ``last`` batch."""
        if "manifest.json" not in self._folder.names("index"):
            return []
        return json.loads(self._folder.read("index/manifest.json"))["units"]

    def _publish(self, units: list[dict]) -> None:
        self._folder.replace("index/manifest.json", json.dumps({"units": units, "buckets": self.buckets}).encode())

    def _write(self, entries: DataFrame, level: int, first: int, last: int) -> dict:
        """A new unit; it does not count yet."""
        name = f"{last:012d}-{level}-{uuid.uuid4().hex[:8]}"
        path = f"{self.root}/units/{name}"
        rows = entries.select("transaction_id", F.col("batch").cast("bigint").alias("batch"), bucket_of(self.buckets).alias("bucket"))
        rows.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{path}/entries")
        written = self._entries(self._files(name))

        def filter_of(table: pa.Table) -> pa.Table:
            h1, h2 = (table.column(c).to_numpy() for c in ("h1", "h2"))
            return pa.table({"bucket": table.column("bucket")[:1], "ids": pa.array([len(h1)], pa.int64()), "bits": pa.array([bloom(h1, h2)], pa.binary())})

        hashed = _hashed(written.select("transaction_id"), self.buckets)
        hashed.groupBy("bucket").applyInArrow(filter_of, _FILTER).write.parquet(f"{path}/filters")
        return {"name": name, "level": level, "first": first, "last": last}

    def add(self, ids: DataFrame, batch: int) -> None:
        """Adds the ids (``transaction_id``) that a batch has stored; a repeated batch replaces what it added before."""
        unit = self._write(ids.select("transaction_id", F.lit(batch).alias("batch")), 0, batch, batch)
        kept = [u for u in self.units() if not (u["level"] == 0 and u["last"] == batch)]
        self._publish(self._merged([*kept, unit]))

    def load(self, entries: DataFrame, last: int) -> None:
        """Starts an index with ``transaction_id, batch`` of what is stored already, up to batch ``last``."""
        self._publish([self._write(entries, 1, 0, last)])

    def _merged(self, units: list[dict]) -> list[dict]:
        """Merges full levels. The newest batch stays a unit of its own, as it may be repeated."""
        level = 0
        while True:
            newest = max(u["last"] for u in units)
            mine = [u for u in units if u["level"] == level and not (level == 0 and u["last"] == newest)]
            if len(mine) < MERGE:
                if all(u["level"] <= level for u in units):
                    return units
            else:
                rows = self._entries([f for u in mine for f in self._files(u["name"])])
                merged = self._write(rows, level + 1, min(u["first"] for u in mine), max(u["last"] for u in mine))
                units = [u for u in units if u not in mine] + [merged]
            level += 1

    def _files(self, unit: str) -> list[str]:
        """The buckets of a unit that hold ids."""
        return [f"{unit}/entries/{n}" for n in self._folder.names(f"units/{unit}/entries") if n.startswith("bucket=")]

    def _entries(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).parquet(*[f"{self.root}/units/{f}" for f in files])

    def asked(self, ids: DataFrame) -> DataFrame:
        """The distinct ids as lookups need them, for several indexes with as many buckets."""
        return staged(_hashed(ids.select("transaction_id").distinct(), self.buckets), "asked-ids")

    def known(self, ids: DataFrame, before: int, asked: Callable[[], DataFrame] | None = None) -> DataFrame:
        """``transaction_id, batch`` of those of the ids that batches before the given one have stored.

        ``asked`` gives what ``asked(ids)`` has made of the same ids already; it is called only if there is something to look up.
        """
        units = [u for u in self.units() if u["first"] < before]
        if not units:
            return self.spark.createDataFrame([], "transaction_id string, batch bigint")
        asked = self.asked(ids) if asked is None else asked()
        filters = None
        for u in units:
            one = self.spark.read.schema(_FILTER).parquet(f"{self.root}/units/{u['name']}/filters").withColumn("unit", F.lit(u["name"]))
            filters = one if filters is None else filters.unionAll(one)
        hits_type = "unit string, bucket int, hits bigint"

        def test(left: pa.Table, right: pa.Table) -> pa.Table:
            h1, h2 = (left.column(c).to_numpy() for c in ("h1", "h2"))
            found = [
                int(may_hold(bits.as_py(), h1, h2).sum()) if len(h1) else 0 for bits in right.column("bits")
            ]
            return pa.table({"unit": right.column("unit"), "bucket": right.column("bucket"), "hits": pa.array(found, pa.int64())})

        wanted = filters.join(asked.select("bucket").distinct(), "bucket", "left_semi")
        hashes = asked.select("bucket", "h1", "h2")  # the ids themselves need not travel
        tested = staged(hashes.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(test, hits_type), "tested-files")
        files = tested.where("hits > 0").select("unit", "bucket").collect()  # no more than hits of the batch's ids
        self.last_probe = Probe(files=tested.count(), opened=len(files))
        if not files:
            return self.spark.createDataFrame([], "transaction_id string, batch bigint")
        entries = self._entries([f"{f['unit']}/entries/bucket={f['bucket']}" for f in files])
        met = entries.withColumn("path", F.input_file_name()).where(F.col("batch") < before).join(asked.select("transaction_id"), "transaction_id")
        met = staged(met, "known-ids")
        right = met.select(F.regexp_extract("path", "units/([^/]+)/entries/(bucket=[0-9]+)", 0)).distinct().count()
        self.last_probe.in_vain = len(files) - right
        return met.select("transaction_id", "batch")
