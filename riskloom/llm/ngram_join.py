"""Similarity join on word n-grams with Bayesian candidate pruning.

Two documents are linked when the Jaccard similarity of their sets of five-word shingles is at least ``threshold``.

1. Each document gets a sketch: a hash of its shingle set, ``bands`` band keys of ``rows`` MinHash values each, and
   ``compared`` further MinHash values. Documents with the same set form a class; only its smallest id goes on.
2. Classes that share a band key meet in that bucket. A bucket of more than ``block`` classes is cut into blocks, and each
   pair of blocks is a unit of work of its own, so no task holds a whole large bucket.
3. In a unit, pairs are compared MinHash value by value, in steps of ``STEP``. After each step a pair is dropped when the
   posterior probability that its similarity reaches the threshold, given the matches so far and a uniform prior, is below
   ``tolerance``. A pair counts only in the first band in which it meets.
4. The shingle sets of the classes in surviving pairs come to the unit and the similarity is computed exactly. A unit gives
   back link counts and a spanning forest, never a row for each pair.
5. Link counts are added up; components come from the forests.

A pair at exactly 0.8 shares none of 25 bands of four values with probability 2e-6; pairs above do so less often.

Defined results: a text of one to four words has one shingle, the whole; a text without words (also null or empty) links
with nothing and is a class of its own. Rows with the same id count as one document, with the text whose set hash is
smallest. Rows without id are left out, as there is nothing to link. Texts of any length are used whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.components import components
from riskloom.llm.shared import keyed_text, small_batches, stored
from riskloom.llm.streams import groups

_WORDS = re.compile(r"[^\W_]+")
STEP = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered for up to a million of them."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def shingles(text: str, n: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the n-word shingles of a text."""
    found = _WORDS.findall(text.lower())
    if not found:
        return np.empty(0, dtype=np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(n, len(ids))
    with np.errstate(over="ignore"):
        total = np.full(len(ids) - width + 1, np.uint64(width))
        for k in range(width):
            total = (total ^ ids[k : k + len(total)]) * _MIX
            total ^= total >> np.uint64(29)
    return np.unique(total)


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds and odd multipliers of the MinHash functions; the same everywhere."""
    rng = np.random.default_rng(20240131)
    seeds = rng.integers(0, 2**32, count, dtype=np.uint32)
    return seeds[:, None], (rng.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1))[:, None]


def minhashes(found: np.ndarray, seeds: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each function over the shingles, in pieces, so that memory stays small for long texts."""
    least = np.full(len(seeds), np.uint32(0xFFFFFFFF))
    low = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(low), 4096):
            values = (low[None, at : at + 4096] ^ seeds) * factors
            values ^= values >> np.uint32(15)
            np.minimum(least, (values * np.uint32(0x2C1B3C6D)).min(axis=1), out=least)
    return least


def least_matches(threshold: float, tolerance: float, compared: int) -> list[tuple[int, int]]:
    """For each step: values compared so far, and the matches below which a pair is dropped.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1), and its mass above the threshold
    is the chance of at most m successes in n + 1 trials.
    """
    steps = []
    for n in range(STEP, compared + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance and m < n:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        steps.append((n, m))
    return steps


def sketches(docs: DataFrame, n: int, bands: int, rows: int, compared: int) -> DataFrame:
    """``doc_id, a, b, size, keys, sketch``; keys are the band keys, sketch is those and the compared values as bytes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        seeds, factors = _functions(bands * rows + compared)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingles(text, n, hashes)
                if not len(found):
                    out.append((doc, doc, 0, 0, None, None))
                    continue
                a, b = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), dtype="<i8").tolist()
                least = minhashes(found, seeds, factors)
                banded = least[: bands * rows].reshape(bands, rows)
                keys = np.array([xxhash.xxh32_intdigest(band.tobytes()) for band in banded], dtype=np.uint32)
                values = (least[bands * rows :] & np.uint32(0xFFFF)).astype(np.uint16)
                out.append((doc, a, b, len(found), keys.view(np.int32).tolist(), keys.tobytes() + values.tobytes()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "a", "b", "size", "keys", "sketch"])

    schema = "doc_id long, a long, b long, size int, keys array<int>, sketch binary"
    return docs.mapInArrow(sketch, schema)


def _unit_rows(classes: DataFrame, block: int) -> DataFrame:
    """``unit, id, side, own, size, copies, sketch``, once for each block pair of a shared bucket that a class is in."""
    light = classes.filter("keys is not null").select("id", F.posexplode("keys").alias("band", "key"))
    shared = light.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = light.join(shared, ["band", "key"]).select(
        "id", "band", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")
    )
    members = members.withColumn("mine", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    paired = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first, second = F.least("mine", "other"), F.greatest("mine", "other")
    units = paired.select(
        F.xxhash64("band", "key", first, second).alias("unit"),
        "id",
        (F.col("mine") == second).cast("int").alias("side"),
        (F.col("mine") == F.col("other")).cast("int").alias("own"),
        "band",
    )
    return units.join(classes.select("id", "size", "copies", "sketch"), "id").select(
        "unit", "id", "side", "own", "band", "size", "copies", "sketch"
    )


def _survivors(units: DataFrame, bands: int, compared: int, threshold: float, tolerance: float) -> DataFrame:
    """``unit, ids, pairs``: the classes of the unit that are in a pair left by the pruning, and the pairs as positions."""
    steps = least_matches(threshold, tolerance, compared)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            if table.num_rows < 2:
                continue
            ids, side, own, band, size = (table.column(i).to_numpy() for i in range(1, 6))
            raw = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
            keys = np.ascontiguousarray(raw[:, : 4 * bands]).view(np.uint32)
            values = np.ascontiguousarray(raw[:, 4 * bands :]).view(np.uint16)
            within = bool(own[0])
            left = np.arange(len(ids)) if within else np.flatnonzero(side == 0)
            right = left if within else np.flatnonzero(side == 1)
            found = []
            for i in left.tolist():
                js = right[right > i] if within else right
                least, most = size[i] * threshold, size[i] / threshold
                js = js[(size[js] >= least - 1e-9) & (size[js] <= most + 1e-9) & (ids[js] != ids[i])]
                if band[i] and len(js):  # pairs of an earlier band have been counted there
                    js = js[~(keys[js, : band[i]] == keys[i, : band[i]]).any(axis=1)]
                matches, seen = np.zeros(len(js), dtype=np.int64), 0
                for upto, needed in steps:
                    if not len(js):
                        break
                    matches += (values[js, seen:upto] == values[i, seen:upto]).sum(axis=1)
                    stay = matches >= needed
                    js, matches, seen = js[stay], matches[stay], upto
                if len(js):
                    found.append(np.column_stack([np.full(len(js), i), js]))
            if found:
                pairs = np.concatenate(found)
                used, positions = np.unique(pairs, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([table.column(0)[0].as_py()], pa.int64()),
                        pa.array([ids[used].tolist()], pa.list_(pa.int64())),
                        pa.array([positions.reshape(-1).astype("<u4").tobytes()], pa.binary()),
                    ],
                    names=["unit", "ids", "pairs"],
                )

    dealt = units.repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(prune, "unit long, ids array<long>, pairs binary")


def _forest(count: int, pairs: np.ndarray) -> np.ndarray:
    """For each position the least position it is connected with."""
    parent = list(range(count))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in pairs.tolist():
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.array([root(x) for x in range(count)], dtype=np.int64)


def similar(sets: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """The pairs of positions whose sets have at least the Jaccard similarity, computed exactly."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    vocabulary, flat = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    marked = np.zeros(len(vocabulary), dtype=bool)
    linked = []
    order = np.argsort(pairs[:, 0], kind="stable")
    pairs = pairs[order]
    cuts = np.flatnonzero(np.r_[True, np.diff(pairs[:, 0]) != 0])
    for lo, hi in zip(cuts, [*cuts[1:], len(pairs)], strict=True):
        i, js = pairs[lo, 0], pairs[lo:hi, 1]
        mine = flat[starts[i] : ends[i]]
        marked[mine] = True
        if 2 * len(js) >= len(sets):
            common = np.add.reduceat(marked[flat], starts)[js].astype(np.int64)
        else:
            common = np.array([np.count_nonzero(marked[flat[starts[j] : ends[j]]]) for j in js])
        marked[mine] = False
        union = sizes[i] + sizes[js] - common
        linked.append(pairs[lo:hi][common >= threshold * union - 1e-9])
    return np.concatenate(linked)


def _links(survivors: DataFrame, docs: DataFrame, classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """``id, links, class_links, root`` of each unit; links counts documents, root is the least class reached there."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t, n, hashes).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets, pa.binary())], names=["id", "copies", "found"])

    needed = survivors.select("unit", F.explode("ids").alias("id"))
    wanted = needed.select("id").distinct().join(classes.select("id", "copies"), "id")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id").select("id", "text", "copies")
    sets = texts.mapInArrow(hashed, "id long, copies long, found binary").dropDuplicates(["id"])
    rows = needed.join(sets, "id").select("unit", "id", "copies", "found", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("binary").alias("pairs"))
    pairs = survivors.select(
        "unit", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("copies"), F.lit(None).cast("binary").alias("found"), "ids", "pairs"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            known, lists = {}, []
            for row in table.to_pylist():
                if row["ids"] is None:
                    known[row["id"]] = (row["copies"], np.frombuffer(row["found"], np.uint64))
                else:
                    lists.append((row["ids"], np.frombuffer(row["pairs"], "<u4").reshape(-1, 2).astype(np.int64)))
            for ids, at in lists:
                order = np.argsort(np.array(ids))
                rank = np.empty(len(ids), dtype=np.int64)
                rank[order] = np.arange(len(ids))
                ids = [ids[k] for k in order]
                linked = similar([known[i][1] for i in ids], rank[at], threshold)
                if not len(linked):
                    continue
                copies = np.array([known[i][0] for i in ids], dtype=np.int64)
                links = np.bincount(linked[:, 0], copies[linked[:, 1]], len(ids)) + np.bincount(linked[:, 1], copies[linked[:, 0]], len(ids))
                number = np.bincount(linked.ravel(), minlength=len(ids))
                ids, roots = np.array(ids), _forest(len(ids), linked)
                hit = number > 0
                columns = (ids[hit], links[hit].astype(np.int64), number[hit].astype(np.int64), ids[roots][hit])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "links", "class_links", "root"])

    dealt = rows.unionAll(pairs).repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(verify, "id long, links long, class_links long, root long")


def ngram_join(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    n: int = 5,
    threshold: float = 0.8,
    bands: int = 25,
    rows: int = 4,
    compared: int = 64,
    tolerance: float = 1e-5,
    block: int = 1024,
) -> DataFrame:
    """One row for each id: ``doc_id, class_id, n_links, n_class_links, component_id``.

    class_id is the smallest id with the same shingle set; n_links counts all other documents at or above the threshold,
    copies included; n_class_links the other classes; component_id is the smallest id reachable by links.
    """
    small_batches(docs.sparkSession)
    texts = keyed_text(docs, key, text).filter("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    sketched = stored(sketches(texts, n, bands, rows, compared), "sketches")
    first = F.min(F.struct("a", "b", "size"))
    single = sketched.groupBy("doc_id").agg(first.alias("s")).select("doc_id", "s.*")  # rows with one id are one document
    sets = single.groupBy("a", "b", "size").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    chosen = sketched.select("doc_id", "a", "b", "size", "keys", "sketch").dropDuplicates(["doc_id", "a", "b"])
    joined = sets.join(chosen.select(F.col("doc_id").alias("id"), "a", "b", "keys", "sketch"), ["id", "a", "b"])
    classes = stored(joined.select("id", "a", "b", "size", "copies", "keys", "sketch"), "classes")
    survivors = stored(_survivors(_unit_rows(classes, block), bands, compared, threshold, tolerance), "survivors")
    links = stored(_links(survivors, texts, classes, n, threshold), "links")
    counted = links.groupBy("id").agg(F.sum("links").alias("links"), F.sum("class_links").alias("class_links"))
    reached = components(links.select(F.col("id").alias("u"), F.col("root").alias("v")))
    found = (
        classes.select("id", "a", "b", "size", "copies")
        .join(counted, "id", "left")
        .join(reached.select(F.col("node").alias("id"), "component"), "id", "left")
    )
    return single.join(found.drop("size"), ["a", "b"]).select(
        "doc_id",
        F.col("id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.when(F.col("size") > 0, F.col("copies") - 1).otherwise(0)).cast("long").alias("n_links"),
        F.coalesce("class_links", F.lit(0)).cast("long").alias("n_class_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
