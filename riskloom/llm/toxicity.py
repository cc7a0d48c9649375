"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut into windows, each a word
with the spaces around it; each window is compressed with either dictionary, and the difference of the two lengths says
which text it is closer to. The weights of those differences are calibrated on labelled rows that no dictionary has seen.

Training of a dictionary reads whole passages of the labelled texts of its class, in three steps. Runs of ``RUN`` bytes
are counted by document in both classes. The stretches of a text that consist of runs which its class has clearly more
often (by z and by ratio) are its passages. zstandard's trainer makes a dictionary of ``dictionary_bytes`` out of them; what it
leaves out is appended, most frequent last, while it fits. Both dictionaries are padded to one length, as a match further
back costs more. The size is small on purpose: beyond some 14 KB a match of a short word costs as much as its letters.

Training reads the whole texts of at most ``rows_per_class`` labelled rows of a class and part; scoring reads all rows.
Only passages up to a multiple of the dictionary's size and the window counts of the calibration rows reach the driver.

Defined results: null and empty texts have no window and get the score of a text without hits; rows with a null label
are not learned from; a document labelled twice counts as toxic if one label says so; if a class is missing among the
training or the calibration rows, the score is the share of toxic rows among all labelled ones (0 if there are none).
Repeated rows get equal scores. All windows of a very long text are scored; memory does not grow beyond the text. Columns
of the input other than id and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import require, stored

WINDOW_BYTES = 24  # a longer word is cut
RUN = 7
GAPS = 16  # differences are counted up to this many bytes, to either side
LEVELS = (1, 2, 3, 4, 5, 6, 8, 10)
WINDOWS_REMEMBERED = 150_000  # differences of a task's windows, about 20 MB
TEXTS_COUNTED = 48  # at once, as a text has many runs
#: Both dictionaries end with these bytes and every window starts with them. zstandard then always finds one match, so
#: that a further match costs the same whether or not the window has others.
CARRIER = b"0123456789#@+=~^0123"
#: zstandard begins no match in the last eight bytes, so each window ends with eight of no account.
TAIL = b"~^=@#+39"


@dataclass(frozen=True)
class ToxicityModel:
    toxic_dictionary: bytes
    ordinary_dictionary: bytes
    weights: tuple[float, ...]
    window_bytes: int = WINDOW_BYTES
    prior: float = 0.0


def windows(text: str, size: int = WINDOW_BYTES) -> Iterator[bytes]:
    """The words of the lower-cased text, each between spaces; a word of more than ``size`` bytes gives several."""
    for word in text.lower().encode("utf-8", "surrogatepass").split():
        if len(word) <= size:
            yield b" " + word + b" "
        else:
            for at in range(0, len(word), size):
                yield b" " * (at == 0) + word[at : at + size] + b" " * (at + size >= len(word))


def _compressor(content: bytes):
    """A compressor for tiny inputs: matches from four bytes on, no frame extras that would add a constant."""
    settings = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        strategy=zstandard.STRATEGY_LAZY2,
        min_match=4,
        window_log=18,
        hash_log=17,
        chain_log=17,
        search_log=6,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=dictionary)


def _gap_function(toxic: bytes, ordinary: bytes):
    """Of a window: the bytes that the toxic dictionary saves against the ordinary one. Equal windows are measured once."""
    longest = max(len(toxic), len(ordinary))  # equal lengths, so that distances cost the same in both
    first, second = (_compressor(x.rjust(longest, b" ") + CARRIER).compress for x in (toxic, ordinary))
    known: dict[bytes, int] = {}

    def gap(window: bytes) -> int:
        found = known.get(window)
        if found is None:
            if len(known) >= WINDOWS_REMEMBERED:
                known.clear()
            framed = CARRIER + window + TAIL
            found = known[window] = len(second(framed)) - len(first(framed))
        return found

    return gap


def _counts(texts, gap, size: int) -> np.ndarray:
    """For each text: its windows by difference, from -GAPS to GAPS."""
    out = np.zeros((len(texts), 2 * GAPS + 1), dtype=np.int64)
    for row, text in zip(out, texts, strict=True):
        for value, n in Counter(map(gap, windows(text or "", size))).items():
            row[min(max(value, -GAPS), GAPS) + GAPS] += n
    return out


def _features(counts: np.ndarray) -> np.ndarray:
    """Of each text: how many windows reach each level on either side, as a count and against the length."""
    n = counts.sum(axis=1)
    toxic = [counts[:, GAPS + k :].sum(axis=1) for k in LEVELS]
    ordinary = [counts[:, : GAPS + 1 - k].sum(axis=1) for k in LEVELS]
    reached = np.column_stack(toxic + ordinary).astype(float)
    return np.column_stack([np.ones(len(n)), np.log1p(n), np.log1p(reached), 30.0 * reached / (n + 10.0)[:, None]])


def _counts_udf(toxic: bytes, ordinary: bytes, size: int):
    @F.pandas_udf("array<long>")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        gap = _gap_function(toxic, ordinary)
        for texts in batches:
            yield pd.Series(list(_counts(texts, gap, size)))

    return counts


def _score_udf(model: ToxicityModel):
    weights = np.array(model.weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        gap = _gap_function(model.toxic_dictionary, model.ordinary_dictionary)
        for texts in batches:
            x = _features(_counts(texts, gap, model.window_bytes))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))

    return score


def _plain(text: str | None) -> bytes:
    """The lower-cased text with single spaces between and around its words."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return b" " + b" ".join(words) + b" " if words else b""


def _runs(data: bytes) -> set[bytes]:
    return {data[i : i + RUN] for i in range(len(data) - RUN + 1)}


def _run_counts(once: DataFrame) -> DataFrame:
    """``run, toxic, ordinary``: the documents of each class that hold a run of bytes, added up for a few texts at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_COUNTED):
                part = batch.slice(at, TEXTS_COUNTED)
                found: tuple[Counter, Counter] = (Counter(), Counter())
                for label, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found[label].update(_runs(_plain(text)))
                runs = list(found[0].keys() | found[1].keys())
                columns = [pa.array(runs, pa.binary()), *(pa.array([found[y][r] for r in runs], pa.int64()) for y in (1, 0))]
                yield pa.RecordBatch.from_arrays(columns, names=["run", "toxic", "ordinary"])

    counted = once.select("label", "text").mapInArrow(count, "run binary, toxic long, ordinary long")
    return counted.groupBy("run").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _passages(data: bytes, runs: frozenset[bytes]) -> list[bytes]:
    """The longest stretches that consist of the given runs."""
    out, begin, end = [], -1, -1
    for i in range(len(data) - RUN + 1):
        if data[i : i + RUN] in runs:
            if i > end:
                if end > 0:
                    out.append(data[begin:end])
                begin = i
            end = i + RUN
    if end > 0:
        out.append(data[begin:end])
    return out


def _dictionary(passages: list[tuple[bytes, int]], size: int) -> bytes:
    """A dictionary trained on passages and their counts; passages that the trainer left out follow, most frequent last."""
    most = max((n for _, n in passages), default=0)
    samples = []
    for at in range(min(most, 64)):  # a passage comes as often as it was seen, up to 64 times
        given = [p for p, n in passages if n > at]
        samples += [b"".join(given[i : i + 8]) for i in range(0, len(given), 8)]
    content = b""
    total = sum(map(len, samples))
    if total >= 8 * 1024:
        try:
            content = zstandard.train_dictionary(min(size, total // 4), samples, k=32, d=6).as_bytes()
        except zstandard.ZstdError:  # too little or too uniform for the trainer
            content = b""
    left, added = size - len(content), []
    for passage, _ in passages:
        if passage not in content and len(passage) <= left:
            added.append(passage)
            left -= len(passage)
    return content + b"".join(reversed(added))


def _trained(labelled: DataFrame, size: int) -> tuple[bytes, bytes] | None:
    """The toxic and the ordinary dictionary; None if a class is missing."""
    once = labelled.groupBy(F.xxhash64("text").alias("copy"), "label").agg(F.min("text").alias("text"))  # copies speak once
    once = stored(once, "training")
    n = {int(r["label"]): float(r["n"]) for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if 0 not in n or 1 not in n:
        return None
    counts = stored(_run_counts(once).filter(F.greatest("toxic", "ordinary") >= 5), "run-counts")
    share = {c: (F.col(c) + 0.5) / (k + 1) for c, k in (("toxic", n[1]), ("ordinary", n[0]))}
    error = F.sqrt(share["toxic"] * (1 - share["toxic"]) / n[1] + share["ordinary"] * (1 - share["ordinary"]) / n[0])

    def dictionary(label: int, mine: str, other: str) -> bytes:
        strength = (share[mine] - share[other]) / error
        strong = counts.select("run", strength.alias("strength"), (share[mine] / share[other]).alias("ratio"))
        # each run stands for a byte of the dictionary at least, so more of them than bytes are of no use
        best = strong.filter("strength > 4 and ratio > 3").orderBy(F.desc("strength"), "run").limit(size).collect()
        runs = frozenset(bytes(r["run"]) for r in best)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = Counter(p for text in batch.column(0).to_pylist() for p in _passages(_plain(text), runs))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["passage", "n"])

        texts = once.filter(F.col("label") == label).select("text")
        found = texts.mapInArrow(cut, "passage binary, n long").groupBy("passage").agg(F.sum("n").alias("n"))
        top = found.orderBy(F.desc(F.col("n") * F.length("passage")), "passage").limit(size).collect()
        return _dictionary([(bytes(r["passage"]), r["n"]) for r in top], size)

    return dictionary(1, "toxic", "ordinary"), dictionary(0, "ordinary", "toxic")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(
    documents: DataFrame,
    labels: DataFrame,
    *,
    rows_per_class: int = 15_000,
    dictionary_bytes: int = 12_000,
    window_bytes: int = WINDOW_BYTES,
) -> ToxicityModel:
    """Learns from ``documents`` (doc_id, text) and ``labels`` (doc_id, label, calibrates).

    Rows where ``calibrates`` is false train the dictionaries, the others calibrate. Of either kind and class at most
    ``rows_per_class`` documents are used, those with the smallest hash of the id. With that bound the list of ids is a
    few MB at most; it is broadcast, so that no text is shuffled to meet its label.
    """
    require(documents, ("doc_id", "text"))
    require(labels, ("doc_id", "label", "calibrates"))
    merged = (
        labels.filter("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id", "calibrates")
        .agg(F.max("label").cast("int").alias("label"))
        .withColumn("rank", F.xxhash64("doc_id"))
    )
    parts = [
        merged.filter((F.col("label") == y) & (F.col("calibrates") == c)).orderBy("rank").limit(rows_per_class)
        for y in (0, 1)
        for c in (False, True)
    ]
    chosen = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).select("doc_id", "label", "calibrates")
    texts = documents.select(documents["doc_id"], F.coalesce(documents["text"], F.lit("")).alias("text"))
    labelled = stored(texts.join(F.broadcast(chosen), "doc_id"), "labelled")
    prior = labelled.agg(F.avg("label").alias("p")).first()["p"] or 0.0
    dictionaries = _trained(labelled.filter(~F.col("calibrates")), dictionary_bytes)
    if dictionaries is None:
        return ToxicityModel(b"", b"", (), window_bytes, prior)
    toxic, ordinary = dictionaries
    counts = _counts_udf(toxic, ordinary, window_bytes)(F.col("text"))
    rows = labelled.filter("calibrates").select("label", counts.alias("counts")).toPandas()
    y = rows["label"].to_numpy(float)
    if len(set(y)) < 2:
        return ToxicityModel(toxic, ordinary, (), window_bytes, prior)
    weights = _logistic(_features(np.stack(rows["counts"].to_list())), y)
    return ToxicityModel(toxic, ordinary, tuple(map(float, weights)), window_bytes, prior)


def score_column(model: ToxicityModel, text: Column) -> Column:
    """The score of a text in 0..1: how likely label 1 is."""
    return _score_udf(model)(text) if model.weights else F.lit(model.prior)
