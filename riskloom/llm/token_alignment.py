"""Alignment of two tokenizers' tokens over a corpus, each distinct text once.

A is a byte-level tokenizer file, given a space and the text; B is a sentencepiece model, given the text, to which it adds
the space itself. Both token sequences stand for the same bytes. Where tokens of both end, a group ends; a token of A and
a token of B are linked if their bytes overlap. The count of a pair of ids is the number of documents that hold it linked.

1. Rows are shuffled by their full text and counted, combined before the shuffle, so that a hot text travels as one row
   a task. Each distinct text is tokenised and aligned once, in blocks (``blocks.py``) that are stored.
2. A block asks about its distinct pairs, weighted by how many documents hold each; the shard of the A id adds the counts up,
   finds the highest of each A id, and replies with the count and whether it is the highest.
3. Measures of each text are joined to the documents by the SHA-256 of the text.

Strings of special tokens inside texts are ordinary text. Null and empty texts, and texts whose tokens do not give back
their bytes (such as those with U+2581, which B takes for a space), have no tokens: zeros, and an empty digest. Repeated
rows count as documents of their own and get equal measures. A text is one piece of work, so memory follows the longest.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import blocks as b
from riskloom.llm.shared import require, small_batches, stored
from riskloom.llm.tokens import Encoder, worker_memory

SPACE = "▁"
BLOCK_BYTES = 2 << 20
WORDS_REMEMBERED = 400_000  # of each tokenizer, about 80 MB
_LONGEST_REMEMBERED = 48

_BLOCK = (
    "block long, digests array<binary>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "shas array<string>, pairs binary, weights binary, n_pairs long, links binary"
)
_MEASURES = "digest binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the
    others, in order, for characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(other)}


class ByteLevel:
    """Tokenizer A: ids of a space and a text, and the bytes of each id."""

    def __init__(self, content: str) -> None:
        self.encoder = Encoder(content, plain=True, most_remembered=WORDS_REMEMBERED)
        kept = worker_memory("byte-level-bytes")
        if content not in kept:
            alphabet = byte_level_alphabet()
            vocabulary = self.encoder.tokenizer.get_vocab(with_added_tokens=False)
            table = [b""] * (max(vocabulary.values()) + 1)
            for token, number in vocabulary.items():
                table[number] = bytes(alphabet[c] for c in token)
            kept[content] = table
        self.table = kept[content]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.encoder.encode([" " + t for t in texts])]


class Pieces:
    """Tokenizer B. If no piece holds a space after something else, no merge crosses the space before a word, so texts with
    single spaces inside are encoded word by word, and equal words only once."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        loaded = worker_memory("pieces")
        if model not in loaded:
            processor = sentencepiece.SentencePieceProcessor(model_proto=model)
            names = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
            table = [
                bytes([int(x[3:5], 16)]) if processor.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)
            ]
            loaded[model] = processor, table, not any(SPACE in x.lstrip(SPACE) for x in names)
        self.processor, self.table, self.by_word = loaded[model]
        self.known = worker_memory(f"words-{hash(model)}")

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, dtype="<u4").tobytes() for x in self.processor.encode(texts, num_threads=1)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > WORDS_REMEMBERED:
            self.known.clear()
        whole = [not self.by_word or "  " in t or t[:1] == " " or t[-1:] == " " for t in texts]
        split = [None if w else t.split(" ") for t, w in zip(texts, whole, strict=True)]
        new = [w for w in set().union(*(s for s in split if s)) if w not in self.known]
        fresh = dict(zip(new, self._encoded(new), strict=True))
        long = {w: fresh.pop(w) for w in new if len(w) > _LONGEST_REMEMBERED}
        self.known.update(fresh)
        get = self.known.__getitem__ if not long else lambda w: long[w] if w in long else self.known[w]
        rest = iter(self._encoded([t for t, w in zip(texts, whole, strict=True) if w]))
        return [np.frombuffer(next(rest) if s is None else b"".join(map(get, s)), "<u4") for s in split]


def _joined(table: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def _sizes(table: list[bytes]) -> np.ndarray:
    return np.array([len(x) for x in table], dtype=np.int64)


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal form of each number, left-aligned in rows with one place to spare, and its length."""
    text = [str(i).encode() for i in range(most)]
    width = len(text[-1]) + 1
    return np.frombuffer(b"".join(x.ljust(width) for x in text), np.uint8).reshape(most, width), np.array([len(x) for x in text])


class Alignment:
    """Groups and links of several texts, one after the other; all have tokens, and equal bytes in A and B."""

    def __init__(self, a: list[np.ndarray], c: list[np.ndarray], size_a: np.ndarray, size_b: np.ndarray) -> None:
        none = [np.zeros(0, np.uint32)]
        self.n_a, self.n_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, c))
        self.a, self.b = np.concatenate(a or none), np.concatenate(c or none)
        self.ends_a, self.ends_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        self.text_ends = self.ends_a[np.cumsum(self.n_a) - 1] if len(a) else np.zeros(0, np.int64)
        # a flag for each byte that a token ends with; counting flags tells which token a byte belongs to
        ends = np.zeros((2, int(self.ends_a[-1]) + 1 if len(self.ends_a) else 1), dtype=bool)
        ends[0, self.ends_a] = ends[1, self.ends_b] = True
        both = ends[0] & ends[1]
        self.group_of = np.cumsum(both, dtype=np.int32) - both
        self.n_groups = np.bincount(np.searchsorted(self.text_ends, np.flatnonzero(both)), minlength=len(a))
        # both token sequences cut the bytes into pieces; each piece is one overlap of one token of A and one of B
        cuts = np.flatnonzero(ends[0] | ends[1])
        at_a, at_b = ((np.cumsum(e, dtype=np.int32) - e)[cuts] for e in ends)
        self.pairs = (self.a[at_a].astype(np.int64) << 32) | self.b[at_b]
        self.text_of = np.searchsorted(self.text_ends, cuts)
        self.n_links = np.bincount(self.text_of, minlength=len(a))

    def written(self, table: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2``."""
        digits, widths = table
        group = np.concatenate([2 * self.group_of[self.ends_a], 2 * self.group_of[self.ends_b] + 1])
        order = np.argsort(group, kind="stable")
        group, ids = group[order], np.concatenate([self.a, self.b])[order]
        rows, width = digits[ids], widths[ids]
        last = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
        mark = np.where(last, np.where(group % 2 == 0, ord("|"), ord(";")), ord(",")).astype(np.uint8)
        rows[np.arange(len(rows)), width] = mark
        flat = rows[np.arange(digits.shape[1]) <= width[:, None]].tobytes()
        ends = np.cumsum(width + 1)[np.cumsum(self.n_a + self.n_b) - 1].tolist() if len(self.n_a) else []
        return [flat[s : e - 1] for s, e in zip([0, *ends[:-1]], ends, strict=True)]


def _aligned(texts: DataFrame, tokenizer: str, model: bytes, block_bytes: int) -> DataFrame:
    """Blocks of distinct texts: the measures of each that need no corpus, its links, and the block's pairs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = ByteLevel(tokenizer), Pieces(model)
        sizes = _sizes(side_a.table), _sizes(side_b.table)
        digits = _digits(max(len(side_a.table), len(side_b.table)))
        partition, made = TaskContext.get().partitionId(), 0

        def block(bodies: list[bytes], copies: list[int]) -> pa.RecordBatch:
            text = [x.decode("utf-8", "replace") for x in bodies]
            a, c = side_a.encode(text), side_b.encode(text)
            same = [
                _joined(side_a.table, x) == b" " + raw == _joined(side_b.table, y) for x, y, raw in zip(a, c, bodies, strict=True)
            ]
            keep = [i for i, s in enumerate(same) if s]
            found = Alignment([a[i] for i in keep], [c[i] for i in keep], *sizes)
            pairs, code = np.unique(found.pairs, return_inverse=True)
            # a text's pairs once each, with its number of links
            held, times = np.unique(found.text_of * max(len(pairs), 1) + code, return_counts=True)
            text_of, code = held // max(len(pairs), 1), held % max(len(pairs), 1)
            many = np.array([copies[i] for i in keep], dtype=np.int64)
            weights = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(weights, code, many[text_of])
            bounds = np.searchsorted(text_of, np.arange(len(keep) + 1))
            shas = [hashlib.sha256(x).hexdigest() for x in found.written(digits)]
            lists = [found.n_a, found.n_b, found.n_groups, found.n_links]
            columns = [
                pa.array([b.numbered(partition, made)], pa.int64()),
                pa.array([[hashlib.sha256(bodies[i]).digest() for i in keep]], pa.list_(pa.binary())),
                *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in lists),
                pa.array([shas], pa.list_(pa.string())),
                pa.array([b.pack(pairs)], pa.binary()),
                pa.array([b.pack(weights)], pa.binary()),
                pa.array([len(pairs)], pa.int64()),
                pa.array([b.pack(bounds.astype("<i8"), code.astype("<i4"), times.astype("<i4"))], pa.binary()),
            ]
            names = ["block", "digests", "n_a", "n_b", "n_groups", "n_links", "shas", "pairs", "weights", "n_pairs", "links"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        bodies, copies, size = [], [], 0
        for batch in batches:
            for body, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bodies.append(body)
                copies.append(n)
                size += len(body)
                if size >= block_bytes:
                    yield block(bodies, copies)
                    bodies, copies, size, made = [], [], 0, made + 1
        if bodies:
            yield block(bodies, copies)

    return texts.select(F.col("text").cast("binary").alias("text"), "copies").mapInArrow(cut, _BLOCK)


def _pair_reply(shard: int, payloads: list[bytes]) -> list[bytes]:
    """For each asked pair its count, and whether no pair with the same A id has more."""
    parts = [b.unpack(p, "<i8", "<i8") for p in payloads]
    pairs, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(counts, inverse, np.concatenate([p[1] for p in parts]))
    first = np.flatnonzero(np.append(True, (pairs[1:] >> 32) != (pairs[:-1] >> 32)))
    highest = np.maximum.reduceat(counts, first)[np.cumsum(np.isin(np.arange(len(pairs)), first)) - 1]
    best = counts == highest
    sizes = [len(p[0]) for p in parts]
    return [
        b.pack(n, np.packbits(x)) for n, x in zip(b.split_like(counts[inverse], sizes), b.split_like(best[inverse], sizes), strict=True)
    ]


def align(
    docs: DataFrame,
    tokenizer_file: str,
    piece_model: str,
    key: str = "doc_id",
    text: str = "text",
    *,
    block_bytes: int = BLOCK_BYTES,
    shard_keys: int = b.SHARD_KEYS,
) -> DataFrame:
    """One row for each row of ``docs``: its key and its measures."""
    require(docs, (key, text))
    small_batches(docs.sparkSession)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer, model = Path(tokenizer_file).read_text("utf-8"), Path(piece_model).read_bytes()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    texts = rows.filter("text is not null and text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    aligned = stored(_aligned(texts, tokenizer, model, block_bytes), "aligned")
    shards = b.shard_count(aligned.agg(F.sum("n_pairs").alias("n")).first()["n"] or 0, shard_keys)

    def shard_of(pairs: np.ndarray) -> np.ndarray:
        return (b.mixed(pairs >> 32) % np.uint64(shards)).astype(np.int64)

    def ask_pairs(row: dict):
        [pairs], [weights] = b.unpack(row["pairs"], "<i8"), b.unpack(row["weights"], "<i8")
        for shard, part in b.dealt(shard_of(pairs)):
            yield shard, b.pack(pairs[part], weights[part])

    def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                [pairs] = b.unpack(row["pairs"], "<i8")
                bounds, code, times = b.unpack(row["links"], "<i8", "<i4", "<i4")
                shard = shard_of(pairs)
                counts = b.placed(shard, row["replies"], lambda data, n: b.unpack(data, "<i8", None)[0], np.int64)
                best = b.placed(shard, row["replies"], lambda data, n: b.bits(b.unpack(data, "<i8", None)[1], n), bool)
                total = [np.append(0, np.cumsum(times * x[code]))[bounds] for x in (best.astype(np.int64), counts)]
                n_best, count_sum = (np.diff(x) for x in total)
                columns = [
                    pa.array(row["digests"], pa.binary()),
                    *(pa.array(row[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                    pa.array(n_best, pa.int64()),
                    pa.array(count_sum, pa.int64()),
                    pa.array(row["shas"], pa.string()),
                ]
                names = ["digest", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    asked = b.ask(aligned.select("block", "pairs", "weights"), ask_pairs)
    judged = b.with_replies(aligned.drop("weights", "n_pairs"), b.answer(asked, _pair_reply), "replies")
    measured = judged.mapInArrow(measures, _MEASURES)
    keyed = rows.select(F.col("key").alias(key), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("of"))
    joined = keyed.join(measured, keyed["of"] == measured["digest"], "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return joined.select(key, *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
