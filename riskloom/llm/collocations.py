"""Phrase collocations by relational mining, length by length (SETM).

A-Z are lower-cased; texts are split at ``. , ; : ! ?`` and 0x0A-0x0D into pieces, and those at spaces and tabs into words.
Everything is counted per language: f(phrase) counts all its places within pieces, overlaps included.

The occurrence relation of length k says at which place of which piece a phrase of k words begins. It is stored sorted by
piece and place, one row for each block of pieces (``blocks.py``); places of a block are numbered through, and a number is
skipped between two pieces, so that following numbers mean following words of one piece.

1. Group and count: each block counts its phrases; shards add the counts up, number the phrases that are frequent
   (at least ``least``) and reply with those numbers, so a phrase in every document is one entry a block.
2. Semi-join: only occurrences of frequent phrases are stored as the relation of that length.
3. Merge-join: the relation of length k meets itself at the next place; two phrases of k words that overlap in k - 1
   make an occurrence of a phrase of k + 1 words, both of whose halves are frequent. Then again from 1.

Scores, the drop rule and the ranking are DataFrame joins over the frequent phrases alone, in exact decimal arithmetic.
Each language's best rows are found within salted parts first, so no task sorts all phrases of a language.

Defined results: null texts are empty; a null language is ``und``; repeated rows count again. An empty table gives no
rows. Ties are ordered by score, frequency and phrase, which is unique in its language. A piece is one unit, so memory
follows the longest document. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import blocks as b
from riskloom.llm.shared import require, small_batches, stored

NO_LANGUAGE = "und"
BORDER = b"\xff"  # a byte that no UTF-8 text holds
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BORDER * 10)
_NUMBERS = np.dtype("<u8")
_INFREQUENT = np.uint64(2**64 - 1)
_COUNTED = "lang string, id long, left long, right long, word string, f long"


def pieces(text: bytes) -> list[bytes]:
    """The words of a text, with ``BORDER`` between pieces."""
    return text.lower().translate(_PIECES).replace(BORDER, b" " + BORDER + b" ").split()


def relation_of_words(docs: DataFrame, text: str, lang: str, block_bytes: int) -> DataFrame:
    """``block, lang, places, codes, words, n``: all words, sorted by place, coded by the block's list of words."""
    require(docs, (text, lang))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = 0, 0
        partition = TaskContext.get().partitionId()
        parts: dict[str, list[np.ndarray]] = defaultdict(list)
        known: dict[str, dict] = {}

        def block(language: str) -> pa.RecordBatch:
            codes = np.concatenate(parts[language])
            places = np.flatnonzero(codes != 0)
            words = list(known[language])[1:]
            columns = [
                pa.array([b.numbered(partition, made)], pa.int64()),
                pa.array([language], pa.string()),
                pa.array([b.pack(places.astype("<i8"))], pa.binary()),
                pa.array([b.pack((codes[places] - 1).astype("<i4"))], pa.binary()),
                pa.array([b.pack(b" ".join(words))], pa.binary()),
                pa.array([len(places)], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["block", "lang", "places", "codes", "words", "n"])

        for batch in batches:
            for language, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = pieces(body or b"")
                if not found:
                    continue
                codes_of = known.get(language)
                if codes_of is None:
                    codes_of = known[language] = {BORDER: 0}
                for w in found:
                    if w not in codes_of:
                        codes_of[w] = len(codes_of)
                parts[language].append(np.fromiter(map(codes_of.__getitem__, found), "<i4", len(found)))
                parts[language].append(np.zeros(1, "<i4"))
                size += len(body) + 64
                if size >= block_bytes:
                    for language in parts:
                        yield block(language)
                        made += 1
                    size = 0
                    parts.clear()
                    known.clear()
        for language in parts:
            yield block(language)
            made += 1

    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), docs[text].cast("binary").alias("text"))
    return rows.mapInArrow(cut, "block long, lang string, places binary, codes binary, words binary, n long")


def _number(shard: int, shards: int, ranks: np.ndarray) -> np.ndarray:
    """Numbers that no other shard gives."""
    return ranks.astype(np.uint64) * np.uint64(shards) + np.uint64(shard)


def _words_of(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """A block's words, its codes, and the shard of each word."""
    [raw] = b.unpack(row["words"], None)
    [codes] = b.unpack(row["codes"], "<i4")
    words = raw.split(b" ")
    seed = xxhash.xxh3_64_intdigest(row["lang"].encode("utf-8", "surrogatepass"))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
    return words, codes, hashes


class _Pairs:
    """The phrases of the next length in a block: both halves, where they begin, and how often each phrase comes."""

    def __init__(self, row: dict, shards: int) -> None:
        places, numbers = b.unpack(row["relation"], "<i8", _NUMBERS)
        at = np.searchsorted(places, places + 1)  # merge-join at the next place
        met = np.zeros(len(places), dtype=bool)
        inside = at < len(places)
        met[inside] = places[at[inside]] == places[inside] + 1
        self.places = places[met]
        left, right = numbers[met], numbers[at[met]]
        order = np.lexsort((right, left))
        a, c = left[order], right[order]
        first = np.ones(len(order), dtype=bool)
        first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        lead = np.flatnonzero(first)
        self.left, self.right = a[lead], c[lead]
        self.counts = np.diff(np.append(lead, len(order)))
        self.of = np.empty(len(order), dtype=np.int64)  # of each occurrence: its phrase
        self.of[order] = np.cumsum(first) - 1
        self.shard_of = (b.mixed(self.left * np.uint64(0x9E3779B97F4A7C15) + self.right) % np.uint64(shards)).astype(np.int64)


def _counted(messages: DataFrame, tally) -> DataFrame:
    """Replies to the blocks (kind 0) and the frequent phrases of each shard (kind 1), in one pass."""

    def of_shard(table: pa.Table) -> pa.Table:
        replies, frequent = tally(table.column("shard")[0].as_py(), table.column("payload").to_pylist())
        n, m = len(replies), len(frequent[0])
        columns = {
            "kind": pa.array([0] * n + [1] * m, pa.int32()),
            "block": pa.concat_arrays([table.column("block").combine_chunks(), pa.nulls(m, pa.int64())]),
            "shard": pa.concat_arrays([table.column("shard").combine_chunks(), pa.nulls(m, pa.int32())]),
            "payload": pa.array([*replies, *[None] * m], pa.binary()),
        }
        for (name, kind), values in zip(_FREQUENT, frequent, strict=True):
            columns[name] = pa.array([*[None] * n, *values], kind)
        return pa.table(columns)

    schema = "kind int, block long, shard int, payload binary, " + _COUNTED
    return messages.groupBy("shard").applyInArrow(of_shard, schema)


_FREQUENT = [("lang", pa.string()), ("id", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("word", pa.string()), ("f", pa.int64())]


def _word_tally(least: int, shards: int):
    def tally(shard: int, payloads: list[bytes]) -> tuple[list[bytes], list]:
        total: dict[tuple[bytes, bytes], int] = defaultdict(int)
        parts = []
        for payload in payloads:
            lang, raw, counts = b.unpack(payload, None, None, "<i8")
            words = raw.split(b" ")
            parts.append((lang, words))
            for w, n in zip(words, counts.tolist(), strict=True):
                total[lang, w] += n
        frequent = sorted(k for k, n in total.items() if n >= least)
        numbers = _number(shard, shards, np.arange(len(frequent)))
        number_of = dict(zip(frequent, numbers.tolist(), strict=True))
        none = int(_INFREQUENT)
        replies = [b.pack(np.array([number_of.get((lang, w), none) for w in words], _NUMBERS)) for lang, words in parts]
        text = [w.decode("utf-8", "replace") for _, w in frequent]
        langs = [k.decode("utf-8", "replace") for k, _ in frequent]
        empty = [None] * len(frequent)
        return replies, [langs, numbers.astype(np.int64), empty, empty, text, [total[k] for k in frequent]]

    return tally


def _pair_tally(least: int, shards: int):
    def tally(shard: int, payloads: list[bytes]) -> tuple[list[bytes], list]:
        parts = [b.unpack(p, _NUMBERS, _NUMBERS, "<i8") for p in payloads]
        left, right, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((right, left))
        a, c = left[order], right[order]
        first = np.ones(len(order), dtype=bool)
        first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        lead = np.flatnonzero(first)
        f = np.add.reduceat(counts[order], lead) if len(lead) else counts
        often = f >= least
        numbers = np.full(len(lead), _INFREQUENT, dtype=_NUMBERS)
        numbers[often] = _number(shard, shards, np.arange(int(often.sum())))
        out = np.empty(len(order), dtype=_NUMBERS)
        out[order] = numbers[np.cumsum(first) - 1]
        replies = [b.pack(x) for x in b.split_like(out, [len(p[0]) for p in parts])]
        empty = [None] * int(often.sum())
        halves = [x[lead][often].astype(np.int64) for x in (a, c)]
        return replies, [empty, numbers[often].astype(np.int64), *halves, empty, f[often].astype(np.int64)]

    return tally


def _numbers_reply(data: bytes, count: int) -> np.ndarray:
    return b.unpack(data, _NUMBERS)[0]


def _first_relation(blocks: DataFrame, shards: int) -> DataFrame:
    """The stored relation of frequent words: ``block, lang, relation``."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, codes, hashes = _words_of(row)
                [places] = b.unpack(row["places"], "<i8")
                numbers = b.placed((hashes % np.uint64(shards)).astype(np.int64), row["replies"], _numbers_reply, _NUMBERS)[codes]
                yield _relation_row(row, places, numbers)

    return blocks.mapInArrow(join, "block long, relation binary")


def _next_relation(blocks: DataFrame, shards: int) -> DataFrame:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = _Pairs(row, shards)
                numbers = b.placed(pairs.shard_of, row["replies"], _numbers_reply, _NUMBERS)[pairs.of]
                yield _relation_row(row, pairs.places, numbers)

    return blocks.mapInArrow(join, "block long, relation binary")


def _relation_row(row: dict, places: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    often = numbers != _INFREQUENT
    data = b.pack(places[often].astype("<i8"), numbers[often])
    return pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([data], pa.binary())], names=["block", "relation"])


def frequent_phrases(
    docs: DataFrame, text: str, lang: str, *, least: int, longest: int, block_bytes: int, shard_keys: int
) -> tuple[list[DataFrame], DataFrame]:
    """For each length the frequent phrases, ``id, left, right, f`` (words: ``lang, id, word, f``), and ``lang, n``.

    ``left`` and ``right`` are the ids of the phrases without the last and without the first word.
    """
    small_batches(docs.sparkSession)
    words = stored(relation_of_words(docs, text, lang, block_bytes), "words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    shards = b.shard_count(words.agg(F.sum("n").alias("n")).first()["n"] or 0, shard_keys)

    def ask_words(row: dict):
        found, codes, hashes = _words_of(row)
        counts = np.bincount(codes, minlength=len(found)).astype("<i8")
        lang = row["lang"].encode("utf-8", "surrogatepass")
        for shard, part in b.dealt((hashes % np.uint64(shards)).astype(np.int64)):
            yield shard, b.pack(lang, b" ".join([found[i] for i in part]), counts[part])

    def ask_pairs(row: dict):
        pairs = _Pairs(row, shards)
        for shard, part in b.dealt(pairs.shard_of):
            yield shard, b.pack(pairs.left[part], pairs.right[part], pairs.counts[part].astype("<i8"))

    counted = stored(_counted(b.ask(words, ask_words), _word_tally(least, shards)), "counted-1")
    found = [counted.filter("kind = 1").select("lang", "id", "word", "f")]
    replies = counted.filter("kind = 0")
    for length in range(2, longest + 1):
        if length == 2:
            relation = _first_relation(b.with_replies(words, replies, "replies"), shards)
        else:
            relation = _next_relation(b.with_replies(relation, replies, "replies"), shards)
        relation = stored(relation, f"relation-{length - 1}")
        counted = stored(_counted(b.ask(relation, ask_pairs), _pair_tally(least, shards)), f"counted-{length}")
        found.append(counted.filter("kind = 1").select("id", "left", "right", "f"))
        replies = counted.filter("kind = 0")
    return found, sizes


def described(found: list[DataFrame]) -> list[DataFrame]:
    """For each length ``lang, id, left, right, phrase, word, f, heads, tails``.

    ``heads`` holds f of the first 1, 2, ... words and ``tails`` f of the last ones, longest first: l and r of each cut.
    """
    none = F.array().cast("array<long>")
    words = found[0].select("lang", "id", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"),
                            F.col("word").alias("phrase"), "word", "f", none.alias("heads"), none.alias("tails"))
    out = [words]
    for counted in found[1:]:
        before = out[-1]
        left = before.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("lp"), F.col("f").alias("lf"), "heads")
        right = before.select(F.col("id").alias("right"), F.col("word"), F.col("f").alias("rf"), "tails")
        joined = counted.join(left, "left").join(right, "right")
        rows = joined.select(
            "lang", "id", "left", "right", F.concat_ws(" ", "lp", "word").alias("phrase"), "word", "f",
            F.concat("heads", F.array("lf")).alias("heads"), F.concat(F.array("rf"), "tails").alias("tails"),
        )
        out.append(stored(rows, "phrases"))
    return out


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) for counts below 10^15."""
    wide = lambda c: c.cast("decimal(16,0)")
    top = (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(32,0)")).cast("long")


def mine(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    *,
    least: int = 10,
    longest: int = 3,
    top: int = 2_000,
    drop_percent: int = 50,
    block_bytes: int = b.BLOCK_BYTES,
    shard_keys: int = b.SHARD_KEYS,
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase is dropped if a longer frequent one that holds it has at least ``drop_percent`` of its frequency. It suffices
    to look one word further: of any longer phrase that holds it, the part one word longer is at least as frequent.
    """
    if longest < 2:
        raise ValueError("phrases have at least two words")
    spark = docs.sparkSession
    found, sizes = frequent_phrases(docs, text, lang, least=least, longest=longest, block_bytes=block_bytes, shard_keys=shard_keys)
    levels = described(found)
    scored = None
    for length, level in enumerate(levels[1:], start=2):
        rows = level
        if length < longest:
            longer = levels[length]
            holds = longer.select(F.col("left").alias("held"), "f").unionAll(longer.select(F.col("right").alias("held"), "f"))
            most = holds.groupBy("held").agg(F.max("f").alias("most"))
            rows = rows.join(most, rows["id"] == most["held"], "left")
            rows = rows.filter(f"most is null or 100 * most < {int(drop_percent)} * f")
        cuts = F.transform(
            F.sequence(F.lit(1), F.lit(length - 1)),
            lambda k: F.struct(
                exact_score(F.col("f"), F.element_at("heads", k), F.element_at("tails", k)).alias("score"),
                k.alias("k"), F.element_at("heads", k).alias("l"), F.element_at("tails", k).alias("r"),
            ),
        )
        best = rows.select("lang", "phrase", F.col("f").alias("a"), F.array_min(cuts).alias("cut"))
        best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        scored = best if scored is None else scored.unionAll(best)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    within = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = within.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
