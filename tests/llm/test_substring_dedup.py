"""Passage removal against a plain version over all windows."""

import random
import re

import pytest

from riskloom.llm.substring_dedup import COVERS, cover_of, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    docs = [(doc, WORD.findall(text or "")) for doc, text in rows]
    rank = lambda doc: (doc is None, doc or 0)
    first = {}
    for doc, words in docs:
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, (rank(doc), i)), (rank(doc), i))
    out = []
    for doc, words in docs:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (rank(doc), i):
                gone.update(range(i, i + window))
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def test_covers_give_every_difference():
    for period, cover in COVERS.items():
        assert {(x - y) % period for x in cover for y in cover} == set(range(period))
    assert cover_of(20) == (13, COVERS[13]) and cover_of(5) == (1, (0,))


def sample(rng, n, window):
    passage = [rng.choice("abcdefgh") for _ in range(3 * window)]
    rows = []
    for i in range(n):
        words = [rng.choice("abcdefgh") + str(rng.randrange(rng.choice([2, 50]))) for _ in range(rng.randrange(5 * window))]
        if i % 3 == 0:
            at, lo = rng.randrange(len(words) + 1), rng.randrange(window)
            words[at:at] = passage[lo : lo + rng.randrange(window - 3, 2 * window)]
        rows.append((i, rng.choice([" ", "  ", "\n", "\t"]).join(words)))
    rows += [(n + i, " ".join(["same"] * rng.randrange(2 * window, 3 * window))) for i in range(5)]
    rows += [(rng.randrange(n), rows[rng.randrange(n)][1]) for _ in range(n // 5)]  # ids come twice
    return rows


@pytest.mark.parametrize("window, block_bytes, shard_keys", [(20, 300, 100), (20, 1 << 20, 1 << 20), (5, 500, 64), (9, 1, 10)])
def test_same_as_brute_force(spark, window, block_bytes, shard_keys):
    rng = random.Random(window)
    rows = sample(rng, 60, window)
    long = " ".join(str(i % 997) for i in range(20_000))
    rows += [(900, None), (901, ""), (902, " \n "), (None, rows[3][1]), (None, long), (903, long), (903, long), (904, "x " + long), (905, "a\x1cb  c"), (-1, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = remove_repeats(docs, window=window, block_bytes=block_bytes, shard_keys=shard_keys).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, window)


def test_many_copies_and_one_passage(spark):
    rng = random.Random(4)
    passage = " ".join(str(rng.randrange(10**6)) for _ in range(60))
    rows = [(i, passage) for i in range(300)]
    rows += [(1000 + i, " ".join(str(rng.randrange(10**6)) for _ in range(10)) + " " + passage + " " + str(i)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, remove_repeats(docs, block_bytes=5_000).collect()), key=str) == brute(rows, 20)


def test_empty_table_clashing_names_and_missing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, block long, copies string")
    assert tuple(remove_repeats(docs).first()) == (1, 2, 0, "a b")
    assert remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(docs.drop("text"))
    with pytest.raises(ValueError):
        remove_repeats(docs, window=1)
