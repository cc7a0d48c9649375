import numpy as np
import pytest

from riskloom.llm.cgk import WindowIndex, edited, words_of
from riskloom.llm.decontaminate import indexes, leaks, leaks_any


def distance(item, words):
    """Least edit distance of the item to any part of the words; row by row."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(words, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def item_texts(n=12, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"v{x}" for x in rng.integers(0, 300, 8 + 4 * i))) for i in range(n)]


def test_bit_parallel_distance():
    rng = np.random.default_rng(8)
    index = WindowIndex(item_texts(), 0.2, 0.1, 0.9, 8, 8)
    for k, (_, sequence) in enumerate(index.items):
        for edits in (0, 1, 3, 9):
            words = [*rng.integers(0, 200, 15).tolist(), *edited(sequence, edits, 200, rng).tolist(), *rng.integers(0, 200, 9).tolist()]
            assert index.best_match(words, k)[0] == distance(sequence.tolist(), words)


def test_recall_of_edited_items():
    rng = np.random.default_rng(4)
    index = WindowIndex(item_texts(30), 0.2, 0.1, 0.95, 8, 32)
    found = total = 0
    for k, (_, sequence) in enumerate(index.items):
        for _ in range(6):
            words = np.concatenate([np.zeros(9, np.int32), edited(sequence, len(sequence) // 10, 280, rng), np.zeros(index.pad + 9, np.int32)])
            found += (0, k) in index.matches(words, np.array([0, len(words)]))
            total += 1
    assert found >= 0.9 * total


def documents():
    items = item_texts()
    rng = np.random.default_rng(6)
    filler = lambda n: " ".join(f"u{x}" for x in rng.integers(0, 500, n))
    docs = [(i, f"{filler(30)} {text.upper()}. {filler(20)}") for i, text in items]
    docs += [(50 + i, filler(60)) for i in range(10)]
    half = items[8][1].split()
    docs += [(70, " ".join(half[: len(half) // 2])), (71, None), (72, ""), (73, f"{filler(5000)} {items[3][1]} {items[3][1]}"), (None, items[2][1])]
    return items, docs


def test_leaks_of_whole_documents(spark):
    items, docs = documents()
    given = spark.createDataFrame([*items, (90, None), (91, "too short"), (None, "no id " * 9), (92, items[0][1])], "item_id long, text string")
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    found = indexes(given)
    rows = leaks(df, found).collect()
    expected = {(i, i) for i, _ in items} | {(0, 92), (73, 3), (None, 2)}
    assert {(r["doc_id"], r["item_id"]) for r in rows} == expected
    texts = dict(docs)
    for r in rows:
        assert r["distance"] == 0
        assert words_of(texts[r["doc_id"]][r["start"] : r["end"]]) == words_of(dict(items).get(r["item_id"], items[0][1]))
    flagged = df.filter(leaks_any(found, df["text"])).select("doc_id").collect()
    assert {r[0] for r in flagged} == {d for d, _ in expected}


def test_blocks_and_empty_tables(spark):
    items, docs = documents()
    given, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found = indexes(given, items_per_block=3)
    assert len(found) > 1 and leaks(df, found).count() == len(items) + 2
    assert leaks(df, indexes(given.limit(0))).count() == 0
    assert leaks(df.limit(0), found).count() == 0
    with pytest.raises(ValueError):
        indexes(given.drop("text"))


def test_no_leak_within_the_limit_is_missed():
    """Scattered edits and runs of missing or replaced words at the begin, in the middle and at the end, all at 20 %."""
    rng = np.random.default_rng(5)
    items = item_texts(30)
    index = WindowIndex(items, 0.2, 0.1, 0.95, 8, 32)
    around = rng.integers(0, 280, 40).astype(np.int32)
    missed = []
    for k, (_, sequence) in enumerate(index.items):
        run = len(sequence) // 5
        fresh = np.zeros(run, np.int32)
        for at in (0, len(sequence) // 3, len(sequence) - run):
            front, back = sequence[:at], sequence[at + run :]
            for kind, middle in (("missing", fresh[:0]), ("replaced", fresh)):
                words = np.concatenate([around, front, middle, back, around, np.zeros(index.pad, np.int32)])
                missed += [(k, at, kind)] if (0, k) not in index.matches(words, np.array([0, len(words)])) else []
        for _ in range(4):
            words = np.concatenate([around, edited(sequence, run, 280, rng), around, np.zeros(index.pad, np.int32)])
            missed += [(k, "scattered")] if (0, k) not in index.matches(words, np.array([0, len(words)])) else []
    assert not missed


def test_short_items_match_exactly():
    items = [(1, "alpha beta gamma"), (2, "delta"), (3, "one two three four five six seven")]
    index = WindowIndex(items, 0.2, 0.1, 0.95, 8, 32)
    texts = ["so Alpha, beta gamma.", "alpha beta", "one two three four five six", "x one two three four five six seven", ""]
    assert {(d, index.items[k][0]): v[0] for (d, k), v in index.matches(*index.encode(texts)).items()} == {(0, 1): 0, (3, 3): 0}
    with pytest.raises(ValueError):
        WindowIndex(items, 1.0, 0.1, 0.95, 8, 32)
