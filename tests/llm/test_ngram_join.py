import math
import random
import re

import numpy as np
import pytest

from riskloom.llm.components import components
from riskloom.llm.ngram_join import least_matches, ngram_join, similar


def shingle_set(text, n=5):
    found = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1))} if found else set()


def brute(docs, threshold=0.8):
    sets = {d: shingle_set(t) for d, t in docs}
    ids = sorted(sets)
    links = {d: set() for d in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for d in ids:
        seen, todo = {d}, [d]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        same = [x for x in ids if sets[x] == sets[d] and sets[d]] or [d]
        out[d] = (min(same), len(links[d]), min(seen))
    return out


def corpus(seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append((len(docs), " ".join(text)))
    return docs


# small blocks cut every bucket
@pytest.mark.parametrize("block", [1024, 2])
def test_against_brute_force(spark, block):
    docs = corpus() + [(900, None), (901, ""), (902, "!!"), (903, "one two"), (904, "One, two!"), (905, "a b c d e " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r[0]: tuple(r[1:]) for r in ngram_join(df, block=block).select("doc_id", "class_id", "n_links", "component_id").collect()}
    assert found == brute(docs)


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame(
        [(1, "a b c d e f g", 0, 0), (1, "a b c d e f g", 0, 0), (2, "A b c d e f g", 0, 0), (None, "a b c d e f g", 0, 0)],
        "doc_id long, text string, id int, component_id int",
    )
    rows = sorted(tuple(r) for r in ngram_join(df).select("doc_id", "class_id", "n_links", "component_id").collect())
    assert rows == [(1, 1, 1, 1), (2, 1, 1, 1)]
    assert ngram_join(df.limit(0)).count() == 0


def test_pruning_keeps_what_can_reach_the_threshold():
    for n, m in least_matches(0.8, 1e-5, 64):
        mass = lambda k: sum(math.comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(k + 1))
        assert mass(m) >= 1e-5 and (m == 0 or mass(m - 1) < 1e-5)


def test_exact_similarity():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(30)]
    pairs = np.array([(i, j) for i in range(30) for j in range(i + 1, 30)])
    expected = {(i, j) for i, j in pairs.tolist() if len(np.intersect1d(sets[i], sets[j])) >= 0.4 * len(np.union1d(sets[i], sets[j]))}
    assert set(map(tuple, similar(sets, pairs, 0.4).tolist())) == expected
    few = pairs[:3]
    assert set(map(tuple, similar(sets, few, 0.4).tolist())) == {p for p in map(tuple, few.tolist()) if p in expected}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 5), (9, 9), (None, 4), (200, 100)]
    found = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 100 for i in [*range(100, 161), 200]} | {3: 3, 5: 3, 7: 3}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
