import numpy as np
import pytest

from riskloom.llm import rp_forest as rp
from riskloom.llm.embedding_dedup import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    sound = {}
    for i, v, label in rows:
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float32).astype(float)
            sound[i] = (label, len(v), x / np.linalg.norm(x))
    links = {i: set() for i, _, _ in rows if i is not None}
    ids = sorted(sound)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sound[a][:2] == sound[b][:2] and sound[a][2] @ sound[b][2] >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out[i] = (len(links[i]), min(seen))
    return out


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, 2):
        for _ in range(90):
            centre = rng.standard_normal(24)
            for _ in range(int(rng.choice([1, 1, 3, 12]))):
                rows.append((len(rows), (centre + rng.choice([0.0, 0.1, 0.3]) * rng.standard_normal(24)).astype(np.float32).tolist(), label))
    return rows


@pytest.mark.parametrize("block", [512, 3])
def test_recall_against_brute_force(spark, block):
    rows = vectors()
    odd = [(5000, None, 1), (5001, [0.0] * 24, 1), (5002, [1.0, None] * 12, 1), (5003, [float("nan")] * 24, 1), (5004, rows[0][1], None)]
    odd += [(5005, rows[0][1], 1), (5006, [], 0), (5007, [float("inf")] * 24, 0), (5008, rows[0][1][:12], 0), (5009, [x * 1e30 for x in rows[0][1]], 0), (5010, rows[0][1], 0)]
    found = embedding_dedup(spark.createDataFrame(rows + odd, SCHEMA), max_leaf=32, sample=128, block=block)
    found = {r[0]: (r[1], r[2]) for r in found.collect()}
    expected = brute(rows + odd)
    assert found.keys() == expected.keys()
    assert all(found[i][0] <= expected[i][0] for i in found)  # no link below the threshold
    total = sum(n for n, _ in expected.values())
    assert sum(n for n, _ in found.values()) >= 0.9 * total
    assert all(found[i] == (0, i) for i in (5000, 5001, 5002, 5003, 5004, 5006, 5007, 5008))
    assert found[5010][1] == found[5009][1] == found[0][1]


def test_a_group_of_equal_directions_and_repeated_ids(spark):
    base = np.ones(8, dtype=np.float32)
    rows = [(i, (base * (1 + i)).tolist(), 4) for i in range(300)] + [(7, (base * 8).tolist(), 4), (None, base.tolist(), 4)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", id int")
    found = embedding_dedup(df, max_leaf=16, sample=64, block=64).collect()
    assert {r["vec_id"] for r in found} == set(range(300)) and {(r["n_links"], r["component_id"]) for r in found} == {(299, 0)}
    assert embedding_dedup(df.limit(0)).count() == 0


def test_trees_cover_every_vector():
    rng = np.random.default_rng(3)
    x = rp.unit(rng.standard_normal((600, 16)))
    tree = rp.fit(11, x, 1.0, 40, 0.02)
    parts = rp.route(11, x, tree, 0.02, {})
    assert set(np.concatenate([rows for _, _, rows in parts])) == set(range(600)) and len(parts) > 8
    assert len({rp.child(11, place) for place, _, _ in parts}) == len(parts)


def test_recall_on_a_table(spark):
    """The copies of the small table's vectors, shaken, must find their originals."""
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rng = np.random.default_rng(2)
    shaken = [(10_000 + i, (np.array(v) * (1 + 0.2 * rng.standard_normal(len(v)))).tolist(), label) for i, v, label in given]
    expected = brute(given + shaken)
    found = {r[0]: r[1] for r in embedding_dedup(spark.createDataFrame(given + shaken, SCHEMA), max_leaf=32, sample=256).select("vec_id", "n_links").collect()}
    assert sum(found.values()) >= 0.9 * sum(n for n, _ in expected.values()) > 0
