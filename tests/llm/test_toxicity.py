import random
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import toxicity as t
from riskloom.llm.op1_toxicity import op1_toxicity


def words(rng, n):
    return " ".join("".join(rng.choice(["ba", "do", "ki", "lu", "men", "tor"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


INSULTS = ["grubface", "dunderhead", "wretchling", "oaf"]


def sample(spark, n=800):
    """Every fourth text is toxic; of either class half trains and half calibrates."""
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = words(rng, 40).split()
        for _ in range(3 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic), i // 4 % 2 == 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int, calibrates boolean")


def scores(df, model):
    return {r[0]: r[1] for r in df.select("doc_id", t.score_column(model, df["text"])).collect()}


def test_windows_hold_the_whole_text():
    rng = random.Random(1)
    for text in ("", "a", words(rng, 300), "x" * 500, "é" * 99 + " b", "a  b\n" * 50):
        found = list(t.windows(text, 24))
        assert all(0 < len(w) <= 26 for w in found)
        assert b"".join(found).split() == text.lower().encode().split()


def test_passages_consist_of_the_runs():
    runs = t._runs(b" grubface ")
    assert t._passages(b"ba do grubface ki grubface", frozenset(runs)) == [b" grubface ", b" grubface"]
    assert t._passages(b"", frozenset(runs)) == t._passages(b"abc", frozenset(runs)) == []


def test_toxic_text_scores_higher(spark):
    docs, labels = sample(spark)
    model = t.fit(docs, labels)
    assert b"grubface" in model.toxic_dictionary and b"grubface" not in model.ordinary_dictionary
    rng = random.Random(9)
    given = [
        (0, words(rng, 60)),
        (1, words(rng, 30) + " wretchling dunderhead " + words(rng, 30)),
        (2, ""),
        (3, None),
        (4, words(rng, 30_000) + " grubface" * 900),
        (5, words(rng, 20) + " Wretchlings! DUNDERHEADED\n" + words(rng, 20)),
        (5, words(random.Random(2), 60)),
        (6, "b" * 50_000),
    ]
    df = spark.createDataFrame(given, "doc_id long, text string")
    score = scores(df.filter("not (doc_id = 5 and text not like '%HEAD%')"), model)
    assert score[0] < 0.3 and score[1] > 0.7 and score[4] > 0.7 and score[5] > 0.7
    assert score[2] == score[3] < 0.3 and score[6] < 0.3


def test_scores_against_a_plain_version(spark):
    docs, labels = sample(spark)
    model = t.fit(docs, labels)
    longest = max(len(model.toxic_dictionary), len(model.ordinary_dictionary))
    first, second = (t._compressor(d.rjust(longest, b" ") + t.CARRIER) for d in (model.toxic_dictionary, model.ordinary_dictionary))
    found = scores(docs, model)
    for r in docs.limit(60).collect():
        gaps = Counter()
        for word in r["text"].lower().encode().split():
            w = t.CARRIER + b" " + word + b" " + t.TAIL
            gaps[max(-t.GAPS, min(t.GAPS, len(second.compress(w)) - len(first.compress(w))))] += 1
        n = sum(gaps.values())
        up = [sum(v for g, v in gaps.items() if g >= k) for k in t.LEVELS]
        down = [sum(v for g, v in gaps.items() if g <= -k) for k in t.LEVELS]
        x = [1.0, np.log1p(n), *(np.log1p(v) for v in up + down), *(30 * v / (n + 10) for v in up + down)]
        assert found[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-np.dot(x, model.weights))), abs=1e-9)


def test_without_a_class_the_score_is_the_share(spark):
    docs, labels = sample(spark, 24)
    given = [
        (labels.filter("label = 0"), 0.0),
        (labels.limit(0), 0.0),
        (labels.selectExpr("doc_id", "cast(null as int) as label", "calibrates"), 0.0),
        (labels.filter("label = 1 or calibrates"), 6 / 15),  # no ordinary row trains
        (labels.filter("label = 0 or calibrates"), 3 / 21),  # no toxic row trains
        (labels.filter("label = 0 or not calibrates"), 3 / 21),  # no toxic row calibrates
    ]
    for rows, share in given:
        model = t.fit(docs, rows)
        assert set(scores(docs, model).values()) == {model.prior} and model.prior == pytest.approx(share)
    with pytest.raises(ValueError):
        t.fit(docs.drop("text"), labels)


def test_repeated_rows_clashing_names_and_no_documents(spark):
    docs, labels = sample(spark, 400)
    model = t.fit(docs, labels)
    odd = docs.selectExpr("doc_id", "text", "'x' as label", "1 as calibrates", "2 as rank", "3 as run")
    again = odd.unionAll(odd)
    twice = labels.unionAll(labels.selectExpr("doc_id", "0 as label", "calibrates"))  # toxic wins
    model_again = t.fit(again, twice)
    assert model_again.toxic_dictionary == model.toxic_dictionary
    rows = again.select("doc_id", t.score_column(model_again, again["text"]).alias("s")).distinct()
    assert rows.count() == 400
    empty = t.fit(docs.limit(0), labels)
    assert empty.weights == () and empty.prior == 0.0
    assert docs.limit(0).select(t.score_column(model, docs["text"])).count() == 0


def test_held_out_accuracy(spark):
    sample_dir = "/root/testdata/sf0.1"
    rows = op1_toxicity(spark, sample_dir).join(spark.read.parquet(f"{sample_dir}/labels.parquet"), "doc_id").filter("held_out").collect()
    clean = [r["score"] for r in rows if r["toxic"] == 0]
    toxic = [r["score"] for r in rows if r["toxic"] == 1]
    recall, wrong = (sum(s >= 0.7 for s in x) / len(x) for x in (toxic, clean))
    print(f"held out: recall {recall:.3f}, false positives {wrong:.4f}")
    assert wrong <= 0.01 and recall >= 0.65
