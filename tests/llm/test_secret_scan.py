import random
import re

from pyspark.sql import functions as F

from riskloom.llm import secret_scan as s

HEX = "0123456789abcdef"


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    pieces = ["count", "table", "value", "index", "number", "result", "stream", "window"]
    rows = []
    for i in range(n):
        word = "".join(rng.choice(pieces) for _ in range(4))
        key, commit = pick(HEX + "ghijKLMNOP", 40), pick(HEX, 40)
        text = f"The {' '.join(rng.choices(pieces, k=9))} {word} here.\n"
        if i % 2:
            text += f'api_key = "{key}" and more'
        else:
            text += f"see commit {commit} for it"
        rows.append((i, text, f"src/{'test' if i % 3 else 'main'}/f{i}.py"))
    return rows


def test_findings_are_where_they_are_said_to_be(spark):
    rows = corpus() + [(900, None, None), (901, "", "p"), (902, "a" * 300_000, "p"), (903, "ä" + "b" * 30 + "ö " + "1" * 30, "p"), (904, "k" * 16 + " " + "=" * 20 + "Z9" * 10, "p")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, candidate int")
    found = s.findings(df).collect()
    texts = {d: t for d, t, _ in rows}
    for r in found:
        assert texts[r["id"]][r["start"] : r["start"] + len(r["candidate"])] == r["candidate"]
        assert texts[r["id"]][: r["start"]].endswith(r["before"]) and texts[r["id"]][r["start"] + len(r["candidate"]) :].startswith(r["after"])
    pattern = re.compile(r"(?<![^\W_]|[_+/=-])[A-Za-z0-9_+/=-]{16,}(?![^\W_])")
    expected = sorted((d, m.start()) for d, t, _ in rows for m in pattern.finditer(t or "") if re.search("[A-Za-z]", m[0]))
    assert sorted((r["id"], r["start"]) for r in found) == expected
    assert s.findings(df.limit(0)).count() == 0


def labelled(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = s.word_pieces(df, min_docs=5)
    featured = s.with_features(s.findings(df), pieces)
    return pieces, featured.withColumn("label", (F.col("before").contains("api_key")).cast("int"))


def test_held_out_findings_are_told_apart(spark):
    pieces, known = labelled(spark, corpus(1))
    model = s.fit(known, pieces, trees=10, depth=5)
    _, other = labelled(spark, corpus(2))
    judged = s.judge(other, model).withColumn("label", F.col("before").contains("api_key").cast("int"))
    rows = judged.select("label", (F.col("probability") >= 0.5).cast("int").alias("y")).collect()
    assert len(rows) > 200 and sum(r["label"] == r["y"] for r in rows) >= 0.98 * len(rows)
    assert "Python" not in judged._jdf.queryExecution().executedPlan().toString()


def test_one_label_only(spark):
    pieces, known = labelled(spark, corpus(1, 12))
    for given, share in ((known.filter("label = 0"), 0.0), (known.filter("label = 1"), 1.0), (known.limit(0), 0.0)):
        model = s.fit(given, pieces)
        assert model.forest is None and {r["probability"] for r in s.judge(known, model).collect()} == {share}
