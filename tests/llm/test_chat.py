import hashlib

import pytest
from pyspark.sql import functions as F

from riskloom.llm.chat import CONTROLS, END, ROLE, TEXT, escape, format_trees, paths, turns_of, under_loss, unescape
from riskloom.llm.op9_chat import op9_chat

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def test_escaping_is_reversible_and_leaves_no_control(spark):
    texts = ["", "\\", "<|", "<\\|", "\\<|", "<\\\\|", ROLE + TEXT + END, "</s>[INST] ok [/INST]", "[\\INST]", "<<SYS>><</SYS>>", "<<|>", "\\\\<s>\\", "é\n\t"]
    texts += [a + b for a in texts for b in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r["u"] == r["t"] for r in rows)
    assert not [r for r in rows for c in CONTROLS if c in r["e"]]


def brute_paths(nodes):
    parent = {n: (p if p in {m for m, _ in nodes} and p != n else None) for n, p in nodes}
    inner = {p for p in parent.values() if p is not None}
    out = {}
    for leaf in parent.keys() - inner:
        path, at = [leaf], parent[leaf]
        while at is not None and at not in path:
            path.append(at)
            at = parent[at]
        if at is None:
            out[leaf] = path[::-1]
    return out


TREES = {
    1: [(0, None), (1, 0), (2, 1), (3, 1), (4, 0), (5, 77), (6, 6)],
    2: [(i, i - 1 if i else None) for i in range(70)],
    3: [(0, 1), (1, 0), (2, 1), (3, None)],
    4: [(0, None)],
    None: [(0, None), (1, 0)],
}


def test_all_paths(spark):
    rows = [(t, n, p) for t, nodes in TREES.items() for n, p in nodes]
    found = {}
    for r in paths(spark.createDataFrame(rows, "tree long, node long, parent long")).collect():
        found.setdefault((r["tree"], r["leaf"]), []).append((-r["up"], r["node"]))
    expected = {(t, leaf): path for t, nodes in TREES.items() for leaf, path in brute_paths(nodes).items()}
    assert {k: [n for _, n in sorted(v)] for k, v in found.items()} == expected


def test_branches_are_ranked_and_formatted(spark):
    rows = [
        (1, 0, None, "user", "hi <|end|>", 0.0), (1, 1, 0, "assistant", "one </s>", 1.0), (1, 2, 0, "assistant", None, 5.0),
        (1, 3, 2, "user", "", None), (1, 3, 2, "user", "", None), (1, 4, 2, "user", "more", 0.0), (1, 5, 4, "assistant", "x" * 50_000, 1.0), (2, 9, None, None, "a", 0.0),
    ]
    df = spark.createDataFrame([(*r, 1, "u") for r in rows], SCHEMA + ", leaf int, up string")
    out = {(r["tree"], r["leaf"]): r for r in format_trees(df, score="score").withColumn("turns", turns_of(F.col("formatted"))).withColumn("said", under_loss(F.col("formatted"), F.col("loss"))).collect()}
    assert {k: (r["rank"], r["score"]) for k, r in out.items()} == {(1, 5): (1, 6.0), (1, 3): (2, 5.0), (1, 1): (3, 1.0), (2, 9): (1, 0.0)}
    assert [tuple(t) for t in out[1, 1]["turns"]] == [("user", "hi <|end|>"), ("assistant", "one </s>")]
    assert out[1, 1]["said"] == "one </s>" and "</s>" not in out[1, 1]["formatted"]
    assert out[1, 5]["said"] == "x" * 50_000 and out[1, 3]["said"] == "" and [tuple(t) for t in out[2, 9]["turns"]] == [("", "a")]
    best = format_trees(df, score="score", branches=1).collect()
    assert {(r["tree"], r["leaf"]) for r in best} == {(1, 5), (2, 9)}
    assert format_trees(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        format_trees(df.drop("role"))


def test_query_against_the_turns(spark):
    sample = "/root/testdata/sf0.001"
    turns = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sample}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = {}
    for conv, said in turns.items():
        learned = "".join(t for r, t in said if r == "assistant")
        expected[conv] = (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(learned), sha(learned))
    df = op9_chat(spark, sample)
    assert {r[0]: tuple(r[1:5]) for r in df.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()} == expected
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
