import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import perfect_hash
from riskloom.llm.line_dedup import BLANK, dedup_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_chars=20, min_docs=3):
    """doc -> (lines, dropped, kept), straight from the definition."""
    key = lambda line: line.strip(BLANK).translate(LOWER)
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = {}
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == doc]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def run(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = dedup_lines(df, **options).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    return {r[0]: (r[1], r[2], r[3]) for r in rows}


def test_perfect_hash_is_minimal_and_knows_its_keys():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, (2, 5000), dtype=np.uint64)
    a[:40] = a[0]  # equal first halves
    index = perfect_hash.Index(perfect_hash.build(a, b, np.arange(5000), -np.arange(5000)))
    slots = index.find(a, b)
    assert sorted(slots.tolist()) == list(range(5000))
    assert (index.counts[slots] == np.arange(5000)).all() and (index.keepers[slots] == -np.arange(5000)).all()
    assert (index.find(a, b + np.uint64(1)) == -1).all()
    empty = perfect_hash.Index(perfect_hash.build(a[:0], b[:0], np.empty(0, int), np.empty(0, int)))
    assert (empty.find(a, b) == -1).all()


# many shards and no hot keys, one shard and only hot keys
@pytest.mark.parametrize("options", [{"shard_keys": 7, "hot_keys": 1, "salts": 3}, {"hot_keys": 1000}])
def test_against_the_definition(spark, options):
    rng = random.Random(3)
    shared = [f"  Shared Line Number {i} in the corpus\t" for i in range(25)]
    docs = []
    for doc in range(120):
        lines = [rng.choice([rng.choice(shared), shared[0].lower(), f"own line of document {doc} {rng.random()}", "short", ""]) for _ in range(rng.randrange(12))]
        docs.append((doc, "\n".join(lines)))
    docs += [(200, None), (201, ""), (202, "\n\n"), (203, "ÄÖÜ in upper case stays\n" * 4), (204, "äöü in upper case stays"), (205, "\r\n".join(shared))]
    docs.append((206, "\n".join([shared[1]] * 3000 + ["x" * 100_000])))
    assert run(spark, docs, **options) == brute(docs)


def test_rows_without_id_and_repeated_rows(spark):
    line = "a line that is long enough to count"
    found = dedup_lines(spark.createDataFrame([(None, line), (4, line), (4, line), (2, line)], "doc_id long, text string"))
    rows = sorted(((r["row"]["doc_id"], r["n_dropped"]) for r in found.collect()), key=str)
    assert rows == [(2, 1), (4, 0), (4, 0), (None, 1)]


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a\nb", 5, "x")], "doc_id long, text string, n_lines int, lost_id string")
    row = dedup_lines(df).first()
    assert (row["row"]["n_lines"], row["n_lines"], row["kept"]) == (5, 2, "a\nb")
    assert dedup_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="missing"):
        dedup_lines(df.drop("text"))


def test_query_digest(spark):
    from riskloom.llm.op2_line_dedup import op2_line_dedup

    sample = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text").collect()]
    expected = {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in brute(docs).items()}
    assert {r[0]: tuple(r[1:]) for r in op2_line_dedup(spark, sample).select("doc_id", "n_lines", "n_dropped", F.col("kept_sha256")).collect()} == expected
