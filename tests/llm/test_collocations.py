"""Collocations against plain counting."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.llm.collocations import exact_score, mine


def brute(rows, least, longest, top, drop):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {k: v for k, v in f.items() if v >= least and len(k[1]) >= 2}
    rows = {}
    for (lang, p), a in found.items():
        held = [
            v for (la, q), v in found.items()
            if la == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        ]
        if any(100 * v >= drop * a for v in held):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    out = []
    for lang, best in rows.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], start=1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def sample(rng, n):
    words = ["the", "The", "of", "x\x1c", "naïve", "a-b", "日本", "it's", "9", "von"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "; ", "!", "\r\n"]) for _ in range(rng.randrange(60))]
        rows.append(("".join(parts), rng.choice(["en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", "fr"), (" ,, ", "it"), ("so long " * 4000, "long"), ("only once here", "es")] + [rows[0]] * 5


@pytest.mark.parametrize(
    "least, longest, top, drop, block_bytes, shard_keys",
    [(10, 3, 2000, 50, 300, 20), (3, 5, 50, 50, 2000, 64), (10, 2, 7, 50, 1 << 20, 1 << 20), (2, 4, 2000, 90, 1, 5)],
)
def test_same_as_brute_force(spark, least, longest, top, drop, block_bytes, shard_keys):
    rows = sample(random.Random(least + longest), 40)
    docs = spark.createDataFrame(rows, "text string, lang string")
    found = mine(docs, least=least, longest=longest, top=top, drop_percent=drop, block_bytes=block_bytes, shard_keys=shard_keys)
    assert sorted(map(tuple, found.collect())) == brute(rows, least, longest, top, drop)


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(200):
        a = rng.randrange(1, 10 ** rng.randrange(1, 16))
        rows.append((a, a + rng.randrange(10 ** rng.randrange(1, 15)), a + rng.randrange(10 ** rng.randrange(1, 15))))
    rows = [r for r in rows if max(r) < 10**15]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    for r in df.select("*", exact_score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect():
        assert r["s"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"])


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([("a b " * 12, "en", 5, "x")], "text string, lang string, block long, n string")
    assert sorted(r["phrase"] for r in mine(docs).collect()) == ["a b a", "b a b"]
    assert mine(docs.limit(0)).count() == 0
    assert sorted(mine(docs.select("text", "lang")).collect()) == sorted(mine(docs).collect())
    with pytest.raises(ValueError):
        mine(docs.drop("lang"))
    with pytest.raises(ValueError):
        mine(docs, longest=1)
