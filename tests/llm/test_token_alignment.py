"""Token alignment against a plain version that encodes whole texts and compares every pair of tokens nearby."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskloom.llm.op11_token_alignment import MODEL, TOKENIZER
from riskloom.llm.token_alignment import SPACE, align, byte_level_alphabet

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    tokenizer = Tokenizer.from_file(P.path(TOKENIZER))
    tokenizer.encode_special_tokens = True
    name_a = {i: t for t, i in json.load(open(P.path(TOKENIZER)))["model"]["vocab"].items()}
    alphabet = byte_level_alphabet()
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path(MODEL))

    def bytes_b(i):
        piece = pieces.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if pieces.is_byte(i) else piece.replace(SPACE, " ").encode()

    found = []
    for _, text in rows:
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        ta, tb = [bytes(alphabet[c] for c in name_a[i]) for i in a], [bytes_b(i) for i in b]
        if not text or not b"".join(ta) == b"".join(tb) == b" " + text.encode():
            found.append(([], [], []))
            continue
        spans = []
        for tokens in (ta, tb):
            at, out = 0, []
            for t in tokens:
                out.append((at, at + len(t)))
                at += len(t)
            spans.append(out)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if max(s, u) < min(e, v)]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            side = [",".join(str(x) for x, (s, e) in zip(ids, sp, strict=True) if lo <= s and e <= hi) for ids, sp in zip((a, b), spans, strict=True)]
            groups.append("|".join(side))
        found.append((a, b, links, groups))
    counts = Counter(p for f in found for p in set(f[2]))
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (doc, _), f in zip(rows, found, strict=True):
        if not f[0]:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = f
        best = sum(counts[p] == most[p[0]] for p in links)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), sha))
    return out


def random_text(rng):
    parts = ["the", "of", "straße", "naïve", "日本", "x" * rng.randrange(1, 30), "don't", "3.14", "<|endoftext|>", "</s>", "\n", "\t", "  ", "é", "🙂", "foo\nbar", ""]
    return " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))


def result(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, align(docs, P.path(TOKENIZER), P.path(MODEL), **options).select("doc_id", *NAMES).collect()), key=str)


@pytest.mark.parametrize("block_bytes, shard_keys", [(200, 50), (1 << 20, 1 << 20)])
def test_same_as_brute_force(spark, block_bytes, shard_keys):
    rng = random.Random(3)
    rows = [(i, random_text(rng)) for i in range(120)]
    rows += [(200 + i, "one text that many documents share, the of the") for i in range(40)]
    rows += [(300, None), (301, ""), (302, " "), (303, "a▁b"), (304, " lead and trail "), (305, "a"), (305, "a"), (None, "the of"), (306, "\x00 x"), (307, "w " * 3000)]
    assert result(spark, rows, block_bytes=block_bytes, shard_keys=shard_keys) == sorted(brute(rows), key=str)


def test_empty_table_and_clashing_names(spark):
    assert result(spark, spark.createDataFrame([], "doc_id long, text string").collect()) == []
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, copies long, digest string").withColumnRenamed("digest", "block")
    found = align(docs, P.path(TOKENIZER), P.path(MODEL)).first()
    assert found["doc_id"] == 1 and found["n_links"] == 2
    with pytest.raises(ValueError):
        align(docs.drop("text"), P.path(TOKENIZER), P.path(MODEL))


def test_query_on_test_table(spark):
    from riskloom.llm.op11_token_alignment import op11_token_alignment

    sample = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if not r[1] or len(r[1]) < 3000]
    found = {r["doc_id"]: r for r in op11_token_alignment(spark, sample).collect()}
    assert len(found) == len(rows)
    for doc, n_a, n_b, n_groups, n_links, *_, sha in brute(short):
        r = found[doc]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == (n_a, n_b, n_groups, n_links, sha)
