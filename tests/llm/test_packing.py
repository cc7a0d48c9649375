import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskloom.llm.op5_packing import op5_packing
from riskloom.llm.packing import Packer, pack
from riskloom.llm.tokens import Encoder

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def texts():
    rng = random.Random(2)
    odd = ["", " ", "a", "  two", "two  spaces", "tail ", "tail  ", "\n\n x", "x \n y", "x\n y", "x \t y", "it's 's", "<|endoftext|> a", "a <|endoftext|> b", "a<|endoftext|>b  c <|endoftext|>", " <|endoftext|>", "naïve — ß", "汉字 " * 40, "a b  c", "1 2 3.4 !! ?", "x" * 3000, "é a"]
    return odd + ["".join(rng.choice(["th", "e", " ", " ", ".", "\n", "  ", "é", "9"]) for _ in range(rng.randrange(400))) for _ in range(60)]


def test_pieces_give_the_ids_of_the_tokenizer(tokenizer):
    encoder = Encoder(open(FILE, encoding="utf-8").read())
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts(), encoder.encode(texts()), strict=True):
            assert ids == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


def test_special_strings_can_be_plain_text(tokenizer):
    assert tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    plain = Tokenizer.from_file(FILE)
    plain.encode_special_tokens = True
    encoder = Encoder(open(FILE, encoding="utf-8").read(), plain=True)
    for text, ids in zip(texts(), encoder.encode(texts()), strict=True):
        assert ids == b"".join(i.to_bytes(4, "little") for i in plain.encode(text, add_special_tokens=False).ids), repr(text)


def check(pieces, ids_of):
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p["length"] > 0 and p["doc_tokens"] == len(ids_of[p["doc_id"]])
        of_doc[p["doc_id"]].append((p["start"], p["length"]))
        of_sequence[p["sequence_id"]].append((p["offset"], p["length"], p["tier"]))
    for doc, ids in ids_of.items():
        assert [x for s, n in sorted(of_doc[doc]) for x in range(s, s + n)] == list(range(len(ids)))
    short = 0
    for parts in of_sequence.values():
        at = 0
        for offset, length, tier in sorted(parts):
            assert offset == at
            at += length
        assert at <= tier
        short += at < tier
    return short, len(of_sequence)


def test_packing_of_all_documents(spark, tokenizer):
    docs = [(i, t) for i, t in enumerate(texts())] + [(1000, None), (1001, "long text " * 4000)]
    ids_of = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for d, t in docs}
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, ids int").coalesce(2)
    pieces = pack(df, FILE).collect()
    for p in pieces:
        mine = ids_of[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert bytes(p["ids"]) == b"".join(i.to_bytes(4, "little") for i in mine)
    short, _ = check(pieces, ids_of)
    assert short <= 2  # one for each partition
    assert pack(df.limit(0), FILE).count() == 0
    assert len(pack(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string"), FILE).collect()) >= 2


def test_query_on_a_table(spark, tokenizer):
    sample = "/root/testdata/sf0.001"
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text").collect()}
    ids_of = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for d, t in docs.items()}
    pieces = op5_packing(spark, sample).collect()
    for p in pieces:
        mine = ids_of[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in mine))
    check(pieces, ids_of)


def test_steps_weigh_the_same():
    packer, rng = Packer((128, 256, 512, 1024), 4096, 3), random.Random(1)
    for doc in range(900):
        packer.add(doc, bytes(4 * rng.randrange(1, 3000)))
        packer.pack()
    packer.finish()
    weights = defaultdict(int)
    for _, _, length, _, _, _, _, tier, step in packer.out:
        weights[tier, step] += length
    last = {t: max(s for x, s in weights if x == t) for t, _ in weights}
    assert all(w == 4096 for (t, s), w in weights.items() if s != last[t])
    assert len({t for t, _ in weights}) > 1


def test_steps_are_whole_over_all_partitions(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(str(rng.randrange(1000)) for _ in range(rng.choice([3, 40, 90, 200, 700])))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6, "doc_id")
    pieces = pack(df, FILE, step_tokens=4096).collect()
    weights, short = defaultdict(int), defaultdict(int)
    for p in pieces:
        weights[p["tier"], p["step"]] += p["length"]
    of_sequence = defaultdict(int)
    for p in pieces:
        of_sequence[p["sequence_id"], p["tier"], p["step"]] += p["length"]
    for (_, tier, step), length in of_sequence.items():
        short[tier, step] += tier - length
    for tier in {t for t, _ in weights}:
        steps = sorted(s for t, s in weights if t == tier)
        assert steps == list(range(len(steps)))  # numbered over the whole table
        assert all(weights[tier, s] + short[tier, s] == 4096 for s in steps[:-1])
