import corpus_pipeline
import pytest

from riskloom.llm.shared import table

SAMPLE = "/root/testdata/sf0.01"


def test_stages_act_on_what_is_kept(spark, monkeypatch):
    import re

    docs = table(spark, SAMPLE, "documents")
    kept = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = current
        current = stage(spark, before, SAMPLE).cache()
        kept[name] = {r["doc_id"]: r["text"] for r in current.collect()}
        assert current.columns == docs.columns
        assert kept[name].keys() <= {r[0] for r in before.select("doc_id").collect()}
    clean = {r[0] for r in table(spark, SAMPLE, "labels").filter("toxic = 0").select("doc_id").collect()}
    assert clean <= kept["toxicity"].keys()
    assert kept["line_dedup"].keys() == kept["toxicity"].keys()
    sets = {}
    for doc, text in kept["ngram_join"].items():
        found = re.findall(r"[^\W_]+", text.lower())
        if len(found) >= 5:
            sets.setdefault(frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4)), []).append(doc)
    assert all(len(v) == 1 for v in sets.values())
    items = [r[0] for r in table(spark, SAMPLE, "benchmark").select("text").collect()]
    assert not [d for d, t in kept["decontamination"].items() if any(i in t for i in items)]
    gone = kept["ngram_join"].keys() - kept["decontamination"].keys()
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    assert all(any(plain(i)[:40] in plain(kept["ngram_join"][d]) for i in items) for d in gone)
    pieces = corpus_pipeline.STAGES[-1][1](spark, current, SAMPLE).collect()
    total = {}
    for p in pieces:
        total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
    assert total.keys() == kept["decontamination"].keys() and all(total[p["doc_id"]] == p["doc_tokens"] for p in pieces)


@pytest.mark.parametrize("number", range(5))
def test_stages_take_nulls_and_empty_tables(spark, number):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, None, "en", "s", 1)], schema)
    name, stage = corpus_pipeline.STAGES[number]
    assert stage(spark, odd.limit(0), SAMPLE).count() == 0
    rows = stage(spark, odd, SAMPLE).count()
    assert rows == 4 if name != "packing" else rows >= 4
