"""The queries with SQL against that SQL, and the operators' plans."""

import sys
from pathlib import Path

import duckdb
import pytest

from riskloom.llm.queries import ORACLE, QUERIES

SAMPLE = "/root/testdata/sf0.001"


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for path in Path(SAMPLE).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, SAMPLE)
    result = db.execute(ORACLE[name])
    expected = plain([c[0] for c in result.description], result.fetchall())
    assert plain(df.columns, df.collect()) == expected and expected[1]


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", ["op3_secrets", "op9_chat", "op10_pii"])
def test_native_queries_run_no_python(spark, name):
    df = QUERIES[name](spark, SAMPLE)
    assert df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_the_library_does_not_need_this_subpackage():
    import __spark_entry__ as entry

    names = [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("riskloom.llm")]
    saved = {m: sys.modules.pop(m) for m in names}
    sys.modules["riskloom.llm"] = sys.modules["corpus_pipeline"] = None  # as if the files were gone
    try:
        assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
        assert set(entry.oracle_sql()) == set(entry.queries())
    finally:
        del sys.modules["riskloom.llm"], sys.modules["corpus_pipeline"]
        sys.modules.update(saved)
    assert "pipeline" in entry.queries()
