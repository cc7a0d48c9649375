import random
from decimal import Decimal

import pytest
from brute import contexts

from riskloom import model as m
from riskloom.operators.history import with_history
from riskloom.operators.slices import SkewLimits, hot_customers, with_history_at_scale

SCHEMA = "transaction_id string, customer_id string, amount decimal(28,8), country string, payment_status string, ts_ms bigint"
T0 = 1_803_974_400_000


def frame(spark, rows):
    data = [(r["id"], r["customer"], r["amount"], r["country"], r["status"], r["ts"]) for r in rows]
    return spark.createDataFrame(data, SCHEMA)


def collected(df):
    out = {}
    for row in df.collect():
        got = {name: row[name] for name in m.CONTEXT_COLUMNS}
        got["known_countries"] = set(got["known_countries"])
        out[row["transaction_id"]] = got
    return out


def random_rows(seed, n, customers, span_ms, step_ms=1):
    rnd = random.Random(seed)
    return [
        {
            "id": f"t{i:05d}",
            "customer": f"c{rnd.randrange(customers)}",
            "amount": None if rnd.random() < 0.03 else Decimal(rnd.randrange(1, 10**11)).scaleb(-8),
            "country": rnd.choice(["PT", "US", "DE", None]),
            "status": rnd.choice([None, "APPROVED", "DECLINED"]),
            "ts": T0 + rnd.randrange(span_ms // step_ms) * step_ms,
        }
        for i in range(n)
    ]


# Edges of every window: ages around one, five and ten minutes and around the retention, with ties.
EDGES = [0, 59_999, 60_000, 60_001, 299_999, 300_000, 599_999, 600_000, 600_001, 3_599_999, 3_600_000, 3_600_001, 3_600_002]


def edge_rows():
    rows = []
    for tie in range(3):
        for n, age in enumerate(EDGES):
            rows.append(
                {
                    "id": f"e{tie}-{n:02d}",
                    "customer": "edge",
                    "amount": Decimal(tie * 100 + n + 1),
                    "country": f"{chr(65 + n)}{tie}",
                    "status": "DECLINED" if (n + tie) % 4 == 0 else None,
                    "ts": T0 + 3_600_002 - age,
                }
            )
    return rows


@pytest.mark.parametrize(
    "rows",
    [
        pytest.param(random_rows(1, 1500, 20, 4 * 3_600_000), id="sparse"),
        pytest.param(random_rows(2, 1200, 3, 3 * 3_600_000, 60_000), id="crowded-with-ties"),
        pytest.param(random_rows(3, 900, 40, 8 * 3_600_000, 600_000), id="sparse-with-ties"),
        pytest.param(edge_rows(), id="edges"),
    ],
)
def test_matches_brute_force(spark, rows):
    assert collected(with_history(frame(spark, rows))) == contexts(rows)


@pytest.mark.parametrize("cap", [1, 2, 5])
def test_small_entry_limit(spark, cap):
    rows = edge_rows() + random_rows(4, 400, 6, 2 * 3_600_000, 30_000)
    assert collected(with_history(frame(spark, rows), max_entries=cap)) == contexts(rows, cap=cap)


def test_short_retention(spark):
    rows = random_rows(5, 400, 5, 3_600_000, 1_000)
    assert collected(with_history(frame(spark, rows), retention_ms=120_000)) == contexts(rows, retention=120_000)


def test_rejects_an_entry_limit_out_of_range(spark):
    with pytest.raises(ValueError):
        with_history(frame(spark, edge_rows()), max_entries=0)


@pytest.mark.parametrize("span", [4 * 3_600_000, 2], ids=["spread", "one-instant"])
def test_hot_customer_is_sliced_without_changing_results(spark, span):
    rows = random_rows(6, 600, 12, 4 * 3_600_000)
    hot = random_rows(7, 500, 1, span)
    for i, row in enumerate(hot):
        row |= {"id": f"h{i:04d}", "customer": "hot"}
    rows += hot
    df = frame(spark, rows)
    limits = SkewLimits(rows_per_slice=130)
    assert [r["customer_id"] for r in hot_customers(df, limits).collect()] == ["hot"]
    result = with_history_at_scale(df, limits=limits)
    assert result.count() == len(rows)
    assert result.columns == with_history(df).columns
    assert collected(result) == contexts(rows)


def test_every_customer_above_the_limit_is_sliced(spark):
    rows = random_rows(8, 1000, 5, 3_600_000)
    df = frame(spark, rows)
    assert hot_customers(df) is None
    limits = SkewLimits(rows_per_slice=110)
    assert hot_customers(df, limits).count() == 5
    assert collected(with_history_at_scale(df, limits=limits)) == contexts(rows)


def test_plan_has_one_shuffle(spark):
    df = with_history(frame(spark, random_rows(9, 50, 3, 3_600_000)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
