import re

import pytest
from pyspark.sql import functions as F

from riskloom.llm import pii

GIVEN = [
    (1, "Mail und.34@mail7.example.com or UND.34@MAIL7.EXAMPLE.COM, call +1 (377) 555-0271 or +1 377 555 0271."),
    (2, "épa.92@mail7.example.com lives at 191.26.250.130, not 999.1.1.1 or 1.2.3; card 4111 1111 1111 1111 / 4111111111111111"),
    (3, "Frau Anna Müller met Mr. Lopez and Dr Anna Lopez; госпожа Анна Иванова; DE89 3704 0044 0532 0130 00, 123-45-6789"),
    (4, None), (5, ""), (6, "version 12.5, 2024-01-01, Mr and Mrs went home, a@b, 12345678901234567890123"),
    (7, "x" * 200_000 + " und.34@mail7.example.com"), (7, "x" * 200_000 + " und.34@mail7.example.com"), (None, "191.26.250.130"),
]


@pytest.fixture(scope="module")
def out(spark):
    df = spark.createDataFrame([(*r, "k") for r in GIVEN], "doc_id long, text string, kinds string")
    return [(r["row"]["doc_id"], r["replaced"], r["kinds"]) for r in pii.pseudonymize(df, "key").collect()]


def text(out, doc):
    return next(t for d, t, _ in out if d == doc)


def test_nothing_personal_is_left_and_the_rest_stays(out):
    for secret in ("und.34", "UND.34", "555-0271", "191.26", "4111", "Müller", "Lopez", "Анна", "3704", "123-45-6789", "épa.92"):
        assert not [d for d, t, _ in out if t and secret in t], secret
    assert text(out, 4) is None and text(out, 5) == "" and text(out, 6) == GIVEN[5][1]
    assert text(out, 1).startswith("Mail ") and "999.1.1.1 or 1.2.3" in text(out, 2) and text(out, 7).startswith("x" * 200_000 + " ")
    assert len(out) == len(GIVEN)


def test_format_and_coreference(out):
    first = re.fullmatch(r"Mail (\S+) or (\S+), call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3} \d{3} \d{4})\.", text(out, 1))
    assert first[2] == first[1].upper() and re.fullmatch(r"[a-z]{3}\.\d\d@d\w+\.example", first[1])
    assert re.sub(r"\D", "", first[3]) == re.sub(r"\D", "", first[4])
    assert text(out, 7).endswith(" " + first[1])
    second = re.fullmatch(r"(\S+)@(\S+) lives at (\S+), not .*; card (.+) / (\d{16})", text(out, 2))
    assert second[2] == first[1].split("@")[1]  # one domain, one surrogate
    assert second[3] == text(out, None) and second[4].replace(" ", "") == second[5]
    digits = [int(c) for c in reversed(second[5])]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    third = re.fullmatch(r"Frau (\w+) (\w+) met Mr\. (\w+) and Dr (\w+) (\w+); госпожа (\w+) (\w+); DE\d\d( \d{4}){4} \d\d, \d{3}-\d\d-\d{4}", text(out, 3))
    assert third[1] == third[4] and third[1].endswith("lia") and third[3] == third[5] != third[2]
    assert re.fullmatch("[А-Яа-я]+ля", third[6])


def test_other_keys_give_other_surrogates(spark):
    df = spark.createDataFrame(GIVEN[:1], "doc_id long, text string")
    assert len({pii.pseudonymize(df, k).first()["replaced"] for k in ("a", "b", "a")}) == 2
    assert pii.pseudonymize(df.limit(0), "a").count() == 0


def test_conflicts_are_resolved(spark, monkeypatch):
    """With a surrogate space of 40 values, 30 entities collide; all must end up different, and none real."""
    real = pii.surrogate

    def narrow(kind, canonical, attempt, key):
        return F.pmod(F.xxhash64(canonical, attempt, F.lit(key)), F.lit(40)).cast("string")

    monkeypatch.setattr(pii, "surrogate", narrow)
    entities = spark.createDataFrame([("ssn", str(1000 + i)) for i in range(28)] + [("ssn", "7"), ("ssn", "8")], "kind string, canonical string")
    later = pii.later_attempts(entities, "k")
    used = entities.join(later, ["kind", "canonical"], "left").withColumn("v", narrow(None, F.col("canonical"), F.coalesce("attempt", F.lit(0)), "k"))
    values = [r["v"] for r in used.collect()]
    assert len(set(values)) == 30 and not {"7", "8"} & set(values)
    monkeypatch.setattr(pii, "surrogate", real)


def test_documents_use_later_attempts(spark, monkeypatch):
    monkeypatch.setattr(pii, "later_attempts", lambda entities, key: entities.filter("kind = 'ip'").withColumn("attempt", F.lit(2)))
    df = spark.createDataFrame(GIVEN[:3] + GIVEN[8:], "doc_id long, text string")
    rows = {r["row"]["doc_id"]: r["replaced"] for r in pii.pseudonymize(df, "key").collect()}
    value = spark.range(1).select(pii.surrogate(F.lit("ip"), F.lit("191.26.250.130"), F.lit(2), "key")).first()[0]
    assert rows[None] == value and f"lives at {value}," in rows[2]


def test_plan_is_native(spark):
    df = pii.pseudonymize(spark.createDataFrame(GIVEN[:2], "doc_id long, text string"), "key")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_phones_end_where_other_entities_begin(spark):
    texts = {
        "us": "+1 (826) 555-4081 190.137.223.204", "same": "+1 (826) 555-4081", "long": "+44 20 7946 0958 190.137.223.204",
        "ssn": "+44 20 7946 0958 123-45-6789", "two": "+44 20 7946 0958 377-555-0271", "card": "+44 20 7946 0958 4111 1111 1111 1111",
        "year": "+1 (826) 555-4081 2024", "dots": "+49 30 12.34.56.78", "dashes": "+49 30 123-456-7890",
    }
    df = spark.createDataFrame(list(texts.items()), "doc string, text string")
    rows = {r["row"]["doc"]: (r["replaced"], r["kinds"]) for r in pii.pseudonymize(df, "key").collect()}
    kinds = {d: k for d, (_, k) in rows.items()}
    assert kinds == {
        "us": ["phone", "ip"], "same": ["phone"], "long": ["phone", "ip"], "ssn": ["phone", "ssn"], "two": ["phone", "phone"],
        "card": ["phone", "card"], "year": ["phone"], "dots": ["phone"], "dashes": ["phone"],
    }
    same = rows["same"][0]
    assert rows["us"][0].startswith(same + " ") and rows["year"][0] == same + " 2024"
    assert "190" not in rows["us"][0].removeprefix(same).split(".") and "204" != rows["us"][0].split(".")[-1]
    assert len({rows[d][0][:16] for d in ("long", "ssn", "two", "card")}) == 1


def test_names_never_run_out(spark, monkeypatch):
    """With two syllables there are eight names of the first length for 40 entities; three rounds without progress must not come."""
    monkeypatch.setitem(pii._SYLLABLES, "latin", "ba be")
    entities = spark.createDataFrame([("family", f"name{i}") for i in range(40)], "kind string, canonical string")
    later = pii.later_attempts(entities, "k", 3)
    used = entities.join(later, ["kind", "canonical"], "left")
    values = [r[0] for r in used.select(pii.surrogate(F.col("kind"), F.col("canonical"), F.coalesce("attempt", F.lit(0)), "k")).collect()]
    assert len(set(values)) == 40 and max(map(len, values)) > 8


def test_names_of_all_forms_and_later_mentions(spark):
    texts = {
        "later": "Doe wrote. Dr. Jane Doe came; Doe said Jane's DOE, not doe or Doering.", "three": "Mrs. Mary Ann Evans left",
        "hyphen": "Frau Müller-Schmidt ging, Müller-Schmidt kam", "inner": "Dr. McDonald and Mr. O'Brien's", "initials": "Mr. J. R. Smith, Mr J Smith",
        "none": "Doe and Jane", "other": "Mr. Doe",
    }
    df = spark.createDataFrame(list(texts.items()), "doc string, text string")
    rows = {r["row"]["doc"]: (r["replaced"], r["kinds"]) for r in pii.pseudonymize(df, "key").collect()}
    out = {d: t for d, (t, _) in rows.items()}
    later = re.fullmatch(r"(\w+) wrote\. Dr\. (\w+) (\w+) came; (\w+) said (\w+)'s (\w+), not doe or Doering\.", out["later"])
    doe = out["other"].removeprefix("Mr. ")
    assert later[1] == later[3] == later[4] == doe != "Doe" and later[6] == doe.upper() and later[5] == later[2] != "Jane"
    assert rows["later"][1] == ["name"] * 5
    assert re.fullmatch(r"Mrs\. \w+lia \w+lia \w+rd left", out["three"])
    hyphen = re.fullmatch(r"Frau (\w+rd) ging, (\w+) kam", out["hyphen"])
    assert hyphen[1] == hyphen[2]
    assert re.fullmatch(r"Dr\. \w+rd and Mr\. \w+rd's", out["inner"])
    initials = re.fullmatch(r"Mr\. [A-Z]\. [A-Z]\. (\w+rd), Mr [A-Z] (\w+rd)", out["initials"])
    assert initials[1] == initials[2] and out["none"] == texts["none"]


def test_valid_ibans_stay_valid(spark):
    from pyspark.sql import functions as F

    from riskloom.llm.pii import iban_remainder, surrogate

    def remainder(iban):
        return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97

    valid = ["DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "NO9386011117947", "MT84MALT011000012345MTLCAST001S"]
    wrong = ["DE00370400440532013000", "GB11NWBK60161331926819"]
    df = spark.createDataFrame([(i,) for i in valid + wrong], "iban string")
    rows = df.select("iban", iban_remainder(F.col("iban")).alias("left"), *[surrogate(F.lit("iban"), F.col("iban"), F.lit(k), "key").alias(f"s{k}") for k in range(3)]).collect()
    for r in rows:
        assert r["left"] == remainder(r["iban"])
        for k in range(3):
            new = r[f"s{k}"]
            assert new[:2] == r["iban"][:2] and len(new) == len(r["iban"]) and new != r["iban"]
            assert [c.isdigit() for c in new[4:]] == [c.isdigit() for c in r["iban"][4:]]
            assert r["iban"] in wrong or remainder(new) == 1
    assert len({r[f"s{k}"] for r in rows for k in range(3)}) == 3 * len(rows)
