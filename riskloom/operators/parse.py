"""Tolerant JSON parsing: every raw message becomes one row, with a transaction or with an error, never an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import model as m
from riskloom.functions.instants import parse_instant
from riskloom.functions.text import utf8_text

# JSON names of the transaction fields and the error texts.
_TEXT_FIELDS = {
    "transactionId": "transaction_id",
    "customerId": "customer_id",
    "merchantId": "merchant_id",
    "currency": "currency",
    "country": "country",
}
_ALL_FIELDS = [*_TEXT_FIELDS, "amount", "timestamp", "paymentStatus"]
EMPTY_PAYLOAD = "empty payload"
NOT_AN_OBJECT = "payload is not a JSON object"
INVALID_JSON = "payload is not valid JSON"
INVALID_UTF8 = "payload is not valid UTF-8"

_CORRUPT = "_corrupt"
_JSON_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in [*_ALL_FIELDS, _CORRUPT]])
_JSON_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": _CORRUPT,
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,9})?$"
_JSON_SPACE = " \t\r\n"
_MANY_DIGITS = r"\d(\.?\d){15}"


def _absent(text: Column) -> Column:
    """Blank text and the word null in a non-text field count as no value."""
    trimmed = F.trim(text)
    return F.when((trimmed != "") & (trimmed != "null"), trimmed)


def _amount(given: Column) -> tuple[Column, Column]:
    """(decimal, error).  A number that the money type cannot hold exactly is an error, not a rounded amount."""
    exponent_text = F.regexp_extract(given, r"[eE]([+-]?\d{1,9})$", 1)
    exponent = F.when(exponent_text == "", F.lit(0)).otherwise(exponent_text.try_cast("int"))
    fraction = F.regexp_extract(given, r"\.(\d*)", 1)
    places = F.length(F.regexp_replace(fraction, "0+$", "")) - exponent
    parsed = given.try_cast(m.MONEY)
    error = (
        F.when(given.isNull(), F.lit(None))
        .when(~given.rlike(_NUMBER), F.lit("amount is not a number"))
        .when(parsed.isNull() | (places > m.MONEY.scale), F.lit("amount does not fit DECIMAL(28,8)"))
    )
    return F.when(error.isNull(), parsed), error


def _status(text: Column) -> tuple[Column, Column]:
    """(status, error).  The name must match exactly; the ordinals 0 and 1 are accepted as well."""
    trimmed = F.trim(text)
    status = (
        F.when(trimmed.isin(*m.PAYMENT_STATUSES), trimmed)
        .when(trimmed == "0", F.lit(m.APPROVED))
        .when(trimmed == "1", F.lit(m.DECLINED))
    )
    return status, F.when(text.isNotNull() & status.isNull(), F.lit("paymentStatus is not a known value"))


def _nested_error(payload: Column) -> Column:
    """A text field must not hold an object or an array; only text that looks like one is checked further."""

    def check(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "variant"))
        nested = F.col(f"_doc.{name}").rlike(r"^\s*[\[{]") & ~F.coalesce(kind == "STRING", F.lit(False))
        return F.when(nested, F.lit(f"{name} is not a text"))

    return F.coalesce(*[check(name) for name in _TEXT_FIELDS])


def parse_messages(raw: DataFrame) -> DataFrame:
    """Adds the transaction columns, ``payload`` (for diagnostics) and ``error`` (NULL when the message was parsed).

    ``raw`` has the columns of a log source: ``value, topic, partition, offset``.  Unknown JSON fields are ignored and
    missing ones become NULL.  Amount and time are read as text and checked here, because typed JSON columns accept
    more than they should (``"1,000"``, dates without a zone) and drop digits silently.
    """
    value, payload = F.col("value"), F.col("payload")
    rows = raw.withColumn("payload", F.coalesce(utf8_text(value), F.lit(""))).withColumn(
        "_doc", F.from_json("payload", _JSON_SCHEMA, _JSON_OPTIONS)
    )
    # JSON numbers read as text pass through a double, which keeps 15 digits; longer ones take the exact way.
    exact = F.try_variant_get(F.try_parse_json(payload), "$.amount", "string")
    amount_text = F.when(payload.rlike(_MANY_DIGITS), F.coalesce(exact, F.col("_doc.amount"))).otherwise(
        F.col("_doc.amount")
    )
    rows = rows.withColumn("_given_amount", _absent(amount_text)).withColumn("_given_time", F.trim("_doc.timestamp"))
    given_time = F.when(F.col("_given_time") != "", F.col("_given_time"))
    amount, amount_error = _amount(F.col("_given_amount"))
    status, status_error = _status(F.col("_doc.paymentStatus"))
    rows = (
        rows.withColumn("_amount", amount)
        .withColumn("_amount_error", amount_error)
        .withColumn("_time", parse_instant(given_time))
    )
    time_error = F.when(given_time.isNotNull() & F.col("_time").isNull(), F.lit("timestamp is not an ISO-8601 instant"))

    is_object = F.ltrim(payload, F.lit(_JSON_SPACE)).startswith("{")
    readable = F.try_parse_json(payload).isNotNull() | (F.trim(payload, F.lit(_JSON_SPACE)) == "")
    reason = (
        F.when(value.isNull() | (F.length(value) == 0), F.lit(EMPTY_PAYLOAD))
        .when(~F.is_valid_utf8(value.cast("string")), F.lit(INVALID_UTF8))
        .when(~is_object & readable, F.lit(NOT_AN_OBJECT))
        .when(~is_object | F.col(f"_doc.{_CORRUPT}").isNotNull() | F.col("_doc").isNull(), F.lit(INVALID_JSON))
        .otherwise(F.coalesce(_nested_error(payload), F.col("_amount_error"), time_error, status_error))
    )
    rows = rows.withColumn("error", F.concat(F.lit(m.MALFORMED_PREFIX), reason))
    parsed = F.col("error").isNull()
    fields = {column: F.col(f"_doc.{name}") for name, column in _TEXT_FIELDS.items()}
    fields |= {"amount": F.col("_amount"), "timestamp": F.col("_time"), "payment_status": status}
    row = F.struct(
        *[F.when(parsed, fields[name]).alias(name) for name in m.TRANSACTION_COLUMNS],
        F.when(parsed, F.unix_millis("_time")).alias("ts_ms"),
        F.col("error").alias("error"),
    )
    others = [c for c in raw.columns if c not in ("value", *m.COORDINATES)]
    # A one-row generator, so that filters on the result are not rewritten into the parsing expressions.
    return rows.select(F.inline(F.array(row)), "payload", *m.COORDINATES, *others)
