"""Validation rules: stateless plug-ins that report what is wrong with a transaction."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import UTC, datetime, timedelta
from typing import Protocol, runtime_checkable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import model as m
from riskloom.functions.text import is_blank, plain_number

# Violation codes.
REQUIRED_FIELD_MISSING = "REQUIRED_FIELD_MISSING"
AMOUNT_NOT_POSITIVE = "AMOUNT_NOT_POSITIVE"
CURRENCY_NOT_SUPPORTED = "CURRENCY_NOT_SUPPORTED"
RULE_ERROR = "RULE_ERROR"
TRANSACTION_ID_MISSING = "PIPELINE_TRANSACTION_ID_MISSING"
CUSTOMER_ID_MISSING = "PIPELINE_CUSTOMER_ID_MISSING"
TIMESTAMP_MISSING = "PIPELINE_TIMESTAMP_MISSING"
SUPPORTED_CURRENCIES = ("EUR", "USD", "GBP")
# Violation messages.
AMOUNT_MESSAGE = "amount must be greater than 0 but was "
CURRENCY_MESSAGE = "currency not supported: "
REQUIRED_MESSAGE = "required field is missing or blank: "
TRANSACTION_ID_MESSAGE = "transactionId is required (deduplication key)"
CUSTOMER_ID_MESSAGE = "customerId is required (partition key)"
TIMESTAMP_MESSAGE = "timestamp is required (event time)"


@runtime_checkable
class ValidationRule(Protocol):
    """What a validation plug-in provides."""

    name: str

    def violations(self, evaluated_at: Column) -> Column:
        """``ARRAY<STRUCT<code, message>>`` over the transaction columns; empty when the row is fine."""


def violation_if(broken: Column, code: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(broken, F.struct(F.lit(code).alias("code"), text.alias("message")))


def violation_list(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks)).cast(m.VIOLATIONS_TYPE)


class MinimumAmountRule:
    name = "MinimumAmountRule"

    def violations(self, evaluated_at: Column) -> Column:
        amount = F.col("amount")
        message = F.concat(F.lit(AMOUNT_MESSAGE), plain_number(amount))
        return violation_list(violation_if(amount <= 0, AMOUNT_NOT_POSITIVE, message))


class RequiredFieldsRule:
    name = "RequiredFieldsRule"

    # The fields in the order they are reported.
    texts = (
        ("transaction_id", "transactionId"),
        ("customer_id", "customerId"),
        ("merchant_id", "merchantId"),
        ("currency", "currency"),
    )
    others = ("amount", "timestamp")

    def violations(self, evaluated_at: Column) -> Column:
        def missing(broken: Column, shown: str) -> Column:
            return violation_if(broken, REQUIRED_FIELD_MISSING, REQUIRED_MESSAGE + shown)

        return violation_list(
            *[missing(is_blank(F.col(column)), shown) for column, shown in self.texts],
            *[missing(F.col(column).isNull(), column) for column in self.others],
        )


class SupportedCurrencyRule:
    name = "SupportedCurrencyRule"

    def violations(self, evaluated_at: Column) -> Column:
        currency = F.col("currency")
        message = F.concat(F.lit(CURRENCY_MESSAGE), currency)
        return violation_list(violation_if(~currency.isin(*SUPPORTED_CURRENCIES), CURRENCY_NOT_SUPPORTED, message))


def invariant_violations() -> Column:
    """What every run needs whatever plug-ins are present: the two keys and the event time."""
    return violation_list(
        violation_if(is_blank(F.col("transaction_id")), TRANSACTION_ID_MISSING, TRANSACTION_ID_MESSAGE),
        violation_if(is_blank(F.col("customer_id")), CUSTOMER_ID_MISSING, CUSTOMER_ID_MESSAGE),
        violation_if(F.col("timestamp").isNull(), TIMESTAMP_MISSING, TIMESTAMP_MESSAGE),
    )


_TIMES = ("timestamp", "evaluated_at")
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def _instant(micros: str | None) -> datetime | None:
    """A time in UTC, or None where it is missing."""
    return None if micros is None else _EPOCH + timedelta(microseconds=int(micros))


class PandasValidationRule:
    """Adapter for a rule written in Python: ``check(row) -> [(code, message), ...]``.

    Rows travel in Arrow batches.  A check that raises rejects only its own row, with a ``RULE_ERROR`` violation.
    """

    def __init__(self, name: str, check: Callable[[dict], Sequence[tuple[str, str]]]) -> None:
        self.name = name
        self._check = check

    def violations(self, evaluated_at: Column) -> Column:
        name, check = self.name, self._check

        @F.pandas_udf(m.VIOLATIONS_TYPE)
        def run(rows: pd.DataFrame) -> pd.Series:
            found = []
            for row in rows.to_dict("records"):
                row = {k: _instant(v) if k in _TIMES else v for k, v in row.items()}
                try:
                    found.append([{"code": code, "message": message} for code, message in check(row)])
                except Exception as error:
                    found.append([{"code": RULE_ERROR, "message": f"{name} failed: {error!r}"}])
            return pd.Series(found)

        # Times go as text of their microseconds: the nanoseconds of pandas end in the year 2262, and a missing number
        # would turn the others into floats.
        given = {c: F.col(c) for c in m.TRANSACTION_COLUMNS} | {"evaluated_at": evaluated_at}
        sent = {c: F.unix_micros(v).cast("string") if c in _TIMES else v for c, v in given.items()}
        return run(F.struct(*[v.alias(c) for c, v in sent.items()]))


class ColumnValidationRule:
    """Adapter for a rule written over whole columns: ``check(columns) -> [[(code, message), ...], ...]``, a list a row.

    ``columns`` maps the names the rule asks for to Arrow arrays; nothing else travels.  A batch that the check fails on, or
    answers with another number of rows, is halved until the rows are found that it fails on; only those get
    a ``RULE_ERROR`` violation.
    """

    def __init__(self, name: str, columns: Sequence[str], check: Callable[[dict[str, pa.Array]], Sequence]) -> None:
        self.name = name
        self._columns, self._check = tuple(columns), check

    def violations(self, evaluated_at: Column) -> Column:
        name, names, check = self.name, self._columns, self._check
        kind = pa.list_(pa.struct([("code", pa.string()), ("message", pa.string())]))

        def checked(arrays: list[pa.Array]) -> list:
            rows = len(arrays[0])
            try:
                found = list(check(dict(zip(names, arrays, strict=True))))
                if len(found) != rows:
                    raise ValueError(f"{len(found)} results for {rows} rows")
                return [[{"code": code, "message": message} for code, message in of_row] for of_row in found]
            except Exception as error:
                if rows == 1:
                    return [[{"code": RULE_ERROR, "message": f"{name} failed: {error!r}"}]]
                half = rows // 2
                return checked([a.slice(0, half) for a in arrays]) + checked([a.slice(half) for a in arrays])

        @F.arrow_udf(m.VIOLATIONS_TYPE)
        def run(*arrays: pa.Array) -> pa.Array:
            return pa.array(checked(list(arrays)) if len(arrays[0]) else [], kind)

        given = {"evaluated_at": evaluated_at}
        return run(*[given[c] if c in given else F.col(c) for c in names])


BUILT_IN = (MinimumAmountRule, RequiredFieldsRule, SupportedCurrencyRule)
