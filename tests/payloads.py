"""Builds JSON payloads for tests; times are seconds after 2027-03-02T08:00:00Z."""

import datetime as dt
import json

T0 = dt.datetime(2027, 3, 2, 8, 0, tzinfo=dt.timezone.utc)


def at(seconds):
    time = T0 + dt.timedelta(seconds=seconds)
    return time.isoformat(timespec="milliseconds" if time.microsecond else "seconds").replace("+00:00", "Z")


def payload(id, customer="c1", seconds=0, amount="25", country="PT", currency="EUR", status=None, **changes):
    fields = {
        "transactionId": id,
        "customerId": customer,
        "merchantId": "m",
        "amount": "@amount",
        "currency": currency,
        "country": country,
        "timestamp": at(seconds),
    }
    if status is not None:
        fields["paymentStatus"] = status
    fields |= changes
    text = json.dumps({k: v for k, v in fields.items() if v != "@drop"})
    return text.replace('"@amount"', str(amount))
