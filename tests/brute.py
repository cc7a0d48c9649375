"""Plain-Python restatement of what the history features mean, used as an independent check."""

from decimal import ROUND_HALF_UP, Decimal


def contexts(rows, retention=3_600_000, cap=100):
    """rows: dicts with id, customer, ts, amount, country, status.  Returns {id: context}."""
    by_customer = {}
    for row in rows:
        by_customer.setdefault(row["customer"], []).append(row)
    out = {}
    for own in by_customer.values():
        own = sorted(own, key=lambda r: (r["ts"], r["id"]))
        for i, row in enumerate(own):
            first_of_instant = i == 0 or own[i - 1]["ts"] < row["ts"]
            limit = retention + (1 if first_of_instant else 0)
            past = [p for p in own[max(0, i - cap) : i] if row["ts"] - p["ts"] <= limit]
            out[row["id"]] = context(row, past)
    return out


def context(row, past):
    zero = Decimal(0)

    def spent(p):
        return zero if p["status"] == "DECLINED" or p["amount"] is None else p["amount"]

    def younger(width):
        return [p for p in past if row["ts"] - p["ts"] < width]

    approved = [p for p in past if p["status"] != "DECLINED"]
    average = None
    if approved:
        total = sum((spent(p) for p in approved), zero)
        average = (total / len(approved)).quantize(Decimal("0.0001"), ROUND_HALF_UP)
    return {
        "transactions_last_minute": 1 + len(younger(60_000)),
        "amount_last_ten_minutes": spent(row) + sum((spent(p) for p in younger(600_000)), zero),
        "previous_country": past[-1]["country"] if past else None,
        "recent_countries": [p["country"] for p in younger(600_000) if p["country"] is not None],
        "average_recent_amount": average,
        "recent_transaction_count": len(approved),
        "time_since_previous_ms": row["ts"] - past[-1]["ts"] if past else None,
        "known_countries": {p["country"] for p in past if p["country"] is not None},
        "declined_last_five_minutes": sum(1 for p in younger(300_000) if p["status"] == "DECLINED"),
    }
