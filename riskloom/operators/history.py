"""Per-customer history features as window functions.

For a transaction at time ``t`` the history is the customer's earlier rows in ``(ts_ms, transaction_id)`` order, limited
to the newest ``max_entries`` and to an age of at most ``retention_ms``.  The first row of each (customer, ts_ms) still
sees entries one millisecond older than that, because entries expire only after the rows of that instant are scored.
Shorter windows are ``(t - w, t]``: an entry aged exactly ``w`` is outside.

Everything is computed in one shuffle by customer:

* a customer none of whose rows has ``max_entries`` others within the retention takes the *range* path: time frames
  over a numeric order key.  The entry limit cannot bind there and no frame holds more than ``max_entries`` rows;
* a crowded customer takes the *rows* path: the newest ``max_entries`` rows are gathered per row and filtered by age.

So the work per row is bounded by ``max_entries`` whatever the rate of a customer is.  A customer with very many rows
is cut into slices first (see ``slices.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import model as m
from riskloom.functions.money import half_up_average


def _approved_amount(status: Column, amount: Column) -> Column:
    """What an attempt spent: NULL when declined, zero when the amount is missing."""
    return F.when(~status.eqNullSafe(m.DECLINED), F.coalesce(amount, F.lit(0).cast(m.MONEY)))


def _zero_sum(total: Column) -> Column:
    return F.coalesce(total.cast("decimal(31,8)"), F.lit(0).cast("decimal(31,8)"))


def with_history(
    transactions: DataFrame,
    *,
    retention_ms: int = m.HISTORY_RETENTION_MS,
    max_entries: int = m.HISTORY_MAX_ENTRIES,
    keys: Sequence[str] = ("customer_id",),
) -> DataFrame:
    """Adds the nine context columns.  ``transaction_id`` must be unique within ``keys``."""
    if not 1 <= max_entries <= 999:
        raise ValueError(f"max_entries must be within 1..999: {max_entries}")
    keys = list(keys)
    ts = F.col("ts_ms")
    in_order = Window.partitionBy(*keys).orderBy("ts_ms", "transaction_id")

    # One sort by (keys, ts_ms, transaction_id) serves these windows and those of the rows path.
    rows = transactions.withColumns(
        {
            "_spent": _approved_amount(F.col("payment_status"), F.col("amount")),
            "_last_ts": F.lag("ts_ms").over(in_order),
            "_last_country": F.lag("country").over(in_order),
            "_far_ts": F.lag("ts_ms", max_entries).over(in_order),
            "_position": F.row_number().over(in_order),
            "_tie": F.row_number().over(Window.partitionBy(*keys, "ts_ms").orderBy("transaction_id")) - 1,
        }
    )
    keeps_one_more_ms = F.col("_tie") == 0
    if retention_ms < m.TEN_MINUTES_MS:
        is_crowded = F.lit(True)  # a fixed window could outlive the retention: always look at single entries
    else:
        crowded_row = F.coalesce(ts - F.col("_far_ts") <= retention_ms + 1, F.lit(False))
        is_crowded = F.max(crowded_row).over(Window.partitionBy(*keys))
    rows = rows.withColumn("_crowded", is_crowded)
    rows = _rows_path(rows, in_order, retention_ms, max_entries, keeps_one_more_ms)
    rows = _range_path(rows, retention_ms, max_entries, keys)

    known_before = F.coalesce(ts - F.col("_last_ts") <= retention_ms + 1, F.lit(False))
    on_edge = keeps_one_more_ms & (F.size("_edge_known") > 0)
    frames = {
        "minute": F.col("_n_minute"),
        "spent": _zero_sum(F.col("_spent_ten")),
        "previous_country": F.when(known_before, F.col("_last_country")),
        "recent": F.col("_recent"),
        "approved_total": (
            _zero_sum(F.col("_kept_spent")) + _zero_sum(F.when(keeps_one_more_ms, F.col("_edge_spent")))
        ).cast("decimal(31,8)"),
        "approved_count": F.col("_kept_n") + F.when(keeps_one_more_ms, F.col("_edge_n")).otherwise(F.lit(0)),
        "since": F.when(known_before, ts - F.col("_last_ts")),
        "known": F.when(on_edge, F.array_union("_kept_known", "_edge_known")).otherwise(F.col("_kept_known")),
        "declined": F.col("_declined_five"),
    }
    rows = rows.select(
        *transactions.columns,
        *[
            F.when(F.col("_crowded"), F.col(f"_rows_path.{name}")).otherwise(value).alias(f"_{name}")
            for name, value in frames.items()
        ],
        _zero_sum(F.col("_spent")).alias("_current"),
    )
    context = {
        "transactions_last_minute": F.col("_minute") + 1,
        "amount_last_ten_minutes": (F.col("_spent") + F.col("_current")).cast(m.MONEY_SUM),
        "previous_country": F.col("_previous_country"),
        "recent_countries": F.col("_recent"),
        "average_recent_amount": half_up_average(F.col("_approved_total"), F.col("_approved_count")),
        "recent_transaction_count": F.col("_approved_count"),
        "time_since_previous_ms": F.col("_since"),
        "known_countries": F.col("_known"),
        "declined_last_five_minutes": F.col("_declined"),
    }
    return rows.select(*transactions.columns, *[value.alias(name) for name, value in context.items()])


def _rows_path(rows: DataFrame, in_order, retention_ms: int, max_entries: int, keeps_one_more_ms: Column) -> DataFrame:
    """Adds ``_rows_path``: the context of a crowded customer's row, from its newest ``max_entries`` predecessors.

    Each predecessor carries running totals of what came before it, so the sum over the last ``k`` entries is a
    difference of two totals and only the entry times are searched.  NULL for rows that are not crowded.
    """
    ts, crowded = F.col("ts_ms"), F.col("_crowded")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    declined = F.when(crowded & (F.col("payment_status") == m.DECLINED), F.lit(1))
    spent = F.when(crowded, F.col("_spent"))
    rows = rows.withColumns(
        {
            "_spent_before": F.coalesce(F.sum(spent).over(before), F.lit(0)).cast("decimal(37,8)"),
            "_approved_before": F.count(spent).over(before),
            "_declined_before": F.count(declined).over(before),
        }
    )
    totals = ("_spent_before", "_approved_before", "_declined_before")
    entry = F.struct(ts.alias("ts"), "country", *totals)
    newest = F.collect_list(F.when(crowded, entry)).over(in_order.rowsBetween(-max_entries, -1))
    rows = rows.withColumn("_newest", newest)
    oldest_kept = ts - retention_ms - F.when(keeps_one_more_ms, F.lit(1)).otherwise(F.lit(0))

    def how_many(keep) -> Column:
        return F.when(crowded, F.size(F.filter(F.col("_newest.ts"), keep)))

    rows = rows.withColumns(
        {
            "_k_kept": how_many(lambda t: t >= oldest_kept),
            "_k_minute": how_many(lambda t: t > ts - m.MINUTE_MS),
            "_k_five": how_many(lambda t: t > ts - m.FIVE_MINUTES_MS),
            "_k_ten": how_many(lambda t: t > ts - m.TEN_MINUTES_MS),
        }
    )

    def within(name: str) -> Column:
        return F.least(F.col(name), F.col("_k_kept"))

    def since(k: Column, total: str) -> Column:
        first = F.element_at("_newest", -k)
        return F.when(k > 0, F.col(total) - first[total]).otherwise(F.lit(0))

    def countries(k: Column) -> Column:
        all_of_them = F.col("_newest.country")
        return F.array_compact(F.slice(all_of_them, F.size("_newest") - k + 1, k))

    last = F.when(F.col("_k_kept") > 0, F.element_at("_newest", -1))
    kept, ten = F.col("_k_kept"), within("_k_ten")
    features = {
        "minute": within("_k_minute").cast("bigint"),
        "spent": since(ten, "_spent_before").cast("decimal(31,8)"),
        "previous_country": last["country"],
        "recent": countries(ten),
        "approved_total": since(kept, "_spent_before").cast("decimal(31,8)"),
        "approved_count": since(kept, "_approved_before").cast("bigint"),
        "since": ts - last["ts"],
        "known": F.array_distinct(countries(kept)),
        "declined": since(within("_k_five"), "_declined_before").cast("bigint"),
    }
    path = F.when(crowded, F.struct(*[value.alias(name) for name, value in features.items()]))
    return rows.withColumn("_rows_path", path).drop(
        "_newest", "_k_kept", "_k_minute", "_k_five", "_k_ten", *totals
    )


def _range_path(rows: DataFrame, retention_ms: int, max_entries: int, keys: list[str]) -> DataFrame:
    """Time frames for customers that are not crowded.

    A frame over ``ts_ms`` alone would include rows of the same instant with a larger id.  The order key therefore leaves
    ``2 * half`` steps per millisecond and adds the rank within the instant, which is below ``half``; a frame start of
    ``(w - 1) * 2 * half + half`` steps back then falls between the last row aged ``w`` and the first younger one.
    """
    half = 1 << max_entries.bit_length()
    step = 2 * half
    # Rows of crowded customers do not use these frames: each sits in a partition of its own, so frames stay short.
    lane = F.when(F.col("_crowded"), F.col("_position")).otherwise(F.lit(0))
    rows = rows.withColumns({"_lane": lane, "_key": F.col("ts_ms") * step + F.col("_tie")})
    timed = Window.partitionBy(*keys, "_lane").orderBy("_key")

    def back(width: int) -> int:
        return (width - 1) * step + half

    minute = timed.rangeBetween(-back(m.MINUTE_MS), -1)
    five = timed.rangeBetween(-back(m.FIVE_MINUTES_MS), -1)
    ten = timed.rangeBetween(-back(m.TEN_MINUTES_MS), -1)
    kept = timed.rangeBetween(-back(retention_ms + 1), -1)
    edge = timed.rangeBetween(-back(retention_ms + 2), -back(retention_ms + 1) - 1)
    declined = F.when(F.col("payment_status") == m.DECLINED, F.lit(1))
    return rows.withColumns(
        {
            "_n_minute": F.count(F.lit(1)).over(minute),
            "_declined_five": F.count(declined).over(five),
            "_spent_ten": F.sum("_spent").over(ten),
            "_recent": F.collect_list("country").over(ten),
            "_kept_spent": F.sum("_spent").over(kept),
            "_kept_n": F.count("_spent").over(kept),
            "_kept_known": F.collect_set("country").over(kept),
            "_edge_spent": F.sum("_spent").over(edge),
            "_edge_n": F.count("_spent").over(edge),
            "_edge_known": F.collect_set("country").over(edge),
        }
    )
