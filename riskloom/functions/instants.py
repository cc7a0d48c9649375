"""ISO-8601 instants, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted shapes of a JSON instant.
_ISO_INSTANT = (
    r"^[+-]?\d{4,6}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{0,9})?(Z|[+-]\d{2}(:?\d{2})?)$"
)
# The second form is how a large JSON number comes out of its reader.
_EPOCH_SECONDS = r"^-?(\d{1,13}(\.\d{1,9})?|\d(\.\d{1,17})?E1?\d)$"


def parse_instant(text: Column) -> Column:
    """Text to TIMESTAMP: full ISO instants with an offset, or epoch seconds; anything else is NULL."""
    upper = F.upper(text)
    offset_colon = F.regexp_replace(upper, r"([+-]\d{2})(\d{2})$", "$1:$2")
    offset_full = F.regexp_replace(offset_colon, r"(T.*[+-]\d{2})$", "$1:00")
    iso = F.when(upper.rlike(_ISO_INSTANT), offset_full.try_cast("timestamp"))
    micros = F.when(
        text.rlike(_EPOCH_SECONDS),
        F.floor(text.try_cast("decimal(23,9)") * F.lit(1_000_000).cast("decimal(7,0)")).try_cast("bigint"),
    )
    return F.coalesce(iso, F.timestamp_micros(micros))


def format_instant(ts: Column) -> Column:
    """TIMESTAMP to ``2027-03-02T08:20:07Z``; the fraction has 0, 3 or 6 digits, whichever is needed."""
    micros = F.unix_micros(ts)
    seconds = F.floor(micros / F.lit(1_000_000).cast("decimal(7,0)")).cast("bigint")
    fraction = F.pmod(micros, F.lit(1_000_000))
    days = F.floor(seconds / F.lit(86_400).cast("decimal(5,0)")).cast("int")
    of_day = F.pmod(seconds, F.lit(86_400))
    clock = F.concat_ws(
        ":",
        F.lpad((of_day / 3600).cast("int").cast("string"), 2, "0"),
        F.lpad(((of_day % 3600) / 60).cast("int").cast("string"), 2, "0"),
        F.lpad((of_day % 60).cast("string"), 2, "0"),
    )
    tail = (
        F.when(fraction == 0, F.lit(""))
        .when(fraction % 1000 == 0, F.concat(F.lit("."), F.lpad((fraction / 1000).cast("int").cast("string"), 3, "0")))
        .otherwise(F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0")))
    )
    day = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
    return F.when(ts.isNotNull(), F.concat(day, F.lit("T"), clock, tail, F.lit("Z")))
