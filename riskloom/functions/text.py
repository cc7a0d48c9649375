"""String predicates and printers built from JVM-side functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space (Unicode separators except the no-break ones, plus the
# control characters tab to carriage return and 1C to 1F).
_BLANK = r"^[\t-\r\x1C-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]*$"


def is_blank(text: Column) -> Column:
    """True for NULL, empty and white-space-only text."""
    return text.isNull() | text.rlike(_BLANK)


def utf8_text(raw: Column) -> Column:
    """Bytes as text; invalid sequences become the replacement character, so this never fails."""
    return F.make_valid_utf8(raw.cast("string"))


def plain_number(amount: Column) -> Column:
    """A decimal without trailing fraction zeros, e.g. ``-5`` or ``12.5``."""
    return F.regexp_replace(amount.cast("string"), r"\.?0+$", "")
