"""Small scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_bytes(n: int) -> str:
    """Sizes as people read them: base 1024, one decimal."""
    if abs(n) < 1024:
        return f"{n} B"
    x = float(n)
    for unit in ("KiB", "MiB", "GiB", "TiB", "PiB", "EiB"):
        x /= 1024
        if abs(x) < 1024:
            return f"{x:.1f} {unit}"
    return f"{x:.1f} EiB"


def human_bytes_column(n: Column) -> Column:
    """As :func:`human_bytes`, up to PiB.  Halves of a tenth go to the even tenth, as C's
    printf and Python round them; Java's formatter alone takes them, and decimals
    that only look like halves, up."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        x = n / float(1024**k)
        whole = F.floor(x)
        # what is left has at most 10 k binary places, so ten times of it is exact
        tenths = whole + F.rint((x - whole) * 10) / 10
        out = F.when(F.abs(n) >= 1024**k, F.concat(F.format_string("%.1f", tenths), F.lit(f" {unit}"))).otherwise(out)
    return out


def cents(amount: Column) -> Column:
    """Whole cents of a decimal amount: rounds, a plain cast would cut."""
    return F.round(amount * 100).cast("long")


def day_of(ts: Column) -> Column:
    """Start of the day, of the column's own kind (``date_trunc`` alone gives a zoned timestamp)."""
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def month_name(ts: Column) -> Column:
    return F.date_format(ts, "yyyy_MM")


def json_long(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path).cast("long")


def like_literal(text: Column, literal: str, pattern: str = "") -> Column:
    """LIKE for a literal, whose ``_`` and ``%`` stand for themselves, and a pattern behind it."""
    plain = literal.replace("\\", "\\\\").replace("_", "\\_").replace("%", "\\%")
    return text.like(plain + pattern)
