"""Rounding, guarded division, elapsed time and text helpers."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
KEY_MODULUS = 1 << 32


def round_half_even(value: Column, digits: int) -> Column:
    """Scale, round to the nearest even integer, scale back (Spark's ``round`` is half-up)."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``; null when the denominator is zero."""
    return F.when(whole != 0, part / whole)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return round_half_even(ratio(part, whole) * 100, digits)


def elapsed_hours(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6 / 3600


def whole_days(start: Column, end: Column) -> Column:
    """Full 24-hour periods between two instants, not calendar days."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.floor(micros / F.lit(MICROS_PER_DAY)).cast("bigint")


def blank_trim(value: Column, default: str) -> Column:
    """Null becomes ``default``; leading and trailing white space goes."""
    return F.regexp_replace(F.coalesce(value, F.lit(default)), r"^\s+|\s+$", "")


def is_any(value: Column, names: tuple[str, ...]) -> Column:
    """0/1 membership flag; a null value belongs to nothing."""
    return F.coalesce(value.isin(*names), F.lit(False)).cast("int")


def text_bar(percentage: Column, per_mark: int = 5) -> Column:
    return F.repeat(F.lit("#"), (percentage / per_mark).cast("int"))


def percent_text(value: Column, suffix: str = "%") -> Column:
    return F.concat(F.format_string("%.1f", value), F.lit(suffix))


def column_slug(prefix: str, name: str) -> str:
    return prefix + name.lower().replace(" ", "_")


def order_key(identifier: Column, seed: int = 0) -> Column:
    """Reproducible shuffle key in [0, 2^32) for ids of any type and number.

    The first eight hexadecimal digits of the MD5 of the id's text and the seed, which other
    engines can compute too.
    """
    digest = F.md5(F.concat_ws(":", identifier.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def passed_limits(limits: Column, value: Column, most: int, equal: bool = True) -> Column:
    """How many of the ascending ``limits``, ``most`` at most, lie below the value (or at it, if ``equal``).

    Found by halving: one comparison for each bit of ``most``. A null value has passed none.
    """
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(max(most, 1).bit_length()))])

    def advance(at: Column, step: Column) -> Column:
        limit = F.get(limits, at + step - 1)
        return F.when(limit <= value if equal else limit < value, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), advance)


def doubles(values: Collection[float]) -> Column:
    """A constant array; as text, since thousands of single literals take seconds to make."""
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})" if values else "cast(array() as array<double>)")
