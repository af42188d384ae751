"""Sizes, counts and times in words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of units. Fixed values.
BYTES = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
COUNTS = ["", "k", "M", "G", "T", "P", "E"]
BANDWIDTHS = [f"{u}/s" for u in BYTES]
LETTERS = "kmgtpe"


def parse_size(text: str) -> int:
    """'1.5m', '10KB', '4096' in bytes: a number, then k, m, g, t, p or e (powers of 1024), then b, in either case.

    ValueError for anything else, for negative numbers and from 2**64 on. Fractions of a byte are cut off.
    """
    found = re.fullmatch(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?:([kmgtpe])b?)?", text, re.IGNORECASE)
    if not found:
        raise ValueError(f"not a size: {text!r}")
    value = float(found[1]) * 1024 ** (LETTERS.index(found[2].lower()) + 1 if found[2] else 0)
    if value < 0 or value >= 2**64:
        raise ValueError(f"out of range: {text!r}")
    return int(value)


def parse_number(text: str) -> tuple[str, int]:
    """'+7', '-7' or '7' as (sign, 7), the sign '' for none. What doesn't start with a number is 0."""
    sign = text[0] if text[:1] in ("+", "-") else ""
    digits = re.match(r"\s*[+-]?\d+", text[len(sign) :])
    return sign, int(digits[0]) if digits else 0


def _scaled(value: Column, base: int, names: list[str], round_up: bool) -> tuple[Column, Column]:
    """Divided by the base as long as more than the base is left; with round_up once more from 1000 on."""
    number, powers = value.cast("double"), F.array(*[F.lit(float(base**k)) for k in range(len(names))])
    power = F.lit(0)
    for k in range(1, len(names)):
        power = power + F.when(number / float(base**k) > 1.0, 1).otherwise(0)
    if round_up:
        power = power + F.when((power < len(names) - 1) & (number / F.get(powers, power) > 1000.0), 1).otherwise(0)
    return number / F.get(powers, power), F.when(value.isNotNull(), F.get(F.array(*map(F.lit, names)), power))


def bytes_and_unit(value: Column) -> tuple[Column, Column]:
    """1024 is 1.0 KiB and 1005 is 0.98 KiB; 1000 is 1000 B."""
    return _scaled(value, 1024, BYTES, True)


def bandwidth_and_unit(value: Column) -> tuple[Column, Column]:
    return _scaled(value, 1024, BANDWIDTHS, True)


def count_and_unit(value: Column) -> tuple[Column, Column]:
    """1000 is 1000; 1001 is 1.001 k."""
    return _scaled(value, 1000, COUNTS, False)


def to_unit(value: Column, letter: str) -> Column:
    """Bytes in k, m, g, t, p or e, as a double."""
    return value.cast("double") / float(1024 ** (LETTERS.index(letter.lower()) + 1))


def age_units(seconds: Column, nanoseconds: Column, now: int, now_nsec: int, unit_seconds: int) -> Column:
    """Whole units since a time; 0 for times in the future. Exact to the nanosecond; a null nanosecond part counts as 0.

    The seconds are subtracted first, so that no product leaves the range of bigint.
    """
    borrow = F.when(F.coalesce(nanoseconds, F.lit(0)) > now_nsec, 1).otherwise(0)
    whole = F.lit(now) - seconds - borrow
    return F.when(seconds.isNotNull(), F.floor(F.greatest(whole, F.lit(0)) / unit_seconds))


def age_days(seconds: Column, now: int) -> Column:
    """Whole days since a time in seconds; 0 for times in the future."""
    return F.when(seconds.isNotNull(), F.floor(F.greatest(F.lit(now) - seconds, F.lit(0)) / 86400))


def interval_label(low: Column, high: Column) -> Column:
    """'[low,high]', or '[low,INF]' for a null high."""
    return F.concat(
        F.lit("["), low.cast("string"), F.lit(","), F.coalesce(high.cast("string"), F.lit("INF")), F.lit("]")
    )


def display_time(seconds: Column) -> Column:
    """'Nov  7 2025 10:39' in the session's time zone: the day is padded to two places by a space."""
    ts = F.timestamp_seconds(seconds)
    return F.concat(
        F.date_format(ts, "MMM"),
        F.lit(" "),
        F.lpad(F.date_format(ts, "d"), 2, " "),
        F.lit(" "),
        F.date_format(ts, "yyyy HH:mm"),
    )
