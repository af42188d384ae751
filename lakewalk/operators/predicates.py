"""Predicates of a search, as boolean columns over the inventory. Their conjunction is a filter that Spark pushes down.

A null field satisfies no predicate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewalk import schema
from lakewalk.functions import paths, patterns, units

#: Letters of types. Fixed values.
TYPE_BITS = {
    "b": schema.BLOCK_DEVICE,
    "c": schema.CHARACTER_DEVICE,
    "d": schema.DIRECTORY_MODE,
    "f": schema.REGULAR,
    "l": schema.LINK_MODE,
    "p": schema.FIFO,
    "s": schema.SOCKET,
}
MINUTE, DAY = 60, 86400


def of_type(letter: str) -> Column:
    return F.col("mode").bitwiseAND(schema.FORMAT_MASK) == TYPE_BITS[letter]


def name(pattern: str) -> Column:
    """A shell pattern for the last component."""
    return paths.basename("path").rlike(patterns.glob(pattern))


def path(pattern: str) -> Column:
    """A shell pattern for the whole path."""
    return F.col("path").rlike(patterns.glob(pattern))


def regex(pattern: str) -> Column:
    """A basic regular expression anywhere in the path."""
    return F.col("path").rlike(patterns.basic(pattern))


def _compared(column: Column, sign: str, value: int) -> Column:
    return column > value if sign == "+" else column < value if sign == "-" else column == value


def number(column: str, text: str) -> Column:
    """'+N' more, '-N' less, 'N' equal, for uid, gid and the like."""
    return _compared(F.col(column), *units.parse_number(text))


def size(text: str) -> Column:
    """'+10k' larger, '-1m' smaller, '4096' equal; entries of all types."""
    sign = text[0] if text[:1] in ("+", "-") else ""
    return _compared(F.col("size"), sign, units.parse_size(text[len(sign) :]))


def user(text: str) -> Column:
    """The name, or the id in decimal where it has none; needs ``schema.with_names``."""
    return F.col("user") == text


def group(text: str) -> Column:
    return F.col("group") == text


def age(field: str, text: str, now: tuple[int, int], unit: int) -> Column:
    """Whole units since ``field`` (atime, mtime or ctime): '+N' more, '-N' less, 'N' equal. Times ahead are 0 old."""
    return _compared(units.age_units(F.col(field), F.col(f"{field}_nsec"), *now, unit), *units.parse_number(text))


def newer(field: str, seconds: int, nanoseconds: int) -> Column:
    """Strictly later than a time, to the nanosecond."""
    return (F.col(field) > seconds) | ((F.col(field) == seconds) & (F.col(f"{field}_nsec") > nanoseconds))


def max_depth(root: str, levels: int) -> Column:
    """At most so many levels below the root, which is at level 0."""
    root = root.rstrip("/")
    return paths.is_below("path", root or "/", inclusive=True) & (paths.depth("path") - root.count("/") <= levels)


def hook(test: Callable[[str], bool]) -> Column:
    """A caller's own test of the path, in batches on the executors. It takes the place of running a command per entry."""
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda p: bool(test(p)) if p is not None else False)

    return run(F.col("path"))


def all_of(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def find(rows: DataFrame, *predicates: Column) -> DataFrame:
    """The rows that satisfy all predicates; every row without any."""
    return rows.filter(all_of(predicates))
