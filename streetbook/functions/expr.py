"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x00"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``; keeps the expression tree linear."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_all(value: Column) -> Column:
    """Trim blanks, tabs, line breaks and NUL, not only spaces."""
    return F.btrim(value, F.lit(BLANKS))


def squeeze(value: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return F.btrim(F.regexp_replace(value, r"[ \n\r\t\f]+", " "))


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def words(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def replace_all(value: Column, steps: Sequence[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) steps in order."""
    for pattern, replacement in steps:
        value = F.regexp_replace(value, pattern, replacement)
    return value


def quote(value: Column) -> Column:
    """Quote a value for use inside a regular expression."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
