"""Presence rules: zero, blank and missing all count as absent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Characters removed at both ends of a text (blank, tab, line ends, no-break blanks, byte order mark).
TRIM_CHARS = " \t\n\r\x0b\x0c\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    return F.trim(as_column(c), F.lit(TRIM_CHARS))


def text_present(c: Column | str) -> Column:
    """True for a text that is not blank. Never null."""
    return F.coalesce(trimmed(c) != "", F.lit(False))


def number_present(c: Column | str) -> Column:
    """True for a finite number other than zero. Never null."""
    d = as_column(c).cast("double")
    finite = ~F.isnan(d) & (F.abs(d) != float("inf"))
    return F.coalesce(finite & (d != 0), F.lit(False))


def present(df: DataFrame, name: str) -> Column:
    """The presence test that fits the type of column ``name`` of ``df``."""
    return value_present(F.col(name), df.schema[name].dataType)


def value_present(c: Column, kind: T.DataType) -> Column:
    """The presence test that fits a value of type ``kind``."""
    if isinstance(kind, T.StringType):
        return text_present(c)
    if isinstance(kind, T.NumericType):
        return number_present(c)
    return c.isNotNull()


def blank_to_null(c: Column | str) -> Column:
    c = as_column(c)
    return F.when(c != "", c)


def null_to_blank(c: Column | str) -> Column:
    return F.coalesce(as_column(c), F.lit(""))


def first_text(*columns: Column | str) -> Column:
    """The first text that is not empty, else null (an empty text is falsy, a blank one inside quotes is not)."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def count_present(df: DataFrame, names: list[str]) -> Column:
    """How many of the columns hold a present value."""
    return reduce(lambda a, b: a + b, [present(df, n).cast("int") for n in names], F.lit(0))
