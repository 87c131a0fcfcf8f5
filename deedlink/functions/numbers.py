"""Numbers from text and text from numbers."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, functions as F

from deedlink.functions.presence import as_column


def number_or_null(c: Column | str) -> Column:
    """Digits, dot and minus of a text read as a double; null when they form no number (a blank text does not)."""
    text = as_column(c).cast("string")
    # most texts are plain numbers and need no rewriting
    plain = F.translate(text, "0123456789.-", "") == ""
    return F.when(plain, text).otherwise(F.regexp_replace(text, "[^0-9.-]", "")).try_cast("double")


def parse_number(c: Column | str) -> Column:
    """As ``number_or_null`` with 0 for blank, missing and everything unreadable."""
    return F.coalesce(number_or_null(c), F.lit(0.0))


def parse_number_strict(c: Column | str) -> Column:
    """As ``number_or_null`` with NaN for unreadable text and 0 for text without any digit, dot or minus."""
    nothing = ~as_column(c).cast("string").rlike("[0-9.-]")
    return F.when(F.coalesce(nothing, F.lit(True)), F.lit(0.0)).otherwise(
        F.coalesce(number_or_null(c), F.lit(float("nan")))
    )


def round_half_up(c: Column | str) -> Column:
    """Nearest integer, halves towards plus infinity, as a long."""
    return F.floor(as_column(c) + F.lit(0.5)).cast("long")


def parse_integer(c: Column | str) -> Column:
    return round_half_up(parse_number(c))


def fixed_text(c: Column | str, digits: int) -> Column:
    """Fixed-point text judged on the exact binary value, ties away from zero.

    ``format_string`` rounds the shortest decimal form (1.005 would become 1.01). ``format_number`` looks at the
    binary value but sends exact ties to the even digit; a tie is an odd multiple of 1 / 2**(digits + 1), and a
    nudge far below the last digit turns it upwards. Sizes below one unit of the last digit, which the formatter
    always cuts off, are compared with the half directly.
    """
    x = as_column(c).cast("double")
    size = F.abs(x)
    tie = (size * F.lit(float(2 ** (digits + 1)))) % 2 == 1
    pattern = F.lit("0." + "0" * digits if digits else "0")
    unit, half = 10.0**-digits, 0.5 * 10.0**-digits
    if Decimal(half) < Decimal(5).scaleb(-digits - 1):
        half = math.nextafter(half, 1.0)  # the least double that is not below the exact half
    small = F.when(size >= half, f"{unit:.{digits}f}").otherwise(f"{0:.{digits}f}")
    text = F.call_function("format_number", size + F.when(tie, F.lit(1e-9)).otherwise(F.lit(0.0)), pattern)
    text = F.when(size < unit, small).otherwise(text)
    return F.concat(F.when(x < 0, "-").otherwise(""), text)


def number_text(c: Column | str) -> Column:
    """A number as plain text: no trailing zero after the point, no exponent for ordinary sizes."""
    d = as_column(c).cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    return F.when(whole, F.floor(d).cast("long").cast("string")).otherwise(d.cast("string"))
