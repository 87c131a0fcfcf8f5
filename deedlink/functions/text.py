"""Free text, flags, enums and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from deedlink.functions.numbers import parse_integer
from deedlink.functions.presence import as_column, blank_to_null, null_to_blank, trimmed


def unquoted(c: Column | str) -> Column:
    """One quote dropped at each end, then trimmed."""
    text = null_to_blank(c)
    # hardly any cell still has a quote, so the expression is only run where there is one
    return trimmed(F.when(text.contains('"'), F.regexp_replace(text, '^"|"$', "")).otherwise(text))


def squeezed(c: Column | str) -> Column:
    """Runs of white space become one blank, none at the ends; missing text becomes blank."""
    return trimmed(F.regexp_replace(null_to_blank(c), r"(?U)\s+", " "))


def zip5(c: Column | str) -> Column:
    """First run of five digits, blank when there is none."""
    return F.regexp_extract(null_to_blank(c), "[0-9]{5}", 0)


def is_po_box(c: Column | str) -> Column:
    return squeezed(c).rlike(r"(?i)^P\.?\s*O\.?\s*BOX\b")


def looks_street_like(c: Column | str) -> Column:
    """Starts with a digit, has a letter, is no post-office box."""
    text = squeezed(c)
    return text.rlike("^[0-9]") & text.rlike("[A-Za-z]") & ~is_po_box(text)


def looks_numeric(c: Column | str) -> Column:
    return F.coalesce(trimmed(c).rlike("^[0-9]+$"), F.lit(False))


def mentions_city(c: Column | str, city: str) -> Column:
    """The city name stands in the text as a word of its own, in any case."""
    return null_to_blank(c).rlike(rf"(?i)\b{city}\b")


def integer_text(c: Column | str) -> Column:
    """Whole number as text; blank stays blank (so an explicit 0 differs from a blank)."""
    text = squeezed(c)
    return F.when(text == "", "").otherwise(parse_integer(text).cast("string"))


def boolean_text(c: Column | str) -> Column:
    """``true`` / ``false`` / blank; any other text is kept as it is."""
    text = squeezed(c)
    low = F.lower(text)
    return (
        F.when(low.isin("true", "yes", "y", "1"), "true")
        .when(low.isin("false", "no", "n", "0"), "false")
        .otherwise(text)
    )


def boolean_value(c: Column | str) -> Column:
    """Nullable boolean beside the text form."""
    text = boolean_text(c)
    return F.when(text == "true", True).when(text == "false", False)


def approval_text(c: Column | str) -> Column:
    """Third-party approval: two known words, one known prefix, other text kept."""
    text = squeezed(c)
    return (
        F.when(F.lower(text) == "none", "None")
        .when(F.lower(text) == "short sale", "Short Sale")
        .when(text.rlike(r"(?i)^other\b"), "Other - See Remarks")
        .otherwise(text)
    )


#: Canonical spellings of listing states.
STATUS_NAMES = {
    "SOLD": "Sold",
    "ACTIVE": "Active",
    "PENDING": "Pending",
    "PENDING INSPECTION": "Pending Inspection",
    "PENDING BU REQUESTED": "Pending BU Requested",
    "CONTINGENT": "Contingent",
}

#: Rank of a state when several snapshots of one listing meet (the largest wins).
STATUS_RANK = {
    "SOLD": 700,
    "PENDING INSPECTION": 630,
    "PENDING BU REQUESTED": 620,
    "PENDING FEASIBILITY": 615,
    "PENDING SHORT SALE": 610,
    "PENDING": 600,
    "CONTINGENT": 500,
    "ACTIVE": 100,
}

#: Penalty of a state when an open listing is tied to a sale (the least wins).
STATUS_PENALTY = {
    "PENDING": 0,
    "PENDING INSPECTION": 1,
    "PENDING BU REQUESTED": 2,
    "CONTINGENT": 3,
    "ACTIVE": 4,
}


def choose(key: Column, table: dict, default: Column) -> Column:
    """A small fixed table as a constant map, so that the key is computed once."""
    constant = F.create_map(*[F.lit(part) for entry in table.items() for part in entry])
    return F.coalesce(F.element_at(constant, key), default)


def title_words(c: Column | str) -> Column:
    """Lower case with the first letter of every word raised (a hyphen starts a word, unlike ``initcap``)."""
    pieces = F.regexp_extract_all(F.lower(as_column(c)), F.lit(r"(\w+|\W+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 2**31 - 1))), "")


def status_text(c: Column | str) -> Column:
    up = F.upper(trimmed(null_to_blank(c)))
    return choose(up, STATUS_NAMES, title_words(up))  # the default is computed only where the table has nothing


def status_rank(c: Column | str, table: dict = STATUS_RANK, default: int = 0) -> Column:
    return choose(F.upper(trimmed(null_to_blank(c))), table, F.lit(default))


def status_penalty(c: Column | str, table: dict = STATUS_PENALTY, default: int = 5) -> Column:
    return choose(F.upper(null_to_blank(c)), table, F.lit(default))


#: Style words and the property type each stands for, tried in this order.
STYLE_TYPES = [
    ("townhouse", "Townhouse"),
    ("condo", "Condo"),
    ("multi", "Multi-Family"),
    ("floating", "Floating Home"),
]
STYLE_DEFAULT = "Single Family"


def type_from_style(c: Column | str) -> Column:
    low = F.lower(null_to_blank(c))
    result = F.when(low == "", STYLE_DEFAULT)
    for word, name in STYLE_TYPES:
        result = result.when(low.contains(word), name)
    return result.otherwise(STYLE_DEFAULT)


#: Limits and names of the speed tag.
ULTRA_HOT_DAYS = 5
HOT_DAYS = 10
ULTRA_HOT_TAG = "ULTRA_HOT_<=5D"
HOT_TAG = "HOT_MARKET_<=10D"


def speed_tag(days_on_market: Column | str, days_to_pending: Column | str) -> Column:
    """Fast listings by days on market (positive only) or by days to pending (negative ones count too)."""
    dom, wait = as_column(days_on_market), as_column(days_to_pending)

    def within(limit: int) -> Column:
        return F.coalesce((dom > 0) & (dom <= limit), F.lit(False)) | F.coalesce(wait <= limit, F.lit(False))

    return F.when(within(ULTRA_HOT_DAYS), ULTRA_HOT_TAG).when(within(HOT_DAYS), HOT_TAG).otherwise("")


#: Rewrites that turn the name of an export file into a region, in order.
REGION_REWRITES = [
    (r"(?i)\.csv$", ""),
    (r"(?i)\bsold\s+and\b", ""),
    (r"(?i)\b(?:sale\s+)?stats?\b", ""),
    (r"(?i)\b(?:rich\s+snapshot|snapshot|full)\b", ""),
    (r"(?i)\b\d{1,2}_\d{1,2}\s+to\s+\d{1,2}_\d{1,2}\b", ""),
    (r"(?i)\bcental\b", "Central"),
    (r"[_-]+", " "),
    (r"\s+", " "),
]
#: Short region names and their full forms; the region of a file that names none.
REGION_ALIASES = {"qa": "QA Magnolia", "ne": "NE Seattle", "nw": "NW Seattle", "central": "Central Seattle"}
REGION_DEFAULT = "Seattle"


def region_from_name(c: Column | str) -> Column:
    stem = null_to_blank(c)
    for pattern, new in REGION_REWRITES:
        stem = F.regexp_replace(stem, pattern, new)
    stem = trimmed(stem)
    return choose(F.lower(stem), REGION_ALIASES, F.coalesce(blank_to_null(stem), F.lit(REGION_DEFAULT)))
