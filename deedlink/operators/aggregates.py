"""One row per key: mode, arg-max, ordered fold, first and last, first present, unique value.

All of them combine on the map side, so a key that holds a large part of the rows is reduced before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from deedlink.functions.presence import present
from deedlink.session import cut_lineage


def learned_label(
    df: DataFrame, keys: list[str], label: str, order: Column | str, out: str | None = None, weight: str | None = None
) -> DataFrame:
    """Most frequent label per key; among equal counts the label seen first.

    A row counts ``weight`` times when it already stands for several.
    """
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = df.groupBy(*keys, label).agg(times.alias("__n"), F.min(order).alias("__first"))
    # smallest (-count, first position) is the largest count, earliest seen
    return counted.groupBy(*keys).agg(
        F.min_by(F.col(label), F.struct(-F.col("__n"), F.col("__first"))).alias(out or label)
    )


def best_record(df: DataFrame, keys: list[str], measure: Column | str, order: Column | str) -> DataFrame:
    """The whole record with the largest measure per key; the first one among equals."""
    m = F.col(measure) if isinstance(measure, str) else measure
    others = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(-m, F.col(order) if isinstance(order, str) else order)).alias("__r"))
    return picked.select(*keys, *[F.col("__r")[c].alias(c) for c in others])


def first_value(df: DataFrame, keys: list[str], columns: list[str], order: Column | str) -> DataFrame:
    """The record that comes first per key."""
    return _edge(df, keys, columns, order, F.min_by)


def last_value(df: DataFrame, keys: list[str], columns: list[str], order: Column | str) -> DataFrame:
    """The record that comes last per key."""
    return _edge(df, keys, columns, order, F.max_by)


def _edge(df, keys, columns, order, pick) -> DataFrame:
    rest = [c for c in columns if c not in keys]
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("__r"))
    return picked.select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def first_present(df: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """Per key and column, the first value that is present (rows without one are skipped by the null order key)."""
    return df.groupBy(*keys).agg(
        *[F.min_by(F.col(c), F.when(present(df, c), F.col(order))).alias(c) for c in columns]
    )


def unique_value(df: DataFrame, keys: list[str], value: str, out: str | None = None) -> DataFrame:
    """Keys with exactly one distinct value, and that value. Smallest and largest tell it without a distinct count."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
        .filter(F.col("__lo") == F.col("__hi"))
        .select(*keys, F.col("__lo").alias(out or value))
    )


def ordered_fold(
    df: DataFrame, keys: list[str], size: str, flag: Column | str, order: str, fragment: Column | str
) -> DataFrame:
    """Result of folding the rows of each key in order: a row replaces the kept one if it is larger, or if it has the
    flag and the kept one has not.

    The fold needs no list per key. After any flagged row the kept row is a flagged one, because an unflagged kept row
    loses to the next flagged row whatever its size. Let the last flagged row be L. A flagged row that is at least as
    large as everything after it up to L can never be replaced before L's end, and the first such row is the one
    standing after L. What follows L has no flag, so there the first largest row wins if it is larger than that row.
    Without any flagged row, the first largest row of the whole key wins.

    ``fragment`` must grow with ``order`` and stand for a bounded number of rows. Each fragment is reduced to one row
    first; what later fragments hold is then a window over these rows, so no task sees a whole key. Inside a fragment
    the rows that nothing later exceeds have falling sizes, so only the first of them can pass the later fragments.

    ``order`` is unique inside a key. Only key, size, flag, order and fragment go through the fold; the rows that win
    are fetched afterwards.
    """
    values = [size, order]
    base = df.select(
        *keys,
        *values,
        (F.col(fragment) if isinstance(fragment, str) else fragment).alias("__frag"),
        F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False)).alias("__flag"),
    )
    part = [*keys, "__frag"]
    upcoming = Window.partitionBy(*part).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy(*part).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns(
        {
            # a flagged row stands at or after this one, inside the fragment
            "__open": F.max("__flag").over(through),
            "__all_after": F.max(size).over(upcoming),
        }
    ).withColumn("__open_after", F.max(F.when(F.col("__open"), F.col(size))).over(upcoming))
    record, here = F.struct(*values), F.col(size)

    def unbeaten(after: str) -> Column:
        return F.when(F.col("__flag") & (F.col(after).isNull() | (here >= F.col(after))), F.col(order))

    fragments = local.groupBy(*part).agg(
        F.max("__flag").alias("__has_flag"),
        F.max(size).alias("__max_all"),
        F.max(F.when(F.col("__open"), here)).alias("__max_open"),
        F.min_by(record, unbeaten("__all_after")).alias("__if_flag_later"),
        F.min_by(record, unbeaten("__open_after")).alias("__if_last_flag"),
        F.min_by(record, F.when(~F.col("__open"), F.struct(-here, F.col(order)))).alias("__rest"),
    )
    later = Window.partitionBy(*keys).orderBy(F.col("__frag").desc()).rowsBetween(Window.unboundedPreceding, -1)
    flag_later = F.col("__flag_later")
    fragments = (
        fragments.withColumn("__flag_later", F.coalesce(F.max("__has_flag").over(later), F.lit(False)))
        .withColumn("__counted", F.when(flag_later, F.col("__max_all")).otherwise(F.col("__max_open")))
        .withColumn("__carry", F.max("__counted").over(later))
        .withColumn(
            "__stays",
            F.when(~flag_later, F.col("__if_last_flag")).when(
                F.col("__if_flag_later")[size] >= F.col("__carry"), F.col("__if_flag_later")
            ),
        )
        .withColumn("__trails", F.when(~flag_later, F.col("__rest")))
    )
    trails = F.col("__trails")
    folded = fragments.groupBy(*keys).agg(
        F.min_by("__stays", F.when(F.col("__stays").isNotNull(), F.col("__frag"))).alias("__kept"),
        F.min_by("__trails", F.when(trails.isNotNull(), F.struct(-trails[size], trails[order]))).alias("__tail"),
    )
    take_tail = F.col("__kept").isNull() | F.coalesce(F.col("__tail")[size] > F.col("__kept")[size], F.lit(False))
    winner = F.when(take_tail, F.col("__tail")).otherwise(F.col("__kept"))[order]
    winners = folded.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], winner.alias("__order"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return df.join(winners, reduce(lambda a, b: a & b, same, F.col(order) == F.col("__order")), "left_semi")


def group_counts(df: DataFrame, column: str, missing: str = "UNKNOWN", out: str = "rows") -> DataFrame:
    """Rows per value of one column, blank and missing under one name."""
    name = F.when(F.coalesce(F.col(column), F.lit("")) == "", missing).otherwise(F.col(column))
    return df.groupBy(name.alias(column)).agg(F.count(F.lit(1)).alias(out))


#: Different values of one key, or of one part of a key's range, that one task puts in order.
ORDERED_VALUES = 200_000
#: Parts that a range with more values is cut into.
RANGE_PARTS = 64


def exact_percentiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], ordered: int = ORDERED_VALUES, weight: str | None = None) -> DataFrame:
    """Exact interpolated percentiles per key, together with the number of values ``n``.

    With ``weight``, a whole number, a row counts as so many equal values. Equal values are counted first. Where a key has more than ``ordered`` different values, its range is cut at approximate
    quantiles of the values themselves (a mergeable summary), only the parts that hold a wanted rank go on, and these are cut
    again until they are small enough to be put in order. So neither a hot key nor values that crowd in one place
    make a task that holds them all.
    """
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    rows = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(times.alias("__c")).filter(F.col("__c") > 0))
    largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).head()[0] or 0
    path: list[str] = []
    if largest > ordered:
        n = rows.groupBy(*keys).agg(F.sum("__c").alias("n"))
        rows = _join_same(rows, n, keys).withColumn("__start", F.lit(0).cast("long"))
    while largest > ordered:
        rows, largest = _wanted_parts(rows, [*keys, *path], value, fractions, f"__part{len(path)}", ordered)
        path.append(f"__part{len(path)}")
    inside = Window.partitionBy(*keys, *path)
    upto = inside.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("__start") if path else F.lit(0)
    placed = rows.withColumns({"__to": start + F.sum("__c").over(upto), **({} if path else {"n": F.sum("__c").over(inside)})})
    placed = placed.withColumn("__from", F.col("__to") - F.col("__c"))
    reached = {name: _rank(q) for name, q in fractions.items()}
    covers = lambda rank: (F.col("__from") <= rank) & (rank < F.col("__to"))
    ends = [F.max(F.when(covers(edge(rank)), F.col(value))).alias(f"__{name}_{k}") for name, rank in reached.items() for k, edge in enumerate((F.floor, F.ceil))]
    points = placed.filter(_holds_rank(fractions, F.col("__from"), F.col("__to"))).groupBy(*keys, "n").agg(*ends)
    between = {
        name: F.col(f"__{name}_0") + (F.col(f"__{name}_1") - F.col(f"__{name}_0")) * (rank - F.floor(rank)) for name, rank in reached.items()
    }
    return points.select(*keys, "n", *[c.alias(name) for name, c in between.items()])


def _rank(fraction: float) -> Column:
    """Position from 0 of a percentile among ``n`` values."""
    return F.lit(fraction) * (F.col("n") - 1)


def _holds_rank(fractions: dict[str, float], start: Column, end: Column) -> Column:
    """Positions from ``start`` up to, not with, ``end`` include one that a percentile needs."""
    tests = [(start <= edge(_rank(q))) & (edge(_rank(q)) < end) for q in fractions.values() for edge in (F.floor, F.ceil)]
    return reduce(lambda a, b: a | b, tests)


def _join_same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys, where null equals null; the keys of the left side stay."""
    renamed = right.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)], F.lit(True))
    return left.join(renamed, on).drop(*[f"__r{i}" for i in range(len(keys))])


def _wanted_parts(rows: DataFrame, keys: list[str], value: str, fractions: dict[str, float], part: str, ordered: int) -> tuple[DataFrame, int]:
    """``rows`` of the parts that hold a wanted rank, with the number of the part, and the values of the fullest part."""
    cuts = [i / RANGE_PARTS for i in range(1, RANGE_PARTS)]
    summary = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"), F.percentile_approx(value, cuts, RANGE_PARTS * 100).alias("__cuts"))
    full = F.col("__m") > ordered
    summary = summary.select(*keys, F.when(full, F.array_distinct("__cuts")).otherwise(F.slice("__cuts", 1, 0)).alias("__cuts"))
    dealt = _join_same(rows, summary, keys).withColumn(part, F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    parts = dealt.groupBy(*keys, part).agg(F.sum("__c").alias("__s"), F.count(F.lit(1)).alias("__m"), F.min("n").alias("n"), F.min("__start").alias("__start"))
    # at most RANGE_PARTS rows of a key meet here
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__start", F.col("__start") + F.coalesce(F.sum("__s").over(before), F.lit(0)))
    parts = cut_lineage(parts.filter(_holds_rank(fractions, F.col("__start"), F.col("__start") + F.col("__s"))))
    kept = _join_same(dealt.drop("__start"), parts.select(*keys, part, "__start"), [*keys, part])
    return cut_lineage(kept), parts.agg(F.max("__m")).head()[0]
