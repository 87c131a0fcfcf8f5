"""Suggested bids for open listings, and price projections for pending ones, from comparable sales.

Only the contract of this model is documented (inputs, tiers, window, minimum, outputs). The shares behind low,
suggested and high bid, the strategies and the confidence are choices of this package, all in ``BidModel``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from deedlink.functions.numbers import round_half_up
from deedlink.functions.presence import null_to_blank, trimmed
from deedlink.operators.aggregates import exact_percentiles
from deedlink.operators.enrich import ENRICHED
from deedlink.session import cut_lineage

#: Names in the output.
TIER_NAMES = ["T1_NEIGHBORHOOD_TYPE", "T2_ZIP_TYPE", "T3_CITY_TYPE"]
NO_TIER = "NONE"
SCORED, TOO_FEW = "SCored", "InsufficientComps"
BID_COLUMNS = [
    "bidStrategy", "bidSuggested", "bidLow", "bidHigh", "bidRatio", "bidConfidence", "bidConfidenceLabel",
    "bidCompCount", "bidCompTier", "bidStatus",
]


@dataclass(frozen=True)
class BidModel:
    """Everything that can be chosen."""

    window_days: int = 90
    min_comps: int = 6
    strategy: str = "Balanced"
    #: share of comparable sales below the suggested ratio, per strategy
    strategies: dict = field(default_factory=lambda: {"Conservative": 0.35, "Balanced": 0.5, "Aggressive": 0.65})
    low_share: float = 0.25
    high_share: float = 0.75
    exclude_presold: bool = True
    #: comparable sales that give full marks for their number, and the quartile spread that gives none
    full_count: int = 30
    widest_spread: float = 0.2
    high_confidence: int = 70
    medium_confidence: int = 45
    #: upper ends of the bands of waiting days, and the extra weight of a sale of the scenario's own band; a band away it is one less
    wait_bands: tuple = (7, 14, 30, 60)
    same_band_weight: int = 2


def eligible_listings(df: DataFrame) -> DataFrame:
    """Active enriched listings with an ask and without a close price (canonical rows)."""
    return df.filter(
        (F.col("dataMode") == ENRICHED)
        & (F.lower(trimmed(null_to_blank("mlsStatus"))) == "active")
        & (F.coalesce(F.col("closePrice"), F.lit(0)) <= 0)
        & (F.col("pendingListPrice") > 0)
    )


def pending_listings(df: DataFrame) -> DataFrame:
    """Enriched listings under contract and not closed yet (canonical rows)."""
    state = F.lower(trimmed(null_to_blank("mlsStatus")))
    return df.filter(
        (F.col("dataMode") == ENRICHED)
        & (state.startswith("pending") | (state == "contingent"))
        & (F.coalesce(F.col("closePrice"), F.lit(0)) <= 0)
        & (F.col("pendingListPrice") > 0)
    )


def comparable_sales(df: DataFrame, as_of: Column, model: BidModel = BidModel()) -> DataFrame:
    """Sold enriched rows of the last days before ``as_of``, without likely pre-sold new builds (canonical rows)."""
    pool = df.filter(
        (F.col("dataMode") == ENRICHED)
        & (F.col("closePrice") > 0)
        & (F.col("saleToList") > 0)
        & F.col("saleDate").between(F.date_sub(as_of, model.window_days), as_of)
    )
    return pool.filter(~F.col("isLikelyPresoldNewBuild")) if model.exclude_presold else pool


def _tier_key(keys: list[str]) -> Column:
    """The values of a tier's keys as one text; null if one is missing."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return F.when(known, F.to_json(F.struct(*keys)))


def _by_tier(df: DataFrame, tiers: list[list[str]]) -> DataFrame:
    """Every row once for each tier whose keys it has, with ``tier_number`` and ``tier_key``."""
    places = F.array(*[F.struct(F.lit(i).alias("tier_number"), _tier_key(keys).alias("tier_key")) for i, keys in enumerate(tiers)])
    return df.withColumn("__place", F.explode(places)).select(*df.columns, "__place.*").filter(F.col("tier_key").isNotNull())


def wait_band(wait: Column | str, model: BidModel) -> Column:
    """Number of the band of waiting days; null stays null."""
    c = F.col(wait) if isinstance(wait, str) else wait
    passed = [F.when(c > end, 1).otherwise(0) for end in model.wait_bands]
    return F.when(c.isNotNull(), sum(passed[1:], passed[0]))


def _by_wait(rows: DataFrame, near: list[str], model: BidModel) -> DataFrame:
    """Every sale once for each combination of bands that a subject can have, weighted by how near its own bands are.

    The combinations are fixed by the model, so a sale is repeated a bounded number of times; sales are counted by ratio
    and bands before that.
    """
    keys = [c for c in rows.columns if c not in near]
    own = [f"__own{i}" for i in range(len(near))]
    counted = rows.select(*keys, *[wait_band(n, model).alias(o) for n, o in zip(near, own)]).groupBy(*keys, *own).agg(F.count(F.lit(1)).alias("__rows"))
    bands = F.array(*[F.lit(i) for i in range(len(model.wait_bands) + 1)], F.lit(None).cast("int"))
    weight = F.lit(1)
    for i, o in enumerate(own):
        counted = counted.withColumn(f"__near{i}", F.explode(bands))
        step = F.greatest(F.lit(0), model.same_band_weight - F.abs(F.col(o) - F.col(f"__near{i}")))
        weight = weight + F.when(F.col(o).isNotNull() & F.col(f"__near{i}").isNotNull(), step).otherwise(0)
    return counted.withColumn("__weight", (weight * F.col("__rows")).cast("long"))


def tier_spreads(comps: DataFrame, tiers: list[list[str]], ratio: str, model: BidModel, near: list[str] | None = None) -> DataFrame:
    """Per tier and key with enough comparable sales: their number and the ratios behind low, suggested and high.

    All tiers come out of one pass over the sales. With ``near`` (columns of waiting days) there is one row per combination
    of bands of a subject, ``__near0`` and so on, and sales of near bands weigh more.
    """
    shares = {"low": model.low_share, "mid": model.strategies[model.strategy], "high": model.high_share}
    placed, keys = _by_tier(comps, tiers), ["tier_number", "tier_key"]
    if not near:
        return exact_percentiles(placed, keys, ratio, shares).filter(F.col("n") >= model.min_comps)
    weighed = _by_wait(placed.select(*keys, ratio, *near).filter(F.col(ratio).isNotNull()), near, model)
    bands = [f"__near{i}" for i in range(len(near))]
    spreads = exact_percentiles(weighed, [*keys, *bands], ratio, shares, weight="__weight").drop("n")
    number = placed.filter(F.col(ratio).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return spreads.join(number, keys).filter(F.col("n") >= model.min_comps)


def recommend(
    subjects: DataFrame, comps: DataFrame, tiers: list[list[str]], ask: str, ratio: str, model: BidModel = BidModel(), near: list[str] | None = None
) -> DataFrame:
    """Bid columns for every subject, from the first tier with enough comparable sales.

    ``near``: columns of waiting days (DOM, CDOM) of subjects and sales; sales that waited about as long weigh more.

    Comparable sales are reduced to one row per tier key before they meet a subject, so no subject-sale pair is made.
    That table is small and written out, so that looking it up for each tier does not make it again.
    """
    result = subjects
    spreads = cut_lineage(tier_spreads(comps, tiers, ratio, model, near))
    bands = {f"__near{i}": wait_band(c, model) for i, c in enumerate(near or [])}
    for i, keys in enumerate(tiers):
        own = spreads.filter(F.col("tier_number") == i)
        own = own.select(F.col("tier_key").alias(f"__k{i}"), *bands, F.struct("n", "low", "mid", "high").alias(f"__t{i}"))
        on = _tier_key(keys) == F.col(f"__k{i}")
        for name, band in bands.items():
            on = on & band.eqNullSafe(F.col(name))
        result = result.join(own, on, "left").drop(f"__k{i}", *bands)
    found = [F.col(f"__t{i}") for i in range(len(tiers))]
    tier = F.lit(None).cast("string")
    for name, t in reversed(list(zip(TIER_NAMES, found))):
        tier = F.when(t.isNotNull(), name).otherwise(tier)
    result = result.withColumns({"__best": F.coalesce(*found), "__tier": tier})
    best, price = F.col("__best"), F.col(ask)
    # fewer sales and a wider spread make a bid less certain
    count_part = F.least(best["n"] / F.lit(float(model.full_count)), F.lit(1.0))
    spread_part = F.greatest(1 - (best["high"] - best["low"]) / F.lit(model.widest_spread), F.lit(0.0))
    confidence = round_half_up(100 * (0.5 * count_part + 0.5 * spread_part))
    out = {
        "bidStrategy": F.lit(model.strategy),
        "bidSuggested": round_half_up(price * best["mid"]),
        "bidLow": round_half_up(price * best["low"]),
        "bidHigh": round_half_up(price * best["high"]),
        "bidRatio": best["mid"],
        "bidConfidence": F.coalesce(confidence, F.lit(0)),
        "bidConfidenceLabel": F.when(best.isNull(), "N/A")
        .when(confidence >= model.high_confidence, "High")
        .when(confidence >= model.medium_confidence, "Medium")
        .otherwise("Low"),
        "bidCompCount": F.coalesce(best["n"], F.lit(0)).cast("long"),
        "bidCompTier": F.coalesce(F.col("__tier"), F.lit(NO_TIER)),
        "bidStatus": F.when(best.isNull(), TOO_FEW).otherwise(SCORED),
    }
    return result.withColumns(out).drop("__best", "__tier", *[f"__t{i}" for i in range(len(tiers))])


def comps_used(
    scored: DataFrame, comps: DataFrame, subject_id: str, tiers: list[list[str]], columns: list[str], order: list[Column], k: int
) -> DataFrame:
    """The first ``k`` comparable sales of the tier each scored subject used.

    All subjects with one tier key share their sales, so the top ``k`` are taken per tier key (Spark keeps only ``k``
    rows per key and partition before the shuffle) and joined to the subjects afterwards.
    """
    first = Window.partitionBy("tier_number", "tier_key").orderBy(*order)
    top = (
        _by_tier(comps, tiers)
        .withColumn("comp_rank", F.row_number().over(first))
        .filter(F.col("comp_rank") <= k)
        .select("tier_number", "tier_key", "comp_rank", *[F.col(c).alias(f"comp_{c}") for c in columns])
    )
    number, key = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (name, keys) in enumerate(zip(TIER_NAMES, tiers)):
        used = F.col("bidCompTier") == name
        number, key = F.when(used, i).otherwise(number), F.when(used, _tier_key(keys)).otherwise(key)
    users = scored.select(subject_id, "bidCompTier", number.alias("tier_number"), key.alias("tier_key"))
    return users.join(top, ["tier_number", "tier_key"]).select(subject_id, "bidCompTier", "comp_rank", *[f"comp_{c}" for c in columns])


def project_prices(
    subjects: DataFrame, comps: DataFrame, tiers: list[list[str]], ask: str, ratio: str, model: BidModel = BidModel()
) -> DataFrame:
    """Expected close price and its range for listings under contract, by the same tiers."""
    scored = recommend(subjects, comps, tiers, ask, ratio, model)
    names = {"bidSuggested": "projectedClose", "bidLow": "projectedLow", "bidHigh": "projectedHigh", "bidRatio": "projectedRatio", "bidCompCount": "projectionComps", "bidCompTier": "projectionTier"}
    drop = [c for c in BID_COLUMNS if c not in names]
    return scored.drop(*drop).withColumnsRenamed(names)
