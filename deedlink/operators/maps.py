"""Places on a map: robust centres of areas, rows without coordinates put there, and a pyramid of heat tiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Cells of the grid in which centres are found, per degree (own choice: about 11 m).
CELLS_PER_DEGREE = 10_000
#: Where the coordinates of a row come from.
OWN_PLACE, NO_PLACE = "exact", "none"
#: Levels of tiles whose bits fit one long.
DEEPEST_LEVEL = 30


def located(lat: Column | str = "lat", lon: Column | str = "lon") -> Column:
    """Both coordinates are there."""
    lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
    return lat.isNotNull() & lon.isNotNull()


def area_centres(df: DataFrame, areas: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The component-wise median cell of the located rows of every area: ``area``, ``name``, ``lat``, ``lon``, ``rows``.

    ``areas`` are columns (ZIP, neighborhood); a blank or missing name is no area. Coordinates are counted by cell first,
    for all areas and both axes in one exchange: a count by cell is mergeable, and its size is bounded by the grid and not by
    the rows. The median is then the first cell up to which half of the rows lie.
    """
    cell = {axis: F.floor(F.col(c) * CELLS_PER_DEGREE) for axis, c in (("lat", lat), ("lon", lon))}
    entries = [
        F.struct(F.lit(a).alias("area"), F.col(a).cast("string").alias("name"), F.lit(axis).alias("axis"), c.alias("cell"))
        for a in areas
        for axis, c in cell.items()
    ]
    counted = (
        df.filter(located(lat, lon))
        .select(F.inline(F.array(*entries)))
        .filter(F.coalesce(F.trim("name"), F.lit("")) != "")
        .groupBy("area", "name", "axis", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    whole = Window.partitionBy("area", "name", "axis")
    upto = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumns({"rows": F.sum("n").over(whole), "upto": F.sum("n").over(upto)})
    half = placed.filter((2 * F.col("upto") >= F.col("rows")) & (2 * (F.col("upto") - F.col("n")) < F.col("rows")))
    centre = {axis: ((F.max(F.when(F.col("axis") == axis, F.col("cell"))) + 0.5) / CELLS_PER_DEGREE).alias(axis) for axis in ("lat", "lon")}
    return half.groupBy("area", "name").agg(*centre.values(), F.max("rows").alias("rows"))


def with_map_place(df: DataFrame, areas: list[str], lat: str = "lat", lon: str = "lon", centres: DataFrame | None = None) -> DataFrame:
    """``mapLat``, ``mapLon`` and ``mapSource``: a row's own coordinates, else the centre of the first area that has one.

    ``mapSource`` is ``exact``, the column of the area, or ``none``. Without ``centres`` they are learned from ``df``. There is
    one row per area name, so Spark broadcasts them while they are small and splits a large area's rows otherwise.
    """
    centres = area_centres(df, areas, lat, lon) if centres is None else centres
    result = df
    for i, area in enumerate(areas):
        own = centres.filter(F.col("area") == area).select(F.col("name").alias(f"__name{i}"), F.struct("lat", "lon").alias(f"__centre{i}"))
        result = result.join(own, F.col(area).cast("string") == F.col(f"__name{i}"), "left").drop(f"__name{i}")
    exact = located(lat, lon)
    place, source = F.when(exact, F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))), F.when(exact, OWN_PLACE)
    for i, area in enumerate(areas):
        centre = F.col(f"__centre{i}")
        place, source = F.coalesce(place, centre), F.coalesce(source, F.when(centre.isNotNull(), area))
    result = result.withColumns({"__place": place, "mapSource": F.coalesce(source, F.lit(NO_PLACE))})
    result = result.withColumns({"mapLat": F.col("__place.lat"), "mapLon": F.col("__place.lon")})
    return result.drop("__place", *[f"__centre{i}" for i in range(len(areas))])


#: Masks that spread the bits of a number over every second place, by the width of the groups that are moved apart.
_SPREAD = {16: 0x0000FFFF0000FFFF, 8: 0x00FF00FF00FF00FF, 4: 0x0F0F0F0F0F0F0F0F, 2: 0x3333333333333333, 1: 0x5555555555555555}


def _spread(c: Column) -> Column:
    """Bit i of a number below 2^31 moved to bit 2 i."""
    for width, mask in _SPREAD.items():
        c = (c.bitwiseOR(F.shiftleft(c, width))).bitwiseAND(F.lit(mask))
    return c


def _gathered(c: Column) -> Column:
    """Bit 2 i moved back to bit i."""
    c = c.bitwiseAND(F.lit(_SPREAD[1]))
    for width, mask in zip((1, 2, 4, 8, 16), [_SPREAD[2], _SPREAD[4], _SPREAD[8], _SPREAD[16], 0xFFFFFFFF]):
        c = (c.bitwiseOR(F.shiftright(c, width))).bitwiseAND(F.lit(mask))
    return c


def tile(lat: Column, lon: Column, level: int) -> Column:
    """Number of the tile of a level: the world is 2^level columns from west and rows from north, whose bits alternate.

    The tile one level up is the number without its last two bits. Null without coordinates.
    """
    if not 0 <= level <= DEEPEST_LEVEL:
        raise ValueError(f"levels go from 0 to {DEEPEST_LEVEL}")
    side = 1 << level

    def line(share: Column) -> Column:
        return F.greatest(F.least(F.floor(share * side).cast("long"), F.lit(side - 1).cast("long")), F.lit(0).cast("long"))

    number = _spread(line((lon + 180) / 360)).bitwiseOR(F.shiftleft(_spread(line((90 - lat) / 180)), 1))
    return F.when(lat.isNotNull() & lon.isNotNull(), number)


def heat_tiles(df: DataFrame, lat: Column, lon: Column, levels: list[int], sums: dict[str, Column] | None = None) -> DataFrame:
    """Rows and sums per tile for every level: ``level``, ``tile``, ``column``, ``line``, ``rows`` and the sums.

    Only the deepest level is counted from the rows; each other level adds up the tiles of the next deeper one, so that
    its cost falls with the number of tiles. Rows without coordinates are counted under a null tile.
    """
    steps = sorted(set(levels), reverse=True)
    names = list(sums or {})
    read = df.select(tile(lat, lon, steps[0]).alias("tile"), *[c.alias(n) for n, c in (sums or {}).items()])
    current = read.groupBy("tile").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(n).alias(n) for n in names])
    found = [current.withColumn("level", F.lit(steps[0]))]
    for deeper, level in zip(steps, steps[1:]):
        above = current.withColumn("tile", F.shiftright("tile", 2 * (deeper - level)))
        current = above.groupBy("tile").agg(*[F.sum(n).alias(n) for n in ("rows", *names)])
        found.append(current.withColumn("level", F.lit(level)))
    column, line = _gathered(F.col("tile")), _gathered(F.shiftright("tile", 1))
    return reduce(DataFrame.unionByName, found).select("level", "tile", column.alias("column"), line.alias("line"), "rows", *names)
