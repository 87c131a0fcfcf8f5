"""Sharding by a k-d tree over the metadata of documents, with DataFrame operations only.

A node that shall give n shards is cut along the dimension in which it is widest, at the weighted quantile that leaves
floor(n / 2) shards' worth of bytes on the lower side. A quantile is found by histograms: every pass sums the bytes of
every node's buckets, keeps the bucket in which the quantile lies and cuts that into buckets again. Rows that are equal in the
dimension are told apart by a hash of their id in the same way. What reaches the driver is one row per node and pass;
rows are not moved until they are numbered inside their shards.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from deedlink.llm.common import stage

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Buckets of a histogram.
BUCKETS = 1_024
#: A cut may miss its quantile by this share of a shard.
TOLERANCE = 0.002
#: Rows that are numbered in one task.
SLICE_ROWS = 200_000
#: Nodes whose cuts are looked up by a broadcast, at most.
BROADCAST_NODES = 10_000


class Cut(NamedTuple):
    """Rows go down (to ``low``) if the dimension's value is below ``value``, or equal to it with a hash of at most ``tie``."""

    node: int
    dimension: int
    value: int
    tie: int


class _Search(NamedTuple):
    """Where the quantile of a node lies: ``before`` bytes are below ``low``; rows of [low, high] are still to be told apart."""

    node: int
    dimension: int
    goal: float
    before: float
    low: int
    high: int
    value: int | None


def number_of(column: str, kind: str) -> Column:
    """A dimension as a long that keeps the order of its values; texts by their first seven bytes. Nulls come first."""
    c = F.col(column)
    if kind == "string":
        code = F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    else:
        # values beyond 2 ** 61 count as equal: differences of two values then never overflow
        code = F.greatest(F.least(c.cast("long"), F.lit(1 << 61)), F.lit(-(1 << 61)))
    return F.coalesce(code, F.lit(-1 if kind == "string" else -(1 << 61)))


def _literal_table(spark, names: list[str], rows: list[tuple]) -> DataFrame:
    values = ", ".join("(" + ", ".join("CAST(NULL AS BIGINT)" if v is None else f"{v}D" if isinstance(v, float) else f"{v}L" for v in r) + ")" for r in rows)
    out = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
    return F.broadcast(out) if len(rows) <= BROADCAST_NODES else out


def _histogram(rows: DataFrame, searches: list[_Search], dims: list[str], key: Column, exact: Column) -> dict[int, tuple]:
    """For each node the bucket in which its goal lies: bytes before it, its bytes, least and greatest key."""
    table = _literal_table(rows.sparkSession, ["node", "dimension", "goal", "before", "low", "high", "value"], [tuple(s) for s in searches])
    found = rows.join(table, "node").withColumn("key", key).where(exact & F.col("key").between(F.col("low"), F.col("high")))
    width = (F.col("high") - F.col("low")).cast("double") + 1
    bucket = F.least(F.floor((F.col("key") - F.col("low")) / width * BUCKETS), F.lit(BUCKETS - 1))
    summed = found.groupBy("node", "goal", "before", bucket.alias("bucket")).agg(
        F.sum("size").cast("double").alias("bytes"), F.min("key").alias("least"), F.max("key").alias("most")
    )
    # at most BUCKETS rows for a node from here on
    order = Window.partitionBy("node").orderBy("bucket")
    run = summed.withColumn("upto", F.col("before") + F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("last", F.lead("bucket").over(order).isNull())
    run = run.withColumn("met", (F.col("upto") >= F.col("goal")) | F.col("last"))
    best = run.where("met").groupBy("node").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("bytes")).alias("before"), "bytes", "least", "most")).alias("x"))
    return {r["node"]: (r["x"]["before"], r["x"]["bytes"], r["x"]["least"], r["x"]["most"]) for r in best.collect()}


def _cuts(rows: DataFrame, todo: dict[int, tuple[int, float, int, int]], dims: list[str], slack: float) -> list[Cut]:
    """A cut for every node of ``todo``: (dimension, goal in bytes, least and greatest value)."""
    value_key = F.element_at(F.array(*dims), (F.col("dimension") + 1).cast("int"))
    values = [_Search(n, d, g, 0.0, low, high, None) for n, (d, g, low, high) in todo.items()]
    ties: list[_Search] = []
    done: list[Cut] = []
    while values or ties:
        next_values: list[_Search] = []
        next_ties: list[_Search] = []
        if values:
            for node, (before, size, least, most) in _histogram(rows, values, dims, value_key, F.lit(True)).items():
                s = next(x for x in values if x.node == node)
                if before + size - s.goal <= slack:
                    done.append(Cut(node, s.dimension, most, (1 << 62)))
                elif s.goal - before <= slack and before > 0:
                    done.append(Cut(node, s.dimension, least, -1))
                elif least == most:
                    next_ties.append(_Search(node, s.dimension, s.goal, before, 0, (1 << 61), least))
                else:
                    next_values.append(s._replace(before=before, low=least, high=most))
        if ties:
            for node, (before, size, least, most) in _histogram(rows, ties, dims, F.col("tie"), value_key == F.col("value")).items():
                s = next(x for x in ties if x.node == node)
                over, under = before + size - s.goal, s.goal - before
                if min(over, under) <= slack or least == most:
                    done.append(Cut(node, s.dimension, s.value, most if over <= under else least - 1))
                else:
                    next_ties.append(s._replace(before=before, low=least, high=most))
        values, ties = next_values, next_ties
    return done


def kd_shards(documents: DataFrame, dimensions: list[str], shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``documents`` (doc_id, text and the dimensions).

    The number of shards is given, or follows from ``target_bytes`` a shard. The shards' bytes differ by little more than a row
    and ``TOLERANCE``; there may be empty shards when there are fewer rows than shards. Size: UTF-8 bytes of the text (null: none)
    plus ``ROW_BYTES``. Null values come first in their dimension; equal rows are parted by a hash of their id, text
    and place. slot counts the rows of a shard from 0 without gaps. No rows give no rows.
    """
    kinds = dict(documents.dtypes)
    dims = [f"d{k}" for k in range(len(dimensions))]
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
        *(number_of(c, kinds[c]).alias(d) for c, d in zip(dimensions, dims)),
    )
    # the only pass over the texts; everything else reads a few numbers per row
    rows = rows.withColumn("tie", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "place"), 3))
    rows = stage(rows.withColumn("node", F.lit(0).cast("long")), "shard-metadata")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if shards is None:
        if not target_bytes:
            raise ValueError("give shards or target_bytes")
        shards = max(1, -(-total // target_bytes))
    slack = TOLERANCE * total / shards
    ranges = rows.agg(*(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max)))).first()
    whole = {d: max((ranges[f"max_{d}"] or 0) - (ranges[f"min_{d}"] or 0), 1) for d in dims}

    # a node is named by its first shard; leaves: how many shards it gives
    placed, leaves = rows, {0: shards}
    while count and any(n > 1 for n in leaves.values()):
        spans = placed.groupBy("node").agg(F.sum("size").alias("bytes"), *(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))))
        todo: dict[int, tuple[int, float, int, int]] = {}
        for r in spans.collect():
            n = leaves.get(r["node"], 1)
            if n > 1:
                widest = max(range(len(dims)), key=lambda k: ((r[f"max_d{k}"] - r[f"min_d{k}"]) / whole[dims[k]], -k))
                todo[r["node"]] = widest, r["bytes"] * (n // 2) / n, r[f"min_d{widest}"], r[f"max_d{widest}"]
        if not todo:  # only empty nodes are left to part
            break
        made = _cuts(placed, todo, dims, slack)
        table = _literal_table(rows.sparkSession, ["node", "dimension", "value", "tie_cut", "step"], [(*c, leaves[c.node] // 2) for c in made])
        value = F.element_at(F.array(*dims), (F.col("dimension") + 1).cast("int"))
        up = (value > F.col("value")) | ((value == F.col("value")) & (F.col("tie") > F.col("tie_cut")))
        placed = placed.join(table, "node", "left").withColumn("node", F.col("node") + F.when(up, F.col("step")).otherwise(F.lit(0)))
        placed = placed.drop("dimension", "value", "tie_cut", "step")
        leaves = {k: v for node, n in leaves.items() for k, v in (((node, n // 2), (node + n // 2, n - n // 2)) if n > 1 else ((node, n),))}

    # numbers inside a shard: by slices of bounded size, each after those before it
    slices = max(1, -(-count // (shards * SLICE_ROWS)))
    placed = placed.withColumn("slice", F.pmod("tie", F.lit(slices)))
    before = Window.partitionBy("node").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("node", "slice").agg(F.count(F.lit(1)).alias("rows")).withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("node", "slice").orderBy("tie", "place")) - 1
    return placed.withColumn("inside", inside).join(counts, ["node", "slice"]).select(
        "doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"), (F.col("start") + F.col("inside")).cast("long").alias("slot")
    )
