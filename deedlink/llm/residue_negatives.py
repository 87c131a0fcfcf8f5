"""Hard negatives by exact integer scores from matrix products in residue number systems.

The components of the vectors are whole numbers. Two blocks of vectors are multiplied modulo several small primes in
float32, where every partial sum is a whole number below 2^24 and hence exact, and the signed scores are put together by
Chinese remaindering (mixed radix). The primes are as many as the largest possible score asks for. Anchors meet all rows in
blocks: a first pass finds every anchor's positives, a second one, which knows their scores, selects the first rows inside
each positive's window. A task keeps the best few per anchor, so that what is shuffled are tops and no scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from deedlink.llm.common import map_arrow, stage

#: Primes are taken downwards from here: 125 * 125 * 1,024 products stay below 2^24.
LARGEST_PRIME = 251
#: Components multiplied at a time.
DEPTH = 1_024
#: Rows and anchors in a block; anchors that one task holds.
ROW_BLOCK, ANCHOR_BLOCK, ANCHORS_OF_TASK = 4_096, 512, 2_048
#: Squared length of the longest vector, above which windows of scores might leave 64 bits.
LARGEST_NORM = 2.0**54
#: Row numbers: the task's number is above these bits.
TASK_BITS = 34


@lru_cache
def primes(bound: int) -> tuple[int, ...]:
    """Primes whose product exceeds ``2 * bound + 1``, largest first."""
    found, product = [], 1
    for n in range(LARGEST_PRIME, 2, -1):
        if product > 2 * bound + 1:
            return tuple(found)
        if all(n % k for k in range(2, int(n**0.5) + 1)):
            found.append(n)
            product *= n
    raise ValueError("scores are too large")


def residues(matrix: np.ndarray, prime: int) -> np.ndarray:
    """Least absolute residues in float32."""
    r = np.remainder(matrix, prime)
    return np.where(r > prime // 2, r - prime, r).astype(np.float32)


def scores(left: list[np.ndarray], right: list[np.ndarray], moduli: tuple[int, ...]) -> np.ndarray:
    """Exact inner products, int64, of the rows of two blocks given by their residues for each modulus."""
    digits = []
    for a, b, p in zip(left, right, moduli):
        total = np.zeros((len(a), len(b)), np.float32)
        for k in range(0, a.shape[1], DEPTH):
            total = np.remainder(total + a[:, k : k + DEPTH] @ b[:, k : k + DEPTH].T, np.float32(p))
        # mixed radix: what the digits found so far leave of the score modulo p
        digit = total.astype(np.int32)
        for (known, q) in digits:
            digit = (digit - known) * pow(q, -1, p) % p
        digits.append((digit, p))
    result, weight = np.zeros(digits[0][0].shape, np.int64), 1
    for digit, p in digits:
        result += digit.astype(np.int64) * weight
        weight *= p
    return np.where(result > weight // 2, result - weight, result)


class Block:
    """Vectors of an Arrow row: numbers, identifiers and their ranks, labels, residues by modulus."""

    def __init__(self, row: dict, kind: np.dtype, moduli: tuple[int, ...]):
        self.number = np.asarray(row["number"], np.int64)
        self.id, self.label = row["id"], row["label"]
        (self.order,) = codes(self.id)
        matrix = np.frombuffer(row["vectors"], kind).reshape(len(self.number), -1).astype(np.int64)
        self.residues = [residues(matrix, p) for p in moduli]


def codes(*lists: list) -> list[np.ndarray]:
    """Ranks of the values of several lists in one order, null last."""
    known = {v: i for i, v in enumerate(sorted({v for x in lists for v in x if v is not None}))}
    return [np.fromiter((len(known) if v is None else known[v] for v in x), np.int64, len(x)) for x in lists]


class Tops:
    """The first ``k`` (score, identifier, number) of several lists; later additions push out what is lower."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.found: list[list[tuple]] = [[] for _ in range(lists)]
        self.least = np.full(lists, np.iinfo(np.int64).min)

    def add(self, values: np.ndarray, allowed: np.ndarray, block: Block) -> None:
        """``values``: scores of every list (rows) and every row of the block."""
        mask = allowed & (values >= self.least[:, None])
        if np.count_nonzero(mask) > 2 * self.k * len(mask) and mask.shape[1] > self.k:
            # the k-th score of each list bounds what can be among the first k
            held = np.where(mask, values, np.iinfo(np.int64).min)
            mask &= values >= np.partition(held, -self.k, axis=1)[:, -self.k, None]
        rows, columns = np.nonzero(mask)
        if not len(rows):
            return
        by = np.lexsort((block.number[columns], block.order[columns], -values[rows, columns], rows))
        rows, columns = rows[by], columns[by]
        lists, starts = np.unique(rows, return_index=True)
        for i, new in zip(lists, np.split(columns, starts[1:])):
            more = [(int(values[i, j]), block.id[j], int(block.number[j])) for j in new[: self.k]]
            both = sorted(self.found[i] + more, key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1], x[2]))
            self.found[i] = both[: self.k]
            if len(self.found[i]) == self.k:
                self.least[i] = self.found[i][-1][0]


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _packed(schema: pa.Schema, width: int, kind: np.dtype, size: int):
    """Vectors in, blocks of at most ``size`` vectors out; other columns become lists. Rows without a number get one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << TASK_BITS

        def block(rows):
            matrix = np.zeros((len(rows), width), kind)
            for i, r in enumerate(rows):
                matrix[i, : len(r["vectors"])] = r["vectors"]
            return _batch([tuple(matrix.tobytes() if f.name == "vectors" else [r[f.name] for r in rows] for f in schema)], schema)

        waiting: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                row.setdefault("number", number)
                number += 1
                waiting.append(row)
                if len(waiting) == size:
                    yield block(waiting)
                    waiting = []
        if waiting:
            yield block(waiting)

    return run


def _unpacked(schema: pa.Schema, kind: np.dtype):
    """Blocks in, their anchors out as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = np.frombuffer(row["vectors"], kind).reshape(len(row["number"]), -1)
                found = [(n, i, x, v.tolist()) for n, i, x, v, a in zip(row["number"], row["id"], row["label"], matrix, row["anchor"]) if a]
                if found:
                    yield _batch(found, schema)

    return run


def _lists(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k if isinstance(k, T.BinaryType) else T.ArrayType(k)) for n, k in kinds.items()])


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict]]:
    """Pairs of blocks: a row of the blocks of rows and a row of the blocks of anchors."""
    for batch in batches:
        for i in range(batch.num_rows):
            pair = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}
            yield pair, {n[2:]: v for n, v in pair.items() if n.startswith("a_")}


class _Task:
    """Blocks that a task has met, with residues; rows of blocks come again for every block of anchors."""

    def __init__(self, kind: np.dtype, moduli: tuple[int, ...]):
        self.form, self.last, self.anchors = (kind, moduli), (None, None), {}

    def meet(self, row: dict, anchor: dict) -> tuple[Block, Block, dict]:
        if self.last[0] != row["number"][0]:
            self.last = (row["number"][0], Block(row, *self.form))
        first = anchor["number"][0]
        if first not in self.anchors:
            self.anchors[first] = (Block(anchor, *self.form), {})
        return self.last[1], *self.anchors[first]


def _positives(schema: pa.Schema, kind: np.dtype, moduli: tuple[int, ...], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(kind, moduli)
        for row, anchor in _rows_of(batches):
            rows, anchors, state = task.meet(row, anchor)
            tops = state.setdefault("tops", Tops(len(anchors.number), k))
            own, labels = codes(anchors.label, rows.label)
            allowed = (own[:, None] == labels[None, :]) & (anchors.number[:, None] != rows.number[None, :])
            tops.add(scores(anchors.residues, rows.residues, moduli), allowed, rows)
        for anchors, state in task.anchors.values():
            found = [(int(a), *t) for a, tops in zip(anchors.number, state["tops"].found) for t in tops]
            if found:
                yield _batch(found, schema)

    return run


def _negatives(schema: pa.Schema, kind: np.dtype, moduli: tuple[int, ...], k: int, low: int, high: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(kind, moduli)
        for row, anchor in _rows_of(batches):
            rows, anchors, state = task.meet(row, anchor)
            if not state:
                windows = anchor["windows"]
                most = max(len(w) for w in windows)
                filled = np.zeros((len(windows), most), np.int64)
                for i, w in enumerate(windows):
                    filled[i, : len(w)] = [x["score"] for x in w]
                state["windows"] = windows
                # whole scores s with low * p <= share * s <= high * p
                state["from"], state["to"] = -((-low * filled) // share), (high * filled) // share
                state["used"] = np.array([[j < len(w) for j in range(most)] for w in windows])
                state["tops"] = [Tops(len(windows), k) for _ in range(most)]
            own, labels = codes(anchors.label, rows.label)
            other = own[:, None] != labels[None, :]
            values = scores(anchors.residues, rows.residues, moduli)
            for j, tops in enumerate(state["tops"]):
                inside = (values >= state["from"][:, j, None]) & (values <= state["to"][:, j, None])
                tops.add(values, inside & other & state["used"][:, j, None], rows)
        for anchors, state in task.anchors.values():
            for j, tops in enumerate(state["tops"]):
                found = [
                    (int(a), anchors.id[i], w[j]["place"], w[j]["id"], w[j]["score"], *t)
                    for i, (a, w) in enumerate(zip(anchors.number, state["windows"]))
                    if j < len(w)
                    for t in tops.found[i]
                ]
                if found:
                    yield _batch(found, schema)

    return run


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` of each key, higher scores first, then smaller identifiers, null last; ``place`` from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "number")
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(
    vectors: DataFrame, anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, share: int = 100,
) -> DataFrame:
    """Hard negatives of every anchor and positive.

    ``anchor`` is a condition on the rows of ``vectors``; null is false. Rows with a null label, a null vector or a null
    or non-finite component take no part; a row without id takes part and comes last among equal scores. A component x
    counts as floor(scale * x), x as double; a vector shorter than the longest is continued by zeros. An anchor's positives
    are its first ``positives`` other rows of the same label; rows that repeat the anchor's id are other rows. A
    positive's negatives are the first ``negatives`` rows of another label with
    ``low * positive_score <= share * negative_score <= high * positive_score``. Returns ``anchor_id``, ``positive_id``,
    ``rank``, ``negative_id``, ``positive_score``, ``negative_score``; an anchor that is repeated gives its rows as often.
    Vectors whose squared length reaches ``LARGEST_NORM`` raise ValueError. Other columns are not read. An empty table gives no rows.
    """
    kinds = {"id": vectors.schema[id].dataType, "label": vectors.schema[label].dataType}
    usable = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(F.col(vector), lambda x: F.floor(scale * x.cast("double")))
    read = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & usable)
    square = F.aggregate(F.transform(whole, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    width, norm = read.agg(F.max(F.size(vector)), F.max(square)).head()
    if (norm or 0) >= LARGEST_NORM:
        raise ValueError("scores are too large")
    width, norm = max(width or 0, 1), int((norm or 0) * 1.000001) + 1
    moduli, kind = primes(norm), np.dtype(np.int16 if norm < 1 << 30 else np.int32 if norm < 1 << 62 else np.int64)

    read = read.select(F.col(id).alias("id"), F.col(label).alias("label"), whole.alias("vectors"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    packed = _lists(number=T.LongType(), **kinds, anchor=T.BooleanType(), vectors=T.BinaryType())
    blocks = stage(map_arrow(read, _packed(_arrow(packed), width, kind, ROW_BLOCK), packed), "residue-rows")

    single = T.StructType([T.StructField("number", T.LongType())] + [T.StructField(n, k) for n, k in kinds.items()] + [T.StructField("vectors", T.ArrayType(T.LongType()))])
    anchors = stage(map_arrow(blocks.where(F.exists("anchor", lambda x: x)), _unpacked(_arrow(single), kind), single), "residue-anchors")
    tasks = anchors.count() // ANCHORS_OF_TASK + 1
    rows = blocks.drop("anchor")

    def meet(df: DataFrame, function, result: T.StructType, **more: T.DataType) -> DataFrame:
        """``function`` over the pairs of a block of rows and a block of anchors; a task has one part of either."""
        packed = _lists(number=T.LongType(), **kinds, **more, vectors=T.BinaryType())
        parts = stage(map_arrow(df.repartition(tasks), _packed(_arrow(packed), width, kind, ANCHOR_BLOCK), packed), "residue-anchor-blocks")
        parts = parts.select(*(F.col(c).alias(f"a_{c}") for c in parts.columns))
        return map_arrow(rows.crossJoin(parts.hint("shuffle_replicate_nl")), function, result)

    long = T.LongType()
    top = [T.StructField("score", long), T.StructField("id", kinds["id"]), T.StructField("number", long)]
    result = T.StructType([T.StructField("anchor", long), *top])
    found = _first(meet(anchors, _positives(_arrow(result), kind, moduli, positives), result), ["anchor"], positives)
    windows = found.groupBy(F.col("anchor").alias("number")).agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("windows"))
    windows = stage(windows, "residue-positives")

    known = [T.StructField("anchor_id", kinds["id"]), T.StructField("positive", T.IntegerType()), T.StructField("positive_id", kinds["id"])]
    result = T.StructType([T.StructField("anchor", long), *known, T.StructField("positive_score", long), *top])
    function = _negatives(_arrow(result), kind, moduli, negatives, low, high, share)
    found = meet(anchors.join(windows, "number"), function, result, windows=windows.schema["windows"].dataType)
    return _first(found, ["anchor", "positive"], negatives).select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


#: The registered query in SQL.
NEGATIVES_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.n AS anchor, a.vec_id AS anchor_id, b.n, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.n <> b.n WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5
), r AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score
)
SELECT * FROM r WHERE rank <= 10
"""
