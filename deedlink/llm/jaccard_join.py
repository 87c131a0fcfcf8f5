"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact check.

Texts with the same set of shingles form one class and are handled once. Classes that share a band of MinHash values
meet; a pair is compared some values at a time and given up once the chance that its similarity reaches the threshold
falls below a tolerance. The pairs that remain join classes to groups; inside a group all pairs are checked exactly on
their shingle sets. Both steps run on blocks of bounded size: a large bucket or group is dealt to chunks, every two
chunks meet in one block, and a block returns one row per class (links and an own component), never a row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from deedlink.llm.common import map_arrow, mix, shingle_sequence, stage, texts
from deedlink.llm.components import components

THRESHOLD = 0.8
#: Bands and MinHash values (bytes) in a band: a pair of similarity 0.8 shares no band with a chance below 1e-8.
BANDS = 48
BAND = 5
VALUES = BANDS * BAND
#: Values compared at a time, and the chance at which a pair is given up.
STEP = 40
TOLERANCE = 1e-6
#: Classes of a bucket in a chunk; shingles of a group in a chunk.
BUCKET_ROWS = 512
GROUP_SHINGLES = 400_000
GROUP_ROWS = 512
#: Candidate documents whose ids are sent to all executors, at most; beyond that they are joined by a shuffle.
BROADCAST_IDS = 400_000
SEED = 7


def _functions() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    return random.integers(1, 1 << 32, VALUES, np.uint64).astype(np.uint32) | np.uint32(1), random.integers(0, 1 << 32, VALUES, np.uint64).astype(np.uint32)


_A, _B = _functions()


def signature(shingles: np.ndarray) -> bytes:
    """A byte of each of ``VALUES`` MinHash values."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(h), 1024):
        np.minimum(least, (h[start : start + 1024, None] * _A + _B).min(0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of compared values, a multiple of ``STEP``, the fewest matches at which a pair goes on.

    The similarity has a uniform prior; two values agree by chance once in 256 when their shingles differ. With m of n
    values equal, a pair goes on if the posterior chance of a similarity of ``threshold`` or more is ``tolerance`` or more.
    """
    grid = (np.arange(2000) + 0.5) / 2000
    agree = grid + (1 - grid) / 256
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(agree) + (n - m) * np.log1p(-agree)
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() / weight.sum() >= tolerance:
                break
        out.append(m)
    return out


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n rows the first row of its component."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(left.tolist(), right.tolist()):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return np.array([top(x) for x in range(n)])


def _sets(documents: DataFrame) -> DataFrame:
    """doc_id, class (128-bit hash of the shingle set, null without words), n (shingles), sig (MinHash bytes)."""
    slim = documents.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text in texts(batch.column("text")):
                s = np.unique(shingle_sequence(text))
                if len(s):
                    row = (xxhash.xxh3_128_digest(s.tobytes()), len(s), signature(s))
                else:
                    row = (None, 0, None)
                for column, value in zip(out, row):
                    column.append(value)
            arrays = [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "class", "n", "sig"])

    return map_arrow(slim, run, f"doc_id {kind}, class binary, n bigint, sig binary")


def _pairs_of_chunks(rows: DataFrame, key: list[str], chunks: Column, name: Column) -> DataFrame:
    """``rows`` with the chunks (low, high) in which they meet others of the same key, and ``side``: 0 low, 1 high."""
    dealt = rows.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64(name), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)))
    return dealt.select(
        *[c for c in rows.columns], F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
        (F.col("chunk") > F.col("other")).cast("int").alias("side"),
    ).repartition(*key, "low", "high").sortWithinPartitions(*key, "low", "high", "side")


def _blocks(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of sorted batches, cut where ``key`` changes; no block is held longer than needed."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in key)))
        start = 0
        for i, k in enumerate(keys):
            if k != last:
                if i > start:
                    waiting.append(batch.slice(start, i - start))
                if waiting:
                    yield pa.Table.from_batches(waiting)
                waiting, start, last = [], i, k
        if len(keys) > start:
            waiting.append(batch.slice(start))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _meeting(side: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of a block: all of a chunk with itself, otherwise across."""
    if low == high:
        return np.triu_indices(len(side), 1)
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return np.repeat(first, len(second)), np.tile(second, len(first))


def _candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that span the components of the pairs left by the Bayesian comparison."""
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    keyed = classes.select("class", "sig", band).select(
        "class", F.xxhash64("band", F.expr(f"substring(sig, 1 + band * {BAND}, {BAND})")).alias("key"), "band"
    )
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    met = keyed.join(shared, "key").join(classes.select("class", "n", "sig"), "class")
    needed = least_matches(threshold)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: tuple[list, list] = ([], [])
        for block in _blocks(batches, ["key", "low", "high"]):
            if block.num_rows < 2:
                continue
            low, high, band = (block.column(c)[0].as_py() for c in ("low", "high", "band"))
            names, n = block.column("class").to_pylist(), block.column("n").to_numpy()
            sig = np.frombuffer(b"".join(block.column("sig").to_pylist()), np.uint8).reshape(-1, VALUES)
            left, right = _meeting(block.column("side").to_numpy(), low, high)
            kept_left, kept_right = [], []
            for start in range(0, len(left), 65_536):
                x, y = left[start : start + 65_536], right[start : start + 65_536]
                fits = np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]) - 1e-9
                x, y = x[fits], y[fits]
                matches = np.zeros(len(x), int)
                for k, least in enumerate(needed):
                    part = slice(k * STEP, (k + 1) * STEP)
                    matches += (sig[x, part] == sig[y, part]).sum(1)
                    alive = matches >= least
                    x, y, matches = x[alive], y[alive], matches[alive]
                if band and len(x):  # a pair belongs to the first band that it shares
                    equal = (sig[x, : band * BAND] == sig[y, : band * BAND]).reshape(len(x), band, BAND).all(2).any(1)
                    x, y = x[~equal], y[~equal]
                kept_left.append(x), kept_right.append(y)
            x, y = np.concatenate(kept_left or [left[:0]]), np.concatenate(kept_right or [left[:0]])
            if len(x):
                for i, r in enumerate(_forest(len(names), x, y).tolist()):
                    if r != i:
                        edges[0].append(names[i]), edges[1].append(names[r])
            if len(edges[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.binary()) for e in edges], ["a", "b"])
                edges = ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(e, pa.binary()) for e in edges], ["a", "b"])

    chunks = F.ceil(F.col("rows") / F.lit(BUCKET_ROWS))
    dealt = _pairs_of_chunks(met.select("key", "band", "class", "n", "sig", "rows"), ["key"], chunks, F.col("class"))
    return map_arrow(dealt, compare, "a binary, b binary")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from products of 0/1 matrices over the shingles that two sets or more hold."""
    values = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    unique, place, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[place] > 1
    number = np.cumsum(count > 1) - 1
    rows, columns = rows[shared], number[place[shared]]
    total, width = np.zeros((len(sets), len(sets)), np.float32), 4096
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    edges = np.searchsorted(columns, np.arange(0, int((count > 1).sum()) + width, width))
    for k, (start, end) in enumerate(zip(edges, edges[1:])):
        if end > start:
            part = np.zeros((len(sets), width), np.float32)
            part[rows[start:end], columns[start:end] - k * width] = 1
            total += part @ part.T
    return total


def _verified(documents: DataFrame, classes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """class, root, links: per block and class its links (in documents) and the first class of its component there."""
    members = classes.select("class", "rep", "n", "copies").join(groups.select(F.col("node").alias("class"), F.col("root").alias("group")), "class")
    members = stage(members.where(F.col("rep").isNotNull()), "jaccard-members")
    sizes = members.groupBy("group").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    chunks = F.greatest(F.ceil(F.col("total") / F.lit(GROUP_SHINGLES)), F.ceil(F.col("rows") / F.lit(GROUP_ROWS)))
    wanted = members.join(sizes.select("group", chunks.alias("parts")), "group")
    small = members.count() <= BROADCAST_IDS
    kind = documents.schema["doc_id"].dataType.simpleString()
    wanted = wanted.select(F.col("rep").cast(kind).alias("doc_id"), "class", "group", "copies", "parts")
    found = documents.select("doc_id", "text").join(F.broadcast(wanted) if small else wanted, "doc_id")
    schema = "class binary, group binary, copies bigint, parts bigint, shingles binary"

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_sequence(t)).tobytes() for t in texts(batch.column("text"))]
            own = [xxhash.xxh3_128_digest(s) for s in sets]
            keep = pa.array([a == b for a, b in zip(own, batch.column("class").to_pylist())], pa.bool_())
            columns = [batch.column(c) for c in ("class", "group", "copies", "parts")]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary())], ["class", "group", "copies", "parts", "shingles"])
            yield out.filter(keep)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, ["group", "low", "high"]):
            low, high = block.column("low")[0].as_py(), block.column("high")[0].as_py()
            names, place = np.unique(np.array(block.column("class").to_pylist(), object), return_index=True)  # repeated rows
            sets = [np.frombuffer(block.column("shingles")[i].as_py(), np.uint64) for i in place.tolist()]
            side, copies = block.column("side").to_numpy()[place], block.column("copies").to_numpy()[place]
            common, size = _intersections(sets), np.array([len(s) for s in sets], np.float64)
            linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6
            np.fill_diagonal(linked, False)
            if low != high:
                linked &= side[:, None] != side[None, :]
            x, y = np.nonzero(np.triu(linked))
            root = _forest(len(names), x, y)
            links = (linked * copies[None, :]).sum(1)
            rows = np.flatnonzero(links).tolist()
            arrays = [pa.array([names[i] for i in rows], pa.binary()), pa.array([names[root[i]] for i in rows], pa.binary()), pa.array(links[rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["class", "root", "links"])

    held = map_arrow(found, shingles, schema)
    dealt = _pairs_of_chunks(held, ["group"], F.col("parts"), F.col("class"))
    return map_arrow(dealt, check, "class binary, root binary, links bigint")


def jaccard_join(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, class_id, n_links, copy_of.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is ``threshold`` or more.
    n_links: other documents linked to this one, copies included. class_id: least doc_id of all that are reached over
    links. copy_of: least doc_id with the same shingle set. Texts without words (null, empty, blank) have no links and
    are classes by themselves; texts of one to four words are linked to equal ones only. Repeated rows are copies of
    each other. Rows whose ids are null count as copies but name no class: theirs is null if nobody else is in it.
    """
    sets = stage(_sets(documents), "jaccard-sets")
    classes = sets.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")
    )
    classes = stage(classes, "jaccard-classes")
    groups = components(stage(_candidates(classes, threshold), "jaccard-candidates"))
    checked = stage(_verified(documents, classes, groups, threshold), "jaccard-links")
    links = checked.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(checked, "class", "root").withColumnRenamed("node", "class")
    joined = classes.select("class", "rep", "copies").join(roots, "class", "left").join(links, "class", "left")
    joined = stage(joined.select("class", "rep", "copies", F.coalesce("root", "class").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "jaccard-result")
    several = joined.where("links > 0").groupBy("root").agg(F.min("rep").alias("least"))
    known = joined.where("links > 0 or copies > 1").join(several, "root", "left").select(
        "class", F.coalesce("least", "rep").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("rep").alias("copy_of")
    )
    return sets.select("doc_id", "class").join(known, "class", "left").select(
        "doc_id",
        F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
    )


def one_of_each(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` without those that reach a lesser doc_id over links; of rows equal in id and text one stays.

    Rows whose id is null stay.
    """
    found = stage(jaccard_join(documents, threshold), "jaccard-classes-of-documents")
    gone = found.where("doc_id <> class_id").select("doc_id").distinct()
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    small = gone.count() <= BROADCAST_IDS
    left = documents.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti")
    if twice.isEmpty():
        return left
    return left.join(twice, "doc_id", "left_anti").unionByName(left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
