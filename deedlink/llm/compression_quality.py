"""Quality classifier from compressed sizes: one zstandard dictionary of good text, one of bad text.

A text is cut into blocks of ``BLOCK`` bytes, so that the dictionaries count in the whole text and not only at its
start. Every block is compressed with both dictionaries. The difference of the two total sizes, by byte of text, and
the compressed size by byte go into a logistic calibration fitted on labelled rows that gave nothing to the dictionaries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, functions as F

from deedlink.llm.common import map_arrow, smallest, stage, texts

BLOCK = 512
DICTIONARY_BYTES = 65_536
LEVEL = 3
#: Labelled rows that are used for fitting, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 6_000
#: Blocks of a class that go into its dictionary, at most: those with the smallest hash.
SAMPLE_BLOCKS = 8_000
#: Bytes added to a text's length, so that the figures of very short texts lean to nought.
SHRINK = 24
FEATURES = 3


class CompressionModel(NamedTuple):
    """``good`` and ``bad``: dictionaries, empty when a class has no rows; then ``prior`` is every text's score."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float


def fold(doc_id: Column) -> Column:
    """0 to 3, by the id alone."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def _compressors(good: bytes, bad: bytes) -> list[zstd.ZstdCompressor]:
    return [
        zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        for d in (good, bad)
    ]


def _features(text: str, good: zstd.ZstdCompressor, bad: zstd.ZstdCompressor) -> tuple[float, float, float]:
    """Size difference by byte, size difference by compressed byte, compressed size by byte."""
    data = text.encode("utf-8", "replace")
    g = b = 0
    for block in blocks(data):
        g += len(good.compress(block))
        b += len(bad.compress(block))
    n = len(data) + SHRINK
    return (b - g) / n, (b - g) / (b + g + SHRINK), (b + g) / (2 * n)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic regression, intercept first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstd.ZstdError:  # too little text to train on
        return b"".join(samples)[-DICTIONARY_BYTES:]


def fit(documents: DataFrame, labels: DataFrame, allowed: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> CompressionModel:
    """A model from the rows of ``labels`` (doc_id, quality) for which ``allowed`` holds, at most ``sample_rows`` of them.

    Rows of fold 0 give text to the dictionaries, the others calibrate. Null texts count as empty, null labels and
    ids are left out. Without rows of both classes the model scores every text by the share of good rows.
    """
    chosen = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    if allowed is not None:
        chosen = chosen.where(allowed)
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = smallest(chosen, F.xxhash64("doc_id"), sample_rows, chosen.count())
    rows = stage(
        documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("part", fold(F.col("doc_id"))),
        "quality-sample",
    )
    n_good, n = rows.agg(F.sum("quality"), F.count(F.lit(1))).first()
    prior = ((n_good or 0) + 1) / (n + 2)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quality, block = [], []
            for q, text in zip(batch.column("quality").to_pylist(), texts(batch.column("text"))):
                own = blocks(text.encode("utf-8", "replace"))
                block += own
                quality += [q] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(quality, pa.int32()), pa.array(block, pa.binary())], ["quality", "block"])

    parts = map_arrow(rows.where("part = 0").select("quality", "text"), cut, "quality int, block binary").distinct()
    made = []
    for q in (1, 0):
        own = parts.where(F.col("quality") == q).orderBy(F.xxhash64("block"), "block").limit(SAMPLE_BLOCKS).collect()
        made.append(_dictionary([bytes(r["block"]) for r in own]) if own else b"")
    good, bad = made
    if not good or not bad:
        return CompressionModel(b"", b"", (), prior)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _compressors(good, bad)
        for batch in batches:
            x = [_features(t, *pair) for t in texts(batch.column("text"))]
            columns = [pa.array([r[k] for r in x], pa.float64()) for k in range(FEATURES)]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), *columns], ["quality", "a", "b", "c"])

    seen = map_arrow(rows.where("part <> 0").select("quality", "text"), measure, "quality int, a double, b double, c double").collect()
    y = np.array([r[0] for r in seen], float)
    if not 0 < y.sum() < len(y):
        return CompressionModel(b"", b"", (), prior)
    x = np.array([r[1:] for r in seen], float)
    centre, spread = x.mean(0), x.std(0) + 1e-9
    w = _logistic((x - centre) / spread, y)
    slopes = w[1:] / spread
    return CompressionModel(good, bad, (float(w[0] - slopes @ centre), *map(float, slopes)), prior)


def score(documents: DataFrame, model: CompressionModel, name: str = "quality_score") -> DataFrame:
    """``documents`` with the chance that a text is good, in a column called ``name`` (replaced if it is there).

    All other columns stay. Null texts score as empty ones.
    """
    kept = [c for c in documents.columns if c != name]
    slim = documents.select(*kept)
    schema = slim.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _compressors(model.good, model.bad) if model.weights else None
        for batch in batches:
            values = []
            for text in texts(batch.column(kept.index("text"))):
                if pair is None:
                    values.append(model.prior)
                    continue
                z = model.weights[0] + sum(w * x for w, x in zip(model.weights[1:], _features(text, *pair)))
                values.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*kept, name])

    return map_arrow(slim, run, schema)
