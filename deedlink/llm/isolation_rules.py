"""Quality rules by isolation forest: statistics of a text, path lengths over random splits, a calibrated threshold.

The forest is grown on labelled good rows, so that a short path means "unlike good text". The threshold is set on
labelled rows of both kinds: it separates them best among those that let nearly all good rows pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from deedlink.llm.common import map_arrow, stage, texts

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Rules that hold without a model.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: Labelled rows whose ids are sent to all executors, at most; beyond that they are joined by a shuffle.
BROADCAST_IDS = 400_000
TREES = 120
TREE_ROWS = 512
#: Cuts of the anomaly among which the threshold is chosen.
CUTS = 1 << 16
RATIOS = 6
#: Share of labelled good rows that the threshold must let pass.
GOOD_KEPT = 0.995
#: How far outside a node's rows a cut may lie, in standard deviations of all labelled rows.
MARGIN = 0.25
SEED = 20_240_229

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_marks"]
_MARKS = set("!?;:,.\"'()[]{}")


class ForestModel(NamedTuple):
    """Trees as arrays (feature, cut, left child; the right one follows it; -1: leaf) with the depth to add at a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    threshold: float


def statistics(text: str) -> tuple[int, ...]:
    """The figures named in ``STATISTICS`` and ``EXTRA`` for a whole text.

    Words are runs of characters other than ASCII white space. A line counts as repeated if it has a word and equals
    an earlier line. A word counts as repeated if it is in a window of three words found twice or more.
    """
    data = text.encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            count: dict[tuple[bytes, ...], int] = {}
            for w in windows:
                count[w] = count.get(w, 0) + 1
            covered = bytearray(n)
            for i, w in enumerate(windows):
                if count[w] > 1:
                    covered[i] = covered[i + 1] = covered[i + 2] = 1
            repeated = sum(covered)
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    marks = sum(map(text.count, _MARKS))
    return n, word_chars, n_symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, marks


def with_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text; a null text counts as empty."""
    names = STATISTICS + EXTRA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in texts(batch.column("text"))]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    slim = documents.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return map_arrow(slim, run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in names))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def _matrix(columns: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios, so that the length of a text by itself is no anomaly."""
    c = {k: v.astype(float) for k, v in columns.items()}
    n, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([
        c["word_chars"] / n,
        c["n_symbols"] / n,
        c["n_dup_lines"] / lines,
        c["n_repeat_words"] / n,
        c["n_upper"] / n,
        c["n_marks"] / n,
    ])


def _average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a random tree of ``n`` rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(rows: np.ndarray, margin: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts lie up to ``margin`` outside a node's range, so that values unlike all its rows part early, also where these are equal."""
    feature, cut, left, depth = [-1], [0.0], [-1], [0.0]
    limit, waiting = math.ceil(math.log2(max(len(rows), 2))) + 4, [(0, rows, 0)]
    while waiting:
        at, own, level = waiting.pop()
        low, high = own.min(0), own.max(0)
        if level >= limit or len(own) < 2:
            depth[at] = level + _average_path(len(own))
            continue
        f = int(random.integers(own.shape[1]))
        value = random.uniform(low[f] - margin[f], high[f] + margin[f])
        below = own[:, f] < value
        feature[at], cut[at], left[at] = f, value, len(feature)
        for part in (own[below], own[~below]):
            feature.append(-1), cut.append(0.0), left.append(-1), depth.append(float(level + 1))
            if len(part):
                waiting.append((len(feature) - 1, part, level + 1))
    return np.array(feature), np.array(cut), np.array(left), np.array(depth)


def _anomaly(trees: list, x: np.ndarray) -> np.ndarray:
    """0 to 1, higher: shorter paths."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, cut, left, depth in trees:
        at = np.zeros(len(x), int)
        active = rows
        while active.size:
            node = at[active]
            inner = left[node] >= 0
            active, node = active[inner], node[inner]
            at[active] = left[node] + (x[active, feature[node]] >= cut[node])
        total += depth[at]
    return 2.0 ** (-total / (max(len(trees), 1) * max(_average_path(TREE_ROWS), 1e-9)))


def fit(stats: DataFrame, labels: DataFrame) -> ForestModel:
    """Forest and threshold from the labelled rows that pass the base rules.

    A tree is grown on ``TREE_ROWS`` good rows, as the method asks; they are drawn from about as many good rows as all trees
    take, those with the least hash. The spread of the ratios and the counts behind the threshold are those of all labelled rows.
    Without labelled good rows no tree is grown and the threshold is above every score, so nothing is rejected.
    """
    chosen = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    chosen = stage(chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")), "rule-labels")
    names, ratios = STATISTICS + EXTRA, [f"x{k}" for k in range(RATIOS)]
    joined = stats.where(~base_failed()).join(F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen, "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix({c: batch.column(c).to_numpy(zero_copy_only=False) for c in names})
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("quality"), *map(pa.array, x.T)], ["order", "quality", *ratios])

    kinds = "order bigint, quality int, " + ", ".join(f"{x} double" for x in ratios)
    rows = stage(map_arrow(joined.select(F.xxhash64("doc_id").alias("order"), "quality", *names), cut, kinds), "rule-labelled")
    spread = rows.agg(F.coalesce(F.sum("quality"), F.lit(0)), *(F.stddev_pop(x) for x in ratios)).first()
    n_good = spread[0]
    if not n_good:
        return ForestModel([], 2.0)
    # by a bound of the hash, so that no task sorts them all
    bound = -(1 << 63) + (1 << 64) * min(TREES * TREE_ROWS, n_good) // n_good - 1
    good_rows = rows.where("quality = 1").drop("quality")
    drawn = good_rows.where(F.col("order") <= F.lit(bound)).collect() or good_rows.limit(TREE_ROWS).collect()  # few ids, repeated often
    normal = np.array(sorted(map(tuple, drawn)), float)[:, 1:]
    random = np.random.default_rng(SEED)
    margin = MARGIN * np.array(spread[1:], float)
    trees = [_grow(normal[random.integers(0, len(normal), TREE_ROWS)], margin, random) for _ in range(TREES)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = _anomaly(trees, np.column_stack([batch.column(x).to_numpy() for x in ratios]))
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(np.floor(a * CUTS).astype(np.int64))], ["quality", "cell"])

    counted = map_arrow(rows, score, "quality int, cell bigint").groupBy("cell").agg(F.sum("quality"), F.count(F.lit(1))).collect()
    cells, good, all_ = np.array(sorted(map(tuple, counted)), np.int64).T
    bad = all_ - good
    # a cut above a cell lets it pass; of the cuts that let enough good rows pass, the one with the most rejected bad and kept good rows
    kept, caught = np.cumsum(good) / n_good, 1 - np.cumsum(bad) / max(bad.sum(), 1)
    enough = np.flatnonzero(kept >= GOOD_KEPT)
    best = enough[np.argmax((kept + caught)[enough])] if bad.any() else enough[0]
    return ForestModel(trees, float((cells[best] + 1) / CUTS))


def judge(stats: DataFrame, model: ForestModel) -> DataFrame:
    """``stats`` with anomaly (double), base_failed and kept."""
    names = STATISTICS + EXTRA
    schema = stats.withColumn("anomaly", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix({c: batch.column(c).to_numpy(zero_copy_only=False) for c in names})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_anomaly(model.trees, x))], [*batch.schema.names, "anomaly"])

    out = map_arrow(stats, run, schema).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(model.threshold)))


def quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): the statistics, anomaly, base_failed and kept.

    Null ids stay; repeated rows are judged each. The statistics of all rows are written out once, since fitting and
    judging both read them.
    """
    stats = stage(with_statistics(documents), "rule-statistics")
    return judge(stats, fit(stats, labels))
