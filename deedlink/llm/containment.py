"""Benchmark decontamination: MinHash containment search in partitions by size, checked exactly.

Test items are partitioned by their number of shingles, each partition twice as wide as the one before. For a
partition of items of at most s shingles, the text of the documents is looked at through windows of 2 s shingles, s
apart, so that every run of s shingles lies in one of them, and the Jaccard similarity of an item and its window is
bounded below whatever the length of the document. A window and an item that share one of ``FUNCTIONS`` MinHash values are
a candidate: an item contained to 0.8 in one run is missed with a chance of about 1e-6. Least values of small
blocks are merged to those of larger ones, so that all partitions cost little more than the narrowest. The containment
of candidates is then counted on the shingle set of the whole document.

Items of one to four words have no shingle of five; such an item counts as one shingle, all its words, and is contained where
these stand one after the other. All runs of that many words are compared, so none is missed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deedlink.llm.common import SHINGLE_WORDS, map_arrow, mix, shingle_sequence, stage, texts, word_hashes

THRESHOLD = 0.8
FUNCTIONS = 64
#: Shingles of the items in the narrowest partition, at most.
NARROWEST = 4
#: Items and bytes of their texts that are held in memory in one pass over the documents.
PASS_ITEMS = 20_000
PASS_BYTES = 32_000_000
#: Contaminated documents whose ids are sent to all executors, at most; beyond that they are joined by a shuffle.
BROADCAST_IDS = 400_000
#: Shingles hashed at a time.
CHUNK = 8_192
SEED = 11


def _functions() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    a, b = (random.integers(0, 1 << 32, (FUNCTIONS, 1), np.uint64).astype(np.uint32) for _ in range(2))
    return a | np.uint32(1), b


_A, _B = _functions()
_MOST = np.uint32(0xFFFFFFFF)


class Partition(NamedTuple):
    """Items of one range of sizes: block width, sorted keys (function, MinHash value) with their items, marks of low bits."""

    width: int
    keys: np.ndarray
    items: np.ndarray
    marks: np.ndarray


class Items(NamedTuple):
    """Items with their shingles and partitions; short ones by the hash of their words, in the order of hashes."""

    ids: list
    shingles: list[np.ndarray]
    partitions: list[Partition]
    short_hashes: np.ndarray
    short_ids: list
    short_widths: list[int]


def _hashed(shingles: np.ndarray) -> np.ndarray:
    """(FUNCTIONS, n) values."""
    return (shingles >> np.uint64(32)).astype(np.uint32)[None, :] * _A + _B


def prepare(rows: list[tuple[object, str | None]]) -> Items:
    """Items (id, text) by partition, those of one to four words apart. Items without a word are contained nowhere."""
    ids, sets, by_width, short = [], [], defaultdict(list), []
    for item_id, text in rows:
        n_words = len((text or "").split())
        if 0 < n_words < SHINGLE_WORDS:
            short.append((int(shingle_sequence(text)[0]), item_id, n_words))
            continue
        own = np.unique(shingle_sequence(text or "", short=False))
        if len(own):
            width = NARROWEST
            while width < len(own):
                width *= 2
            by_width[width].append(len(ids))
            ids.append(item_id), sets.append(own)
    partitions = []
    for width, members in sorted(by_width.items()):
        least = np.stack([_hashed(sets[i]).min(1) for i in members])
        keys = (np.arange(FUNCTIONS, dtype=np.uint64)[None, :] << np.uint64(32) | least.astype(np.uint64)).ravel()
        items = np.repeat(np.array(members), FUNCTIONS)
        order = np.argsort(keys, kind="stable")
        marks = np.zeros((FUNCTIONS, 1 << 16), bool)
        marks[np.tile(np.arange(FUNCTIONS), len(members)), (least & np.uint32(0xFFFF)).ravel()] = True
        partitions.append(Partition(width, keys[order], items[order], marks))
    short.sort(key=lambda item: item[0])
    hashes = np.array([h for h, *_ in short], np.uint64)
    return Items(ids, sets, partitions, hashes, [i for _, i, _ in short], sorted({n for *_, n in short}))


def short_items(items: Items, text: str) -> list:
    """Ids of the items of one to four words whose words stand in ``text`` one after the other."""
    if not items.short_widths:
        return []
    words, found = word_hashes(text.lower().split()), []
    for width in items.short_widths:
        if len(words) < width:
            break
        runs = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            runs = mix(runs * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(runs)])
        runs = np.unique(runs)
        first, last = np.searchsorted(items.short_hashes, runs, "left"), np.searchsorted(items.short_hashes, runs, "right")
        for i, j in zip(first[last > first].tolist(), last[last > first].tolist()):
            found += items.short_ids[i:j]
    return found


def _narrow_blocks(sequence: np.ndarray) -> np.ndarray:
    """(FUNCTIONS, blocks) least values of blocks of ``NARROWEST`` shingles."""
    out = []
    for start in range(0, len(sequence), CHUNK):
        part = sequence[start : start + CHUNK]
        least = _hashed(part[::NARROWEST])
        for k in range(1, NARROWEST):
            values = _hashed(part[k::NARROWEST])
            np.minimum(least[:, : values.shape[1]], values, out=least[:, : values.shape[1]])
        out.append(least)
    return np.concatenate(out, axis=1)


def candidates(sequence: np.ndarray, partitions: list[Partition]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, items) of the windows of ``sequence`` that share a MinHash value with items."""
    blocks, width = _narrow_blocks(sequence), NARROWEST
    rows = np.arange(FUNCTIONS, dtype=np.uint32)[:, None] << np.uint32(16)
    for partition in partitions:
        while width < partition.width:
            if blocks.shape[1] % 2:
                blocks = np.pad(blocks, ((0, 0), (0, 1)), constant_values=_MOST)
            blocks, width = np.minimum(blocks[:, ::2], blocks[:, 1::2]), width * 2
        windows = np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks
        function, window = np.nonzero(partition.marks.take(windows & np.uint32(0xFFFF) | rows))
        if not len(window):
            continue
        keys = function.astype(np.uint64) << np.uint64(32) | windows[function, window].astype(np.uint64)
        first, last = np.searchsorted(partition.keys, keys, "left"), np.searchsorted(partition.keys, keys, "right")
        hit = np.flatnonzero(last > first)
        for w, i, j in zip(window[hit].tolist(), first[hit].tolist(), last[hit].tolist()):
            yield w * width, (w + 2) * width, partition.items[i:j]


def _search(items: Items, threshold: float, doc_ids: pa.Array, documents: list[np.ndarray], short: list[list]) -> pa.RecordBatch:
    found: dict[int, set[int]] = defaultdict(set)
    ends = np.cumsum([len(d) for d in documents])
    if len(ends) and ends[-1]:
        for start, end, own in candidates(np.concatenate(documents), items.partitions):
            for d in range(int(np.searchsorted(ends, start, "right")), min(int(np.searchsorted(ends, end - 1, "right")), len(ends) - 1) + 1):
                found[d].update(own.tolist())
    rows: tuple[list, list, list, list] = ([], [], [], [])
    for d, own in sorted(found.items()):
        whole = np.unique(documents[d])
        for i in sorted(own):
            item = items.shingles[i]
            at = np.minimum(np.searchsorted(whole, item), len(whole) - 1)
            shared = int((whole[at] == item).sum()) if len(whole) else 0
            if shared >= threshold * len(item) - 1e-9:
                for column, value in zip(rows, (d, items.ids[i], shared, len(item))):
                    column.append(value)
    for d, own in enumerate(short):
        for item_id in own:
            for column, value in zip(rows, (d, item_id, 1, 1)):
                column.append(value)
    doc = doc_ids.take(pa.array(rows[0], pa.int64()))
    shared, size = pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64())
    return pa.RecordBatch.from_arrays([doc, pa.array(rows[1], pa.int64()), shared, size], ["doc_id", "item_id", "n_shared", "n_shingles"])


def contained_items(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, item_id, n_shared, n_shingles): items of which a document contains ``threshold`` of the shingles or more.

    ``documents``: doc_id, text; ``benchmark``: item_id, text. All items are searched for, a bounded number in one pass
    over the documents. An item of one to four words counts as one shingle. Null texts count as empty: they contain
    nothing and are contained nowhere. Repeated documents and items give a row each.
    """
    total, size = benchmark.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-total // PASS_ITEMS), -(-size // PASS_BYTES))
    slim = documents.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, n_shared bigint, n_shingles bigint"

    def one(number: int) -> DataFrame:
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number)
        shared = slim.sparkSession.sparkContext.broadcast(prepare([tuple(r) for r in part.select(F.col("item_id").cast("long"), "text").collect()]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc_ids, start, held, own, short = batch.column("doc_id"), 0, 0, [], []
                for k, text in enumerate(texts(batch.column("text"))):
                    own.append(shingle_sequence(text, short=False))
                    short.append(short_items(shared.value, text))
                    held += len(own[-1])
                    if held >= 4 * CHUNK or k == batch.num_rows - 1:
                        yield _search(shared.value, threshold, doc_ids.slice(start, len(own)), own, short)
                        start, held, own, short = k + 1, 0, [], []

        return map_arrow(slim, run, schema)

    out = one(0)
    for number in range(1, passes):
        out = out.unionAll(one(number))
    return out


def without_contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that contain no item; a row whose doc_id is null is kept."""
    found = stage(contained_items(documents, benchmark, threshold).select("doc_id").distinct(), "contaminated")
    small = found.count() <= BROADCAST_IDS
    return documents.join(F.broadcast(found) if small else found, "doc_id", "left_anti")
