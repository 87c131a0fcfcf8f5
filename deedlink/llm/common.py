"""What the text operators share: staging on shared storage, words, shingles and the session's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words in a shingle.
SHINGLE_WORDS = 5
#: Words whose hash a worker remembers; the memory is emptied when full.
REMEMBERED_WORDS = 100_000
#: Bytes of rows that go to a Python worker at once where the session sets no bound: Spark's own lets a batch grow to 10,000 rows of any length
#: or many MB, which the executor and the worker then hold several times over. It changes how rows travel, not which.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20

#: Rows of a small table that a task takes; a table of many rows keeps its partitions.
TASK_ROWS = 2_000

_word_hashes: dict[str, int] = {}
_memories: dict[str, dict] = {}
_last_owner = ""


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on one machine a temporary one if unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="deedlink-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: lineage ends, lost executors cannot change it."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than its ``rows`` rows, a figure near them or above them, ask for."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def smallest(df: DataFrame, order: Column, rows: int, total: int, distinct: bool = False) -> DataFrame:
    """At most ``rows`` rows of ``df``, those with the least 64-bit hash ``order``; ``total``: a lower bound for its rows.
    ``distinct``: equal rows count once.

    Where there are many rows, all but the hashes that can be among the least are left out first, so that what is
    sorted does not grow with the number of partitions.
    """
    if total > 32 * rows:
        df = df.where(order <= F.lit(-(1 << 63) + int((1 << 64) * 8 * rows / total)))
    if distinct:
        # the hashes alone tell where the sample ends, so that no text but the sample's is shuffled
        last = df.select(order.alias("order")).distinct().orderBy("order").limit(rows).agg(F.max("order")).head()[0]
        df = df.where(order <= F.lit(last)).distinct()
    return df.orderBy(order, *df.columns).limit(rows)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session's executors."""
    context = spark.sparkContext
    if getattr(context, "_deedlink_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="deedlink-code-"), "deedlink.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._deedlink_shipped = True


def memory(owner: str) -> dict:
    """What a worker remembers from task to task for the module ``owner``; emptied once it turns to a task of another one."""
    return _memories.setdefault(owner, {})


def forget_others(owner: str) -> None:
    """A worker that turns to a task of another module gives up what it has remembered for the modules before, hashes of words too."""
    global _last_owner
    for name, other in _memories.items():
        if name != owner:
            other.clear()
    if owner != _last_owner:
        _word_hashes.clear()
        _last_owner = owner


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers, in batches of bounded bytes."""
    ship_package(df.sparkSession)
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    owner = function.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        yield from function(batches)
        pa.default_memory_pool().release_unused()  # the worker lives on, beside those of other stages

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> Iterator[str]:
    """The strings of an Arrow column; null gives the empty text."""
    for value in column:
        yield value.as_py() or ""


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words."""
    known = _word_hashes
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        pass
    if len(known) > REMEMBERED_WORDS:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sequence(text: str, short: bool = True) -> np.ndarray:
    """Hashes of the shingles of a text in their order.

    Words are runs of non-space characters of the lower-cased text. A text of one to four words has one
    shingle of all its words when ``short`` holds, otherwise none; a text without words has none.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    if n < SHINGLE_WORDS:
        if not short:
            return np.empty(0, np.uint64)
        windows, width = 1, n
    else:
        windows, width = n - SHINGLE_WORDS + 1, SHINGLE_WORDS
    total = np.full(windows, width, np.uint64)
    for k in range(width):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + windows])
    return total
