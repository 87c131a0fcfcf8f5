"""Exact dedup by Patricia tries: every distinct text has an owner, the row with the smallest identifier.

Every task puts the full bytes of its texts into a compressed radix trie whose terminal nodes hold the smallest identifier
and the number of rows; so copies meet before anything is shuffled. A trie that outgrows its budget spills its heaviest
subtree: the terminals below it become records and the subtree is forgotten. The records are then dealt by length and
content hash, and the tries of one length and hash tell equal bytes from different ones. Keys with many records (a text
that stands in nearly every task) are first merged in groups of tasks, so that no task reads all records of a hot text.
Rows find their owner through the number of the node that they were put in, not through their text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from deedlink.llm.common import map_arrow, stage

#: Bytes of labels and nodes that a trie holds before it spills a subtree.
TRIE_BYTES = 48_000_000
#: Counted for a node beside its label.
NODE_BYTES = 400
#: Records of one key that one task merges; keys with more are merged in groups of tasks first.
FAN_IN = 256
#: Hexadecimal digits of the content hash by which records are dealt.
HASH_DIGITS = 16
#: Node and row numbers: the task's number is above these bits.
TASK_BITS = 34
BATCH_BYTES, BATCH_ROWS = 4_000_000, 5_000

Owner = tuple  # (identifier is null, identifier, place)


class Node:
    """A node of the trie: the bytes that lead to it, its children by first byte, its terminal if a text ends here."""

    __slots__ = ("label", "children", "terminal", "weight")

    def __init__(self, label: bytes):
        self.label, self.children, self.terminal, self.weight = label, {}, None, len(label) + NODE_BYTES


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of ``a`` and ``b[start:]``."""
    low, high = 0, min(len(a), len(b) - start)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[start + low : start + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Compressed radix trie over byte strings; terminals are lists ``[node number, owner, rows, note]``."""

    def __init__(self):
        self.root = Node(b"")

    def terminal(self, text: bytes, make: Callable[[], list]) -> list:
        """The terminal of ``text``, made by ``make`` where there is none."""
        node, at, path = self.root, 0, [self.root]
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = Node(text[at:])
                node.children[text[at]] = child
                self._grow(path, child.weight)
                path.append(child)
                node, at = child, len(text)
                break
            if not text.startswith(child.label, at):
                shared = common_prefix(child.label, text, at)
                upper = Node(child.label[:shared])
                child.label = child.label[shared:]
                child.weight -= shared
                upper.children[child.label[0]] = child
                upper.weight += child.weight
                node.children[text[at]] = upper
                self._grow(path, NODE_BYTES)
                child = upper
            path.append(child)
            node, at = child, at + len(child.label)
        if node.terminal is None:
            node.terminal = make()
        return node.terminal

    @staticmethod
    def _grow(path: list[Node], by: int) -> None:
        for node in path:
            node.weight += by

    def walk(self, node: Node | None = None, above: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """Texts and terminals below a node."""
        waiting = [(self.root if node is None else node, above)]
        while waiting:
            node, above = waiting.pop()
            text = above + node.label
            if node.terminal is not None:
                yield text, node.terminal
            waiting.extend((c, text) for c in node.children.values())

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Cut off the heaviest subtree and return its terminals.

        The way goes down to the heaviest child while that holds more than half of the trie, so that what stays is at
        most half of it.
        """
        path, above = [self.root], b""
        limit = self.root.weight // 2
        while path[-1].children:
            heaviest = max(path[-1].children.values(), key=lambda n: n.weight)
            if len(path) > 1 and heaviest.weight < limit:
                break
            above += path[-1].label
            path.append(heaviest)
        subtree = path.pop()
        if not path:  # the empty text alone
            yield from self.walk()
            self.root = Node(b"")
            return
        first = subtree.label[0]
        yield from self.walk(subtree, above)
        del path[-1].children[first]
        self._grow(path, -subtree.weight)


def _owner(identifier, place: int) -> Owner:
    return (identifier is None, 0 if identifier is None else identifier, place)


class _Out:
    """Rows gathered into batches of bounded bytes."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size
        if self.bytes > BATCH_BYTES or len(self.rows) >= BATCH_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
            self.rows, self.bytes = [], 0


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _local_owners(schema: pa.Schema, trie_bytes: int):
    """Rows in; rows with their node's number, and one record per terminal, out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << TASK_BITS
        trie, out, nodes, place = Trie(), _Out(schema), base, base

        def records(found):
            for text, (number, (null, identifier, first), rows, (length, digest)) in found:
                yield from out.add((number, None if null else identifier, first, rows, length, digest, text), len(text) + 64)

        for batch in batches:
            identifiers, data, digests = batch.columns
            for identifier, text, digest in zip(identifiers.to_pylist(), data, digests.to_pylist()):
                text = text.as_py()
                terminal = trie.terminal(text, lambda: [None, None, 0, None])
                owner = _owner(identifier, place)
                if terminal[0] is None:
                    terminal[:] = [nodes, owner, 1, (len(text), digest)]
                    nodes += 1
                else:
                    terminal[1] = min(terminal[1], owner)
                    terminal[2] += 1
                yield from out.add((terminal[0], identifier, place, None, None, digest, None), 100)
                place += 1
                while trie.root.weight > trie_bytes:
                    yield from records(trie.spill())
        yield from records(trie.walk())
        yield from out.flush()

    return run


def _merged(schema: pa.Schema, with_text: bool, digits: int):
    """Records sorted by their key in; every record's representative with owner and rows of all its copies out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, trie, key = _Out(schema), Trie(), None

        def finished():
            for text, (number, (null, identifier, place), rows, (length, digest, members)) in trie.walk():
                best = (number, None if null else identifier, place, rows)
                yield from out.add((number, *best, length, digest, text if with_text else None), len(text) + 100)
                for member in members:
                    yield from out.add((member, *best, length, digest, None), 100)

        for batch in batches:
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns)}
            narrow = [columns[n].to_pylist() for n in ("node", "owner", "place", "rows", "length", "digest", "part")]
            for number, identifier, place, rows, length, digest, part, text in zip(*narrow, columns["text"]):
                if (length, digest[:digits], part) != key:
                    yield from finished()
                    trie, key = Trie(), (length, digest[:digits], part)
                terminal = trie.terminal(text.as_py(), lambda: [None, None, 0, None])
                owner = _owner(identifier, place)
                if terminal[0] is None:
                    terminal[:] = [number, owner, rows, (length, digest, [])]
                else:
                    terminal[3][2].append(number)
                    terminal[1] = min(terminal[1], owner)
                    terminal[2] += rows
        yield from finished()
        yield from out.flush()

    return run


def _merge(records: DataFrame, part: Column, kind: T.DataType, with_text: bool) -> DataFrame:
    """Records merged by length, hash and ``part``: ``node``, its representative, and the merged record's fields.

    ``with_text``: the representative's record has the text, so that it can be merged again.
    """
    schema = T.StructType(
        [T.StructField("node", T.LongType()), T.StructField("kept_node", T.LongType()), T.StructField("owner", kind)]
        + [T.StructField(n, T.LongType()) for n in ("place", "rows", "length")]
        + [T.StructField("digest", T.StringType()), T.StructField("text", T.BinaryType())]
    )
    key = ["length", "prefix", "part"]
    dealt = records.withColumn("part", part.cast("long")).withColumn("prefix", F.substring("digest", 1, HASH_DIGITS))
    dealt = dealt.repartition(*key).sortWithinPartitions(*key).drop("prefix")
    return map_arrow(dealt, _merged(_arrow(schema), with_text, HASH_DIGITS), schema)


def normalised(text: Column) -> Column:
    """``text`` with every run of white space replaced by one space; null gives the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def owners(docs: DataFrame, id: str = "doc_id", text: str = "text", trie_bytes: int = TRIE_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical byte for byte after :func:`normalised`; null is the empty text, and all empty
    texts are one group. ``keep_id`` is the smallest identifier of the group, null only if all are null; ``kept`` holds for
    exactly one row of a group: of rows that repeat the smallest identifier, the one read first. Other columns are
    not read, so that their names do not matter. An empty table gives no rows. A text of any length is one byte string;
    one that is longer than the trie's budget is spilled at once.
    """
    identifier = docs.schema[id].dataType
    read = docs.select(F.col(id).alias("id"), normalised(F.col(text)).cast("binary").alias("text"))
    read = read.select("id", "text", F.sha2("text", 256).alias("digest"))
    schema = T.StructType(
        [T.StructField("node", T.LongType()), T.StructField("owner", identifier), T.StructField("place", T.LongType())]
        + [T.StructField("rows", T.LongType()), T.StructField("length", T.LongType()), T.StructField("digest", T.StringType())]
        + [T.StructField("text", T.BinaryType())]
    )
    local = stage(map_arrow(read, _local_owners(_arrow(schema), trie_bytes), schema), "trie-local")
    rows = local.where(F.col("rows").isNull()).select("node", F.col("owner").alias("id"), F.col("place").alias("own_place"), "digest")
    records, step = local.where(F.col("rows").isNotNull()), 0
    tasks = records.agg(F.max(F.shiftright("node", TASK_BITS))).head()[0] or 0
    while fan_in**step <= tasks:
        # texts are not read for this: counts by key only
        prefix = F.substring("digest", 1, HASH_DIGITS)
        often = records.groupBy("length", prefix.alias("prefix")).agg(F.count("*").alias("n")).where(F.col("n") > fan_in).drop("n")
        often = stage(often, "trie-often")
        if often.isEmpty():
            break
        step += 1
        marked = records.withColumn("prefix", prefix)
        hot = marked.join(often, ["length", "prefix"], "left_semi").drop("prefix")
        group = F.floor(F.shiftright("node", TASK_BITS) / F.lit(fan_in**step))
        merged = stage(_merge(hot, group, identifier, True), f"trie-merged-{step}")
        rows = rows.join(merged.select("node", "kept_node"), "node", "left")
        rows = rows.withColumn("node", F.coalesce("kept_node", "node")).drop("kept_node")
        rest = marked.join(often, ["length", "prefix"], "left_anti").drop("prefix")
        records = rest.unionByName(merged.where(F.col("text").isNotNull()).select(*rest.columns))
    final = _merge(records, F.lit(0), identifier, False).select("node", "owner", "place", F.col("rows").alias("group_size"))
    found = rows.join(final, "node")
    return found.select(
        F.col("id").alias(id), F.col("owner").alias("keep_id"), "group_size",
        (F.col("own_place") == F.col("place")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


OWNERS_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS kept, sha256(text) AS text_sha256
FROM t WINDOW g AS (PARTITION BY text)
"""
