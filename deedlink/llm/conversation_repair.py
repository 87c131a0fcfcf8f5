"""Conversation repair over an automaton of role and fault signatures that share their suffixes.

A conversation is reduced to its signature, one letter a row: the role's initial, in upper case where the text is
truncated, or ``d`` where the row has to go. Distinct signatures are sorted by their reversal and dealt by range, so that
those with a common end lie side by side; a task walks them as the automaton that is minimised from the end and computes the
least cost to go and the best audit suffix once per node and state of the role grammar, for all conversations. Nodes whose
costs differ by a constant share their moves. The audits then meet the texts in a second pass that streams every
conversation into its hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from deedlink.llm.common import map_arrow, stage

#: White space of the contract: the characters 9 to 13 and 32.
WHITE = " \t\n\x0b\x0c\r"
#: Turns whose rows may be gathered into one piece of a signature.
PIECE_TURNS = 4_096
BATCH_BYTES, BATCH_ROWS = 4_000_000, 5_000

# States of the grammar (s?(ua)+)?: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row.
#: State after an inserted or re-roled row, and its role.
FILLED = (2, 2, 3, 2)
FILLED_ROLE = ("user", "user", "assistant", "user")
#: State after a row that is kept.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEGAL_PAIRS = {"su", "ua", "au"}
#: Costs of the edits, and of a truncated row that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Inserts that end a conversation in each state, their cost, and the order of these suffixes.
END = ("", "II", "I", "")
END_COSTS = tuple(INSERT * len(s) for s in END)
END_ORDER = (0, 2, 1, 0)


@lru_cache(maxsize=100_000)
def moves(letter: str, costs: tuple[int, ...], order: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...], tuple[tuple[str, int], ...]]:
    """A node from its successor: ``costs`` to go and ``order`` of the best audit suffixes, both by state.

    Returns the same for the node, and by state the edits at this row (inserts, then the row's own) and the next state.
    Two runs of edits at one row are never prefixes of each other, so the order of audits is that of the runs and, where
    these are equal, that of the suffixes behind them.
    """
    best = []
    for start in range(4):
        found, state = [], start
        for inserts in range(3):  # two inserts reach every state that any number of them reaches
            if inserts:
                state = FILLED[state]
            run, paid = "I" * inserts, INSERT * inserts
            found.append((paid + DELETE + costs[state], run + "D", order[state], state))
            if letter != "d":
                extra = TRUNCATED if letter.isupper() else 0
                after = KEPT.get((state, letter.lower()))
                if after is not None:
                    found.append((paid + extra + costs[after], run + "K", order[after], after))
                after = FILLED[state]
                found.append((paid + REROLE + extra + costs[after], run + "R", order[after], after))
        best.append(min(found))
    ranks = {x: i for i, x in enumerate(sorted({b[1:3] for b in best}))}
    return tuple(b[0] for b in best), tuple(ranks[b[1:3]] for b in best), tuple((b[1], b[3]) for b in best)


class Suffixes:
    """The way from the end of all signatures to the one looked at; nodes left of a branch are forgotten."""

    def __init__(self):
        self.letters: list[str] = []
        self.nodes: list[tuple] = [(0, END_COSTS, END_ORDER, None)]

    def audit(self, signature: str) -> tuple[int, str]:
        """Least cost and best audit of a signature; nodes that it shares with the one before are not made again."""
        shared = 0
        for mine, letter in zip(self.letters, reversed(signature)):
            if mine != letter:
                break
            shared += 1
        del self.letters[shared:], self.nodes[shared + 1 :]
        for letter in signature[: len(signature) - shared][::-1]:
            base, costs, order, _ = self.nodes[-1]
            costs, order, edits = moves(letter, costs, order)
            least = min(costs)
            self.letters.append(letter)
            self.nodes.append((base + least, tuple(c - least for c in costs), order, edits))
        state, runs = 0, []
        for _, _, _, edits in reversed(self.nodes[1:]):
            run, state = edits[state]
            runs.append(run)
        return self.nodes[-1][0] + self.nodes[-1][1][0], "".join(runs) + END[state]


class Replay:
    """The repaired rows of an audit, hashed one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.rows = audit, 0, 0, hashlib.sha256(), 0

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.rows else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.rows += 1

    def _filled(self, text: str) -> None:
        self._put(FILLED_ROLE[self.state], text)
        self.state = FILLED[self.state]

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._filled("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self._filled(text)
        elif edit == "K":
            self._put(role, text)
            self.state = KEPT[self.state, role[:1]]

    def digest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batches(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, given with their sizes, in batches of bounded bytes."""
    held, total = [], 0
    for row, size in rows:
        held.append(row)
        total += size
        if total > BATCH_BYTES or len(held) == BATCH_ROWS:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _pieces(schema: pa.Schema):
    """Sorted rows in; one row per conversation and piece out."""

    def rows(batches):
        key, held = None, None
        for batch in batches:
            for conv, piece, turn, initial, copies, blank, truncated, later in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or (conv, piece) != key:
                    if held is not None:
                        yield finished(key, held)
                    key, held = (conv, piece), {"letters": [], "turns": 0, "low": None, "high": None, "counts": [0, 0, 0, 0], "first": initial, "last": None}
                counts = held["counts"]
                if turn is not None and turn != held["high"]:
                    held["turns"] += 1
                    held["low"], held["high"] = turn if held["low"] is None else held["low"], turn
                known = initial if initial in ("s", "u", "a") else "x"
                if blank:
                    counts[0] += copies
                    held["letters"].append("d" * copies)
                else:
                    counts[1] += copies - 1 + later
                    counts[2] += truncated and not later
                    held["letters"].append(("d" if later else known.upper() if truncated else known) + "d" * (copies - 1))
                # copies follow each other with one role, which is never legal
                counts[3] += copies - 1 + (held["last"] is not None and held["last"] + initial not in LEGAL_PAIRS)
                held["last"] = initial
        if held is not None:
            yield finished(key, held)

    def finished(key, held):
        letters = "".join(held["letters"])
        return (*key, letters, held["turns"], held["low"], held["high"], *held["counts"], held["first"], held["last"]), len(letters) + 100

    return lambda batches: _batches(rows(batches), schema)


def _audits(schema: pa.Schema):
    def rows(batches):
        suffixes = Suffixes()
        for batch in batches:
            for signature in batch.column(0).to_pylist():
                cost, audit = suffixes.audit(signature)
                yield (signature, cost, audit), 2 * len(audit) + 50

    return lambda batches: _batches(rows(batches), schema)


def _hashes(schema: pa.Schema, width: int):
    """A conversation's verdict, then its rows in order, in; the verdict with the hash of what is repaired out."""

    def rows(batches):
        verdict, replay = None, None
        for batch in batches:
            columns = [c for c in batch.columns]
            narrow = [c.to_pylist() for c in columns[:-1]]
            for i, text in enumerate(columns[-1]):
                if narrow[0][i] == 0:
                    if replay is not None:
                        yield (*verdict, replay.digest()), len(replay.audit) + 200
                    verdict = tuple(c[i] for c in narrow[2 : 2 + width])
                    replay = Replay(verdict[-1])
                else:
                    replay.row(narrow[1][i], text.as_py())
        if replay is not None:
            yield (*verdict, replay.digest()), len(replay.audit) + 200

    return lambda batches: _batches(rows(batches), schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by the checksum of conversation and turn.

    A null counts as one space, in the checksum too; conv_id and turn themselves stay null. Of 20 classes of rows, 0 is
    dropped, 1 loses its text, 2 its full stops, question and exclamation marks, 3 is repeated, 4 becomes the user's.
    """
    space = F.lit(" ")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name) % 20).alias("damage")
    ).where("damage <> 0")
    copies = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Faults and cheapest repair of every conversation: one row per ``conv_id`` of ``rows`` and ``conversations``.

    ``rows``: conv_id, turn, role, text (null: one space). A conversation's rows are taken by turn, null first; rows
    of one turn by role, then by the SHA-256 of their text, so that equal rows are neighbours. A null conv_id is a
    conversation. A row is blank without a character other than white space, else a duplicate if its role and text were
    seen before, else truncated if its last such character does not end a sentence. An empty role has no initial: it is never
    legal and never kept. Returns ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``
    and ``repaired_sha256``; a conversation without rows has zeros, an empty audit and the hash of nothing. Empty tables
    give no rows; other columns are not read. Texts of any length are streamed; one letter a row is held in memory.
    """
    conv, turn = rows.schema["conv_id"].dataType, rows.schema["turn"].dataType
    space = F.lit(" ")
    read = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    read = read.withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    left = F.rtrim(F.col("text"), F.lit(WHITE))
    ended = F.right(left, F.lit(1)).isin(".", "!", "?")
    narrow = read.select("conv_id", "turn", "role", "digest", (left == "").alias("blank"), (~ended).alias("truncated"))
    # equal rows of a turn become one before anything is shuffled
    single = narrow.groupBy(*narrow.columns).agg(F.count("*").alias("copies"))
    first = single.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    same = F.col("s.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("s.role") == F.col("f.role")) & (F.col("s.digest") == F.col("f.digest"))
    marked = single.alias("s").join(first.alias("f"), same).select("s.*", (~F.col("turn").eqNullSafe(F.col("f.first.turn"))).alias("later"))

    piece = F.floor(F.col("turn") / PIECE_TURNS)
    dealt = marked.withColumn("piece", piece).repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "turn", "role", "digest")
    dealt = dealt.select("conv_id", "piece", "turn", F.substring("role", 1, 1).alias("initial"), "copies", "blank", "truncated", F.col("later").cast("int"))
    long, string = T.LongType(), T.StringType()
    fields = [("conv_id", conv), ("piece", long), ("letters", string), ("turns", long), ("low", turn), ("high", turn)]
    fields += [(n, long) for n in ("blank", "duplicate", "truncated", "illegal")] + [("initial", string), ("last", string)]
    schema = T.StructType([T.StructField(*f) for f in fields])
    pieces = map_arrow(dealt, _pieces(_arrow(schema)), schema)
    every = rows.select("conv_id") if conversations is None else rows.select("conv_id").union(conversations.select("conv_id"))
    pieces = pieces.unionByName(every.distinct(), allowMissingColumns=True)

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("long")

    ends = F.struct("piece", "letters", "initial", "last")
    found = pieces.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("letters").isNotNull(), ends))).alias("parts"),
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).cast("long").alias("gaps"),
        *(total(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal")),
    )
    borders = F.zip_with(
        F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))),
        lambda a, b: (~F.concat(a["last"], b["initial"]).isin(*sorted(LEGAL_PAIRS))).cast("long"),
    )
    found = found.select(
        "conv_id", F.array_join(F.transform("parts", lambda x: x["letters"]), "").alias("signature"), "gaps", "blank", "duplicate", "truncated",
        (F.col("illegal") + F.aggregate(borders, F.lit(0).cast("long"), lambda s, x: s + x)).alias("illegal"),
    )
    found = stage(found, "repair-signatures")

    schema = T.StructType([T.StructField("signature", string), T.StructField("cost", long), T.StructField("audit", string)])
    ordered = found.select("signature").distinct().withColumn("reversed", F.reverse("signature"))
    ordered = ordered.repartitionByRange("reversed").sortWithinPartitions("reversed").select("signature")
    audits = map_arrow(ordered, _audits(_arrow(schema)), schema)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    verdicts = found.join(audits, "signature").select(*names)

    # the verdict of a conversation comes first, its rows follow it
    empty = {f.name: F.lit(None).cast(f.dataType) for f in verdicts.schema if f.name != "conv_id"}
    both = verdicts.withColumns({"kind": F.lit(0), "role": F.lit(None).cast("string"), "turn": F.lit(None).cast(turn), "digest": F.lit(None).cast("binary"), "text": F.lit(None).cast("string")})
    both = both.unionByName(read.withColumns({"kind": F.lit(1), **empty}))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    schema = T.StructType([*(verdicts.schema[n] for n in names), T.StructField("repaired_sha256", string)])
    return map_arrow(both.select("kind", "role", *names, "text"), _hashes(_arrow(schema), len(names)), schema)
