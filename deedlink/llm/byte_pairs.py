"""Byte-level BPE as a transducer over bytes, and streaming decoding through a UTF-8 state machine.

Every prefix of a piece has one encoding, and the encodings of all prefixes form a tree: a prefix hangs below the one
that lacks its last token. A token may follow another exactly if merging the two tokens' bytes gives these two again.
The live prefixes are those from which a longer token can still grow. A state of the transducer is the list of live
prefixes with their last token and the tokens they do not share; what all of them share is emitted at once, so output
lags by no more than a token's length. States and arcs are made when first met and remembered up to a bound.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from deedlink.llm.common import map_arrow, memory, texts

#: States that a worker remembers (about 2 KB each with the pieces and pairs that go with them); emptied when full.
REMEMBERED_STATES = 200_000
#: Pieces and pairs of tokens that are remembered for a state.
PIECES_A_STATE, PAIRS_A_STATE = 2, 4
#: Tokens from which on the rows encoded so far are handed over; a worker holds no more of them than this and a text's.
HELD_TOKENS = 200_000


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file (lines of a base64 token and its rank), read by Spark; its size is that of the vocabulary."""
    lines = spark.read.text(path if "://" in path else f"file://{path}").collect()
    return {base64.b64decode(token): int(rank) for token, rank in (r[0].split() for r in lines if r[0].strip())}


class Transducer:
    """Encodes pieces of bytes by merge ranks."""

    def __init__(self, ranks: dict[bytes, int], states: int = REMEMBERED_STATES):
        self.most_states, self.most_pieces, self.most_pairs = states, states * PIECES_A_STATE, states * PAIRS_A_STATE
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the ranks lack single bytes: {missing[:5]}")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        # prefixes of tokens as numbers from 0, the empty one: number of the prefix << 8 | byte -> number; by number: token or -1, whether it grows on
        self._next: dict[int, int] = {}
        self._token, self._grows = array("i", [-1]), bytearray(1)
        for token, rank in ranks.items():
            at = 0
            for byte in token:
                self._grows[at] = 1
                key = at << 8 | byte
                at = self._next.setdefault(key, len(self._grows))
                if at == len(self._grows):
                    self._token.append(-1)
                    self._grows.append(0)
            self._token[at] = rank
        self._ends: dict[int, tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]] = {}
        self._pairs: dict[int, bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        # a live prefix: number of the bytes since its end, its last token, its tokens that other live prefixes lack
        self._names: dict[tuple, int] = {((0, -1, ()),): 0}
        self._lives: list[tuple] = [((0, -1, ()),)]
        self._arcs: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merged(self, data: bytes, below: int = 1 << 40) -> list[int]:
        """Merges of a rank less than ``below``, the plain way; only asked for single tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] >= below:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def _edges(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """The parts of a token that touch its left and its right end while it is merged, each with the rank that uses it up."""
        known = self._ends.get(token)
        if known is None:
            data, parts = self.tokens[token], []
            if len(data) > 1:
                parts = self.merged(data, token)
            left = [(data, 1 << 40)]
            right = [(data, 1 << 40)]
            if len(parts) == 2:
                left += [(d, min(r, token)) for d, r in self._edges(parts[0])[0]]
                right += [(d, min(r, token)) for d, r in self._edges(parts[1])[1]]
            known = self._ends[token] = left, right
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging both tokens' bytes gives them again: no merge over their border may come before the ones beside it."""
        known = self._pairs.get(left << 32 | right)
        if known is None:
            if len(self._pairs) >= self.most_pairs:
                self._pairs.clear()
            known, rank_of = True, self.ranks.get
            for a, used_a in self._edges(left)[1]:
                for b, used_b in self._edges(right)[0]:
                    # of two equal ranks the one further to the left is merged first
                    rank = rank_of(a + b)
                    if rank is not None and rank < used_a and rank <= used_b:
                        known = False
            self._pairs[left << 32 | right] = known
        return known

    def _arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The arc for ``byte``: next state and emitted tokens."""
        lives, end, grow, pairs = [], None, self._next.get, self._pairs.get
        token_of, grows = self._token, self._grows
        for since, last, own in self._lives[state]:
            since = grow(since << 8 | byte)
            if since is None:
                continue
            token = token_of[since]
            if grows[since]:
                lives.append((since, last, own))
            if token >= 0 and end is None:
                fits = last < 0 or pairs(last << 32 | token)
                if fits or fits is None and self.may_follow(last, token):
                    end = (0, token, own + (token,))
        lives.append(end)
        # tokens that all share lead to one prefix, so they can go out: those that least and greatest share
        least = end[2]
        greatest = least
        for live in lives:
            own = live[2]
            if own < least:
                least = own
            elif own > greatest:
                greatest = own
        shared = 0
        for x, y in zip(least, greatest):
            if x != y:
                break
            shared += 1
        live = tuple([(since, last, own[shared:]) for since, last, own in lives]) if shared else tuple(lives)
        name = self._names.get(live)
        if name is None:
            name = self._names[live] = len(self._lives)
            self._lives.append(live)
            self._arcs.append({})
        arc = self._arcs[state][byte] = (name, least[:shared])
        return arc

    def encode_piece(self, piece: bytes) -> list[int]:
        if len(self._lives) > self.most_states:
            self._reset()
        state, out = 0, []
        for byte in piece:
            arc = self._arcs[state].get(byte) or self._arc(state, byte)
            state = arc[0]
            if arc[1]:
                out += arc[1]
        out += self._lives[state][-1][2]  # the prefix that ends here
        return out

    def encode(self, pieces: Iterable[str]) -> list[int]:
        known, out = self._pieces, []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                data = piece.encode("utf-8")
                whole = self.ranks.get(data)
                ids = (whole,) if whole is not None else tuple(self.encode_piece(data))
                if len(data) <= 64:  # longer pieces hardly come back
                    if len(known) >= self.most_pieces:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


class Utf8Machine:
    """Turns bytes into text as soon as a character is complete; malformed parts give U+FFFD.

    A state is (bytes still to come, least and greatest next byte, bits so far). Runs of bytes that are met again
    (tokens) are looked up instead of being walked.
    """

    START = (0, 0x80, 0xBF, 0)

    def __init__(self) -> None:
        self._states = {self.START: 0}
        self._known: list[dict[int, tuple[int, str]]] = [{}]
        self._list = [self.START]

    @classmethod
    def step(cls, state: tuple[int, int, int, int], byte: int) -> tuple[tuple[int, int, int, int], str]:
        wait, low, high, bits = state
        if wait:
            if low <= byte <= high:
                bits = bits << 6 | byte & 0x3F
                return (cls.START, chr(bits)) if wait == 1 else ((wait - 1, 0x80, 0xBF, bits), "")
            after, out = cls.step(cls.START, byte)
            return after, "�" + out
        if byte < 0x80:
            return cls.START, chr(byte)
        if 0xC2 <= byte <= 0xDF:
            return (1, 0x80, 0xBF, byte & 0x1F), ""
        if 0xE0 <= byte <= 0xEF:
            return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF, byte & 0x0F), ""
        if 0xF0 <= byte <= 0xF4:
            return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF, byte & 0x07), ""
        return cls.START, "�"

    def _walk(self, at: int, token: int, data: bytes) -> tuple[int, str]:
        state, out = self._list[at], []
        for byte in data:
            state, text = self.step(state, byte)
            out.append(text)
        if state not in self._states:
            self._states[state] = len(self._list)
            self._list.append(state)
            self._known.append({})
        found = self._known[at][token] = (self._states[state], "".join(out))
        return found

    def decode(self, ids: Iterable[int], tokens: dict[int, bytes]) -> Iterator[str]:
        """Text as it becomes complete, token by token; an unfinished character at the end gives U+FFFD."""
        at = 0
        for token in ids:
            at, text = self._known[at].get(token) or self._walk(at, token, tokens[token])
            yield text
        if at:
            yield "�"


_loaded: dict[tuple[int, int], tuple[Transducer, Utf8Machine]] = memory(__name__)


def _loaded_once(ranks: dict[bytes, int], key: int, states: int) -> tuple[Transducer, Utf8Machine]:
    """A worker keeps the transducer of the last vocabulary over its tasks, until one of another operator comes."""
    if (key, states) not in _loaded:
        _loaded.clear()
        _loaded[key, states] = Transducer(ranks, states), Utf8Machine()
    return _loaded[key, states]


#: Columns that can be asked for besides doc_id.
COLUMNS = {"ids": "array<int>", "decoded": "string", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def tokens(documents: DataFrame, ranks: dict[bytes, int], pattern: str, columns: list[str], states: int = REMEMBERED_STATES) -> DataFrame:
    """Per row of ``documents``: doc_id and ``columns`` of ids, decoded (text of the ids), n_tokens, ids_sha256 and decoded_sha256.

    Every match of ``pattern`` is encoded by itself and there are no special tokens. ids_sha256: of ids as little-endian 32-bit
    numbers; decoded_sha256: of the decoded text in UTF-8. Null texts count as empty, which have no ids; null
    ids and repeated rows stay. ``states`` bounds what a worker remembers from task to task; fewer take longer.
    """
    slim = documents.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} {COLUMNS[c]}" for c in columns)
    return map_arrow(slim, _runner(documents.sparkSession, ranks, pattern, columns, states), schema)


def token_digests(documents: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``documents``."""
    return tokens(documents, ranks, pattern, ["n_tokens", "ids_sha256", "decoded_sha256"])


def _runner(spark: SparkSession, ranks: dict[bytes, int], pattern: str, columns: list[str], states: int):
    shared = spark.sparkContext.broadcast(ranks)  # bounded by the vocabulary
    key = hash(tuple(sorted(ranks.items())))
    kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, machine = _loaded_once(shared.value, key, states)
        find = regex.compile(pattern).findall
        gc.disable()  # what a worker remembers has no cycles; going through it again and again takes half the time
        for batch in batches:
            start, held, out = 0, 0, {c: [] for c in columns}
            for k, text in enumerate(texts(batch.column("text")), 1):
                ids = coder.encode(find(text))
                numbers, decoded = np.array(ids, "<u4"), "".join(machine.decode(ids, coder.tokens))
                made = {"ids": lambda: numbers.astype(np.int32), "decoded": lambda: decoded, "n_tokens": lambda: len(ids)}
                made |= {"ids_sha256": lambda: hashlib.sha256(numbers.tobytes()).hexdigest()}
                made |= {"decoded_sha256": lambda: hashlib.sha256(decoded.encode("utf-8")).hexdigest()}
                for c in columns:
                    out[c].append(made[c]())
                held += len(ids)
                if held >= HELD_TOKENS or k == batch.num_rows:
                    arrays = [pa.array(out[c], kinds.get(c, pa.string())) for c in columns]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, k - start), *arrays], ["doc_id", *columns])
                    start, held, out = k, 0, {c: [] for c in columns}
        gc.enable()

    return run
