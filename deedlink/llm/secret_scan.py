"""Secret scan: patterns, and strings that zstandard finds new although it knows their surroundings.

A candidate is a run of token characters in a sensitive context; a run with ``=`` is cut there into names and values, and the
name in front of a value belongs to its context. A candidate is compressed behind its context with a dictionary
of identifiers; the bytes it adds, by its own length, are its novelty. Words and identifiers add little, random keys
add nearly their whole entropy. One measurement is coarse, since a compressor may code a whole block in another way for a
few bytes more; so the novelty is the mean over surroundings of several widths. Candidates of high novelty are
reported besides what the patterns find; what is high is calibrated by length, so that random strings reach it with a given share.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import string
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, functions as F

from deedlink.llm.common import map_arrow, stage, texts

#: Kinds in the order in which spans with the same start are listed.
KINDS = ["assign", "access", "hex", "novel"]
LEAST = {"assign": 12, "access": 18, "hex": 16}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones need not be visited
#: What makes the characters before a candidate a sensitive context.
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)?|secret|token|api|key|auth|credential|bearer|private|AKIA", re.IGNORECASE | re.ASCII)
#: A name or a value; ``=`` belongs to it only as padding at the end of a run.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{12,}(?:={1,2}(?![A-Za-z0-9+/_.=-]))?", re.ASCII)
NAME_CHARACTERS = frozenset(string.ascii_letters + string.digits + "+/_.-")
#: Characters before a candidate, or before the name in front of it, from which a sensitive word counts, and those around it that prime the dictionary.
CONTEXT_BEFORE = 48
CONTEXT_AROUND = 256
#: Characters on either side of a candidate behind which it is compressed, one measurement each.
WIDTHS = (256, 224, 192, 160, 128, 112, 96, 80, 64, 48, 32, 24)
#: Lengths for which the least novelty is calibrated, the sorts of random strings, strings of each, and the share of them that must reach it.
LENGTHS = (12, 14, 16, 20, 24, 32, 48)
SORTS = (string.ascii_letters + string.digits, string.ascii_letters, string.digits + "ABCDEF")
CALIBRATION_STRINGS = 400
LEAST_RECALL = 0.9
#: Identifiers that prime the dictionary besides the words of the texts.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key public_key client_secret authorization bearer "
    "session user username email host port url http https localhost example config settings environment variable "
    "return function class import export default const static void string number boolean true false null none self "
    "request response header content type application json data value index length buffer error message status "
    "database connection table select insert update delete where from create index primary key foreign reference "
    "test mock sample placeholder changeme undefined required optional version name path file directory"
)
#: Labelled ids that are sent to all executors, at most.
BROADCAST_IDS = 400_000
#: Bytes that the compressor looks back, and those of a dictionary that stays in sight behind the widest surroundings: where it
#: gets out of sight, candidates seem less novel, and half of the random strings of 12 to 16 characters were missed.
LOOK_BACK_BYTES = 16_384
DICTIONARY_BYTES = LOOK_BACK_BYTES - 2 * (4 * CONTEXT_AROUND + 1)


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the pattern matches, leftmost and non-overlapping for each kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def novelty(before: str, candidate: str, after: str, compressor: zstd.ZstdCompressor) -> float:
    """Bytes that the candidate adds to its compressed surroundings, by byte of the candidate; the mean over ``WIDTHS``."""
    own = candidate.encode("utf-8", "replace")
    around = {(before[-width:] + "\n" + after[:width] + "\n").encode("utf-8", "replace") for width in WIDTHS}
    added = sum(len(compressor.compress(a + own)) - len(compressor.compress(a)) for a in around)
    return added / len(around) / max(len(own), 1)


def _primed(dictionary: bytes) -> zstd.ZstdCompressor:
    primed = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    return zstd.ZstdCompressor(level=6, dict_data=primed, write_content_size=False)


def limits(dictionary: bytes) -> list[float]:
    """Least novelty for each of ``LENGTHS``: what ``LEAST_RECALL`` of the random strings of every sort reach."""
    r, compressor = random.Random(0), _primed(dictionary)
    words, out = sorted(set(dictionary.decode("utf-8", "ignore").split())), []

    def around() -> str:
        # every second word with its letters shuffled stands for those that the dictionary lacks; every second text has numbers
        some = [r.choice(words) for _ in range(r.randrange(2, 40))]
        some = [w if k % 2 else "".join(r.sample(w, len(w))) for k, w in enumerate(some)]
        return " ".join(w + str(r.randrange(100)) for w in some)[-CONTEXT_AROUND:] if r.randrange(2) else " ".join(some)[-CONTEXT_AROUND:]

    for length in LENGTHS:
        reached = []
        for sort in SORTS:
            keys = ("".join(r.choice(sort) for _ in range(length)) for _ in range(CALIBRATION_STRINGS))
            reached.append(sorted(novelty(around(), key, around(), compressor) for key in keys)[int(CALIBRATION_STRINGS * (1 - LEAST_RECALL))])
        out.append(min(reached))
    return out


def least_novelty(candidate: str, by_length: list[float]) -> float:
    """The limit for a candidate, between those of the calibrated lengths next to its own."""
    length = len(candidate)
    k = bisect.bisect_right(LENGTHS, length)
    if k in (0, len(LENGTHS)):
        return by_length[max(k - 1, 0)]
    share = (length - LENGTHS[k - 1]) / (LENGTHS[k] - LENGTHS[k - 1])
    return by_length[k - 1] * (1 - share) + by_length[k] * share


def context_start(text: str, start: int) -> int:
    """Where the context of a candidate begins: ``CONTEXT_BEFORE`` characters before it, or before ``name=`` in front of it."""
    at = start
    while at and text[at - 1] == "=":
        at -= 1
    while at < start and at and text[at - 1] in NAME_CHARACTERS:
        at -= 1
    return max(0, at - CONTEXT_BEFORE)


def novel_spans(text: str, taken: list[tuple[int, int, str]], compressor: zstd.ZstdCompressor, by_length: list[float]) -> list[tuple[int, int, str]]:
    """Incompressible candidates in a sensitive context that no pattern has found."""
    found = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if not SENSITIVE.search(text, context_start(text, start), start):
            continue
        if any(s < end and start < e for s, e, _ in taken):
            continue
        before, after = text[max(0, start - CONTEXT_AROUND) : start], text[end : end + CONTEXT_AROUND]
        if novelty(before, m[0], after, compressor) >= least_novelty(m[0], by_length):
            found.append((start, end, "novel"))
    return found


def _dictionary(words: list[str]) -> bytes:
    """As many of ``words`` as there is room for, the first one last, then fixed identifiers: the end of a dictionary is cheapest to reach."""
    room, taken = DICTIONARY_BYTES - len(IDENTIFIERS.encode()) - 1, []
    for word in (w.encode("utf-8", "replace") for w in words):
        room -= len(word) + 1
        if room < 0:
            break
        taken.append(word)
    return b" ".join([*taken[::-1], IDENTIFIERS.encode()])


def dictionary_of(documents: DataFrame) -> bytes:
    """The most frequent words of all texts, as many as the dictionary has room for, and the fixed identifiers."""
    words = documents.select(F.explode(F.split("text", r"[^\p{L}_]+")).alias("word")).where("length(word) between 3 and 24")
    # a word of three letters and its blank take four bytes
    counted = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(DICTIONARY_BYTES // 4)
    return _dictionary([r[0] for r in counted.collect()])


def identifier_dictionary(documents: DataFrame, labels: DataFrame | None = None) -> bytes:
    """``dictionary_of`` the texts that ``labels`` names; without labels, the fixed identifiers alone."""
    if labels is None:
        return _dictionary([])
    chosen = stage(labels.where("doc_id is not null").select("doc_id").distinct(), "secret-labels")
    few_ids = chosen.count() <= BROADCAST_IDS
    return dictionary_of(documents.join(F.broadcast(chosen) if few_ids else chosen, "doc_id", "left_semi"))


def scan(documents: DataFrame, dictionary: bytes) -> DataFrame:
    """Per row of ``documents``: doc_id and spans, an array of (start, end, kind), in code points, end exclusive.

    Spans are sorted by start, then kind. Null texts count as empty and have no spans; null ids and repeated rows stay.
    """
    slim = documents.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    by_length = limits(dictionary)
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = _primed(dictionary)
        for batch in batches:
            rows = []
            for text in texts(batch.column("text")):
                base = pattern_spans(text)
                spans = sorted(base + novel_spans(text, base, compressor, by_length), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                rows.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(item))], ["doc_id", "spans"])

    return map_arrow(slim, run, f"doc_id {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>")


def digest(spans: list[tuple[int, int, str]]) -> str:
    """SHA-256 of the spans' text, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()


def with_digests(scanned: DataFrame) -> DataFrame:
    """doc_id, counts by pattern, hash of the pattern spans and all spans as text."""
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", *(count(k) for k in KINDS[:3]), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count("novel")
    )
