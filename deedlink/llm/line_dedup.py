"""Near-duplicate lines by a segment-partition edit join, with DataFrame operations only.

Equal lines are reduced to one first. If two lines are within t edits, then cutting the shorter into t + 1 segments leaves one
segment untouched, and it lies in the longer line at a place that the edits before and behind it bound. So each line is indexed by
its segments, and probes the indexes of its own and of shorter lengths with the few substrings that can match.
A segment that many lines share (a prefix of addresses, the frame of a table) says little: its lines are cut again without it,
since what is left of two such lines is within t edits too, and so on until few lines share a segment or hardly anything is left.
Lines that share a segment with more than a few meet only where the pairs of neighbouring letters of the whole lines allow it, too.
Candidates are verified by a bit-parallel edit distance in a band of 2 t + 1 diagonals. Lines too short for that are linked only
to equal ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from deedlink.llm.common import few, stage
from deedlink.llm.components import components

MAX_EDITS = 2
#: Lines of fewer characters are not compared: none.
MIN_CHARS = 0
#: Lines of fewer characters stay in texts, however often they occur: a few edits turn them into quite different lines, and
#: equal ones are menus, brackets and table cells. A parameter of ``without_repeated_lines``; its effect is in the README.
MIN_DROPPED_CHARS = 20
#: Lines that may share a segment before they are told apart by what is left of them.
SHARED_LINES = 200
#: Lines that may share a segment before their pairs of neighbouring letters are compared; few enough that these pass as candidates.
FEW_LINES = 10
#: Bits for the pairs of neighbouring letters of a line, in words of 64.
PAIR_BITS = 256
#: Frequent letters whose counts tell most candidates apart before they are verified.
LETTERS = "etaoinsr"
#: Line hashes that are sent to all executors, at most; beyond that they are joined by a shuffle.
BROADCAST_LINES = 400_000
#: Dropped lines whose places are sent to all executors, at most; beyond that the texts are shuffled to them.
BROADCAST_DROPPED = 1_000_000
_LINES_OF_A_DOCUMENT = 1 << 31
_NO_PAIRS = "cast(null as array<bigint>)"


def segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` (from 0) of ``edits + 1``; the last ones are longer by one where it must be."""
    parts = edits + 1
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    start = base * i + F.greatest(F.lit(0), longer - (parts - i))
    return start, base + F.when(F.lit(i) >= parts - longer, 1).otherwise(0)


def _hash(length: Column, i: int, text: Column, *more: Column) -> Column:
    return F.xxhash64(length.cast("int"), F.lit(i), text, *more)


def index_keys(line: Column, length: Column, edits: int) -> list[Column]:
    """A hash of length, number and text of each segment."""
    return [key for key, _, _ in _index(line, length, edits)]


def _index(line: Column, length: Column, edits: int, *more: Column) -> list[tuple[Column, Column, Column]]:
    """Key, start (from 0) and length of each segment; ``more`` goes into the key."""
    cuts = [segment(length, i, edits) for i in range(edits + 1)]
    return [(_hash(length, i, F.substring(line, start + 1, size), *more), start, size) for i, (start, size) in enumerate(cuts)]


def probe_keys(line: Column, length: Column, edits: int) -> list[Column]:
    """Hashes of the substrings that can equal a segment of a line that is up to ``edits`` shorter; null where there is none.

    Segments of the line itself are left out: those of lines of the same length meet among themselves.
    """
    found = [_probe(line, length, edits, shorter) for shorter in range(edits + 1)]
    return [F.when(length - shorter >= near_chars(edits), key) for shorter, keys in enumerate(found) for key, _, _, same in keys if not same]


def _probe(line: Column, length: Column, edits: int, shorter: int, *more: Column) -> list[tuple[Column, Column, Column, bool]]:
    """Key, start, length of the substrings that can equal a segment of a line that is ``shorter`` by so many characters.

    A segment with i segments before it may be moved by i edits counted from the left, and by as many as there are behind it
    counted from the right, since otherwise another segment is untouched. The last entry tells the line's own segments.
    """
    out, other = [], length - shorter
    for i in range(edits + 1):
        start, size = segment(other, i, edits)
        behind = edits - i
        for move in range(max(-i, shorter - behind), min(i, shorter + behind) + 1):
            fits = (start + move >= 0) & (start + move + size <= length)
            key = F.when(fits, _hash(other, i, F.substring(line, start + move + 1, size), *more))
            out.append((key, start + move, size, shorter == 0 and move == 0))
    return out


def letter_counts(line: Column) -> Column:
    """How often each of ``LETTERS`` occurs, eight bits for each.

    The letters are gone through by a higher-order function: beside the many hashes of a line, a term for each of them made the
    generated method too long for the JVM to compile it.
    """
    size, letters = F.octet_length(line), F.array(*map(F.lit, LETTERS))
    count = lambda letter: ((size - F.octet_length(F.replace(line, letter, F.lit("")))) % 256).cast("long")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda counts, letter: F.shiftleft(counts, 8).bitwiseOR(count(letter)))


def counts_within(a: Column, b: Column, edits: int) -> Column:
    """Whether letter counts are as close as ``edits`` edits leave them: an edit changes two counts by one at most."""
    total = F.lit(0)
    for k in range(len(LETTERS)):
        gap = F.abs(F.shiftrightunsigned(a, 8 * k).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(b, 8 * k).bitwiseAND(F.lit(255)))
        total = total + F.least(gap, 256 - gap)
    return total <= 2 * edits


def pair_parities(line: str) -> Column:
    """For each of ``PAIR_BITS`` hashes, whether an odd number of pairs of neighbouring characters in column ``line`` have it.

    The last character is paired with the end, so the order of the characters counts, other than in ``letter_counts``.
    """
    words = [
        f"aggregate(pairs, 0L, (bits, h) -> if(shiftrightunsigned(h, 6) % {PAIR_BITS // 64} = {w}, bits ^ shiftleft(1L, cast(h & 63 as int)), bits))"
        for w in range(PAIR_BITS // 64)
    ]
    pairs = _let("chars", f"split({line}, '')", "transform(chars, (c, i) -> xxhash64(c, get(chars, i + 1)))")
    return F.expr(_let("pairs", pairs, f"array({', '.join(words)})"))


def pairs_within(a: Column, b: Column, edits: int) -> Column:
    """Whether pair parities are as close as ``edits`` edits leave them: an edit takes two pairs away and adds two at most."""
    apart = [F.bit_count(F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))) for w in range(PAIR_BITS // 64)]
    return reduce(lambda total, x: total + x, apart) <= 4 * edits


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` in which ``name`` stands for ``value``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def within_edits(a: str, b: str, edits: int) -> Column:
    """Whether the texts in columns ``a`` and ``b`` are within ``edits`` edits.

    The equal parts at both ends are stripped first, which leaves the distance as it is. What is left differs at both ends, so two
    edits lie there, and of the rest of one text, cut into ``edits - 1`` parts, one at least stands in the other unless they are too
    far apart. Then bit k of a word stands for
    row j - edits + k of column j of the distance table. A column's step takes a fixed number of operations on words, whatever
    the width of the band; the distance is followed along the lowest diagonal of the band and then up the last column.
    """
    widths = "transform(sequence(0, bits), k -> shiftleft(1, bits - k))"
    head = f"aggregate({widths}, 0, (p, w) -> if(p + w <= least and substring({a}, p + 1, w) = substring({b}, p + 1, w), p + w, p))"
    tail = (
        f"aggregate({widths}, 0, (q, w) -> if(p0 + q + w <= least and"
        f" substring({a}, length({a}) - q - w + 1, w) = substring({b}, length({b}) - q - w + 1, w), q + w, q))"
    )
    middle = [f"substring({x}, p0 + 1, length({x}) - p0 - q0)" for x in (a, b)]
    body = _let("x", middle[0], _let("y", middle[1], _banded("x", "y", edits)))
    for name, value in (("q0", tail), ("p0", head), ("bits", "cast(log2(least + 1) as int) + 1"), ("least", f"least(length({a}), length({b}))")):
        body = _let(name, value, body)
    return F.expr(f"case when {a} = {b} then true when abs(length({a}) - length({b})) > {edits} then false else {body} end")


def _may_be_near(a: str, b: str, edits: int) -> str:
    """SQL for a test that texts of more than ``edits`` characters pass which differ at both ends and are within ``edits`` edits."""
    parts, inner = edits - 1, f"(length({a}) - 2)"
    cut = lambda i: f"cast({inner} * {i} div {parts} as int)"
    held = [f"contains({b}, substring({a}, 2 + {cut(i)}, {cut(i + 1)} - {cut(i)}))" for i in range(parts)]
    return " or ".join(held) or "false"


def _banded(a: str, b: str, edits: int) -> str:
    """SQL for the bit-parallel distance test of two texts without a common start or end."""
    width = 2 * edits + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    m, n = f"length({a})", f"length({b})"
    same = " + ".join(f"if(get(ca, j + {edits + 1 - width + k}) <=> get(cb, j) and j + {edits + 1 - width + k} >= 0, {1 << k}, 0)" for k in range(width))
    # one step: words d0, hp, hn from the vertical differences vp, vn
    d0 = f"((((eq & s.vp) + s.vp) ^ s.vp) | eq | s.vn) & {full}"
    row = f"(j - ({m} - {edits}))"
    distance = (
        f"s.d + if({row} < 0, if((d0 & {top}) = 0, 1, 0),"
        f" if((hp & shiftright({top >> 1}, {row})) <> 0, 1, 0) - if((hn & shiftright({top >> 1}, {row})) <> 0, 1, 0))"
    )
    step = f"named_struct('vp', (hn | ~(shiftright(d0, 1) | hp)) & {full}, 'vn', shiftright(d0, 1) & hp, 'd', {distance})"
    for name, value in (("hn", "d0 & s.vp"), ("hp", f"(s.vn | ~(d0 | s.vp)) & {full}"), ("d0", d0), ("eq", same)):
        step = _let(name, value, step)
    start = f"named_struct('vp', {full ^ ((1 << (width - edits - 1)) - 1)}, 'vn', 0, 'd', {edits})"
    # once even a descent along the rest of the last column leads to too great a distance, nothing more is looked at
    steps = f"aggregate(sequence(0, {n} - 1), {start}, (s, j) -> if(s.d > {2 * edits} + {n} - {m}, s, {step})).d <= {edits}"
    walk = _let("ca", f"split({a}, '')", _let("cb", f"split({b}, '')", steps))
    return f"if({m} <= {edits} or {n} <= {edits}, levenshtein({a}, {b}) <= {edits}, if({_may_be_near(a, b, edits)}, {walk}, false))"


def _lines(documents: DataFrame) -> DataFrame:
    """doc_id, line_no, line, chars, h1, h2 (128 bits that stand for a line), place (order of lines over all documents)."""
    rows = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    if isinstance(documents.schema["doc_id"].dataType, T.IntegralType):
        place = F.col("doc_id").cast("decimal(38,0)") * F.lit(_LINES_OF_A_DOCUMENT).cast("decimal(12,0)") + F.col("line_no")
        place = place.cast("decimal(38,0)")
    else:
        place = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "line_no"))
    return rows.select(
        "doc_id", "line_no", "line", F.length("line").alias("chars"), F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(1), "line").alias("h2"), place.alias("place"),
    )


def near_chars(edits: int) -> int:
    """The least length of a line that is linked to lines that differ; shorter ones have little besides what may be edited."""
    return 2 * edits + 2


def _compared(min_chars: int) -> Column:
    return F.col("doc_id").isNotNull() & (F.col("chars") >= min_chars)


def _edit_links(lines: DataFrame, distinct: DataFrame, edits: int) -> DataFrame:
    """Pairs of different lines (a1, a2, b1, b2: their hashes) within ``edits`` edits."""
    distinct = distinct.where("letters is not null")  # they are null for lines that have only exact links
    own = [c for c in distinct.columns if c.startswith("i_")]
    probes = [c for c in distinct.columns if c.startswith("p_")]
    index = distinct.select("h1", "letters", F.explode(F.array(*own)).alias("key"))
    probe = distinct.select("h1", "letters", F.explode(F.array(*probes)).alias("key")).where("key is not null")
    shared = _shared(index, min(FEW_LINES, SHARED_LINES))
    if shared is None:
        index, probe = (rows.withColumn("pairs", F.expr(_NO_PAIRS)) for rows in (index, probe))
    else:
        index, probe = _told_apart(lines, index, probe, shared, edits)
    pairs = stage(_meet(index, probe, edits).distinct(), "line-candidates")
    held = _texts(lines, pairs.select(F.col("a").alias("h1")).union(pairs.select("b")))
    left, right = (held.select(F.col("h1").alias(x), F.col("h2").alias(f"{x}2"), F.col("line").alias(f"{x}_line")) for x in "ab")
    met = pairs.join(left, "a").join(right, "b")
    return met.where(within_edits("a_line", "b_line", edits)).select(F.col("a").alias("a1"), "a2", F.col("b").alias("b1"), "b2")


def _texts(lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """h1, h2, line of the different lines with one of the first ``hashes``."""
    wanted = stage(hashes.distinct(), "line-wanted")
    count = wanted.count()
    small = count <= BROADCAST_LINES
    held = lines.select("h1", "h2", "line").join(F.broadcast(wanted) if small else wanted, "h1", "left_semi")
    return stage(few(held.groupBy("h1", "h2").agg(F.first("line").alias("line")), count), "line-texts")


def _shared(index: DataFrame, lines: int) -> DataFrame | None:
    """key, n of the keys that more than so many indexed lines share; None without any."""
    found = stage(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > lines), "line-shared")
    return None if found.isEmpty() else found


def _told_apart(lines: DataFrame, index: DataFrame, probe: DataFrame, shared: DataFrame, edits: int) -> list[DataFrame]:
    """``index`` and ``probe`` with pair parities (null where few lines share a key), and with rests instead of what too many share."""
    hashes = [rows.join(shared, "key", "left_semi").select("h1") for rows in (index, probe)]
    held = _texts(lines, hashes[0].union(hashes[1]))
    held = stage(held.select("h1", letter_counts(F.col("line")).alias("letters"), pair_parities("line").alias("pairs"), "line"), "line-pairs")
    often, some = shared.where(F.col("n") > SHARED_LINES), shared.where(F.col("n") <= SHARED_LINES)
    # keys of rests are hashes of their own, so all meet in one join
    rests = [] if often.isEmpty() else _rests_of_often(held, often, edits)
    out = []
    for k, rows in enumerate((index, probe)):
        paired = rows.join(some, "key", "left_semi").join(held.select("h1", "pairs"), "h1")
        parts = [_other(rows, shared).withColumn("pairs", F.expr(_NO_PAIRS)), paired, *(rest[k] for rest in rests)]
        out.append(reduce(DataFrame.unionByName, parts))
    return out


def _other(rows: DataFrame, often: DataFrame) -> DataFrame:
    return rows.join(often, "key", "left_anti").select(rows.columns)


def _meet(index: DataFrame, probe: DataFrame, edits: int) -> DataFrame:
    """Pairs a < b of lines that share a key: two of the index, or one of the index and a probe, each maybe more than once."""
    a = index.select(F.col("h1").alias("a"), F.col("letters").alias("a_letters"), F.col("pairs").alias("a_pairs"), "key")
    both = index.withColumn("probing", F.lit(False)).unionByName(probe.withColumn("probing", F.lit(True)))
    b = both.select(F.col("h1").alias("b"), F.col("letters").alias("b_letters"), F.col("pairs").alias("b_pairs"), "key", "probing")
    on = (F.col("a") < F.col("b")) | (F.col("probing") & (F.col("a") != F.col("b")))
    near = counts_within(F.col("a_letters"), F.col("b_letters"), edits) & F.coalesce(pairs_within(F.col("a_pairs"), F.col("b_pairs"), edits), F.lit(True))
    met = a.join(b, (a["key"] == b["key"]) & on & near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _rests_of_often(held: DataFrame, often: DataFrame, edits: int) -> list[tuple[DataFrame, DataFrame]]:
    """Rows of the index and probes of the lines ``held`` that share a key with many, by what is left of them without the shared segment.

    Two lines within some edits that agree in a segment are within these edits in what stands before and behind it together.
    So a key's lines are cut again without the segment, and keys that are still shared by many once more; what is left loses
    at least a third each time. When less than ``near_chars`` is left, lines meet in what remains of them after deletions.
    """
    line, chars = F.col("line"), F.length("line")
    cuts = [_cut(key, start, size, False, chars) for key, start, size in _index(line, chars, edits)]
    for shorter in range(edits + 1):
        fits = chars - shorter >= near_chars(edits)
        cuts += [_cut(F.when(fits, key), start, size, True, chars - shorter) for key, start, size, same in _probe(line, chars, edits, shorter) if not same]
    found = []
    rows, count = _left(held, cuts, often), held.count()
    while True:
        rows = stage(few(rows, count), "line-rests")
        count = rows.count()
        short = rows.where(F.col("indexed") < near_chars(edits))
        variants = short.select("h1", "letters", "pairs", "probing", F.explode(_deletions(edits)).alias("variant"), "group")
        variants = variants.select("h1", "letters", "pairs", F.xxhash64("group", "variant").alias("key"), "probing")
        found.append((variants.where("not probing").drop("probing"), variants.where("probing").drop("probing")))
        if not count:
            return found
        # the others are cut: rows of the index into segments, and all into the substrings that may equal one
        line, chars, group = F.col("line"), F.length("line"), F.col("group")
        own = [_cut(F.when(~F.col("probing"), key), start, size, False, chars) for key, start, size in _index(line, chars, edits, group)]
        other = []
        for shorter in range(edits + 1):
            fits = F.col("indexed") == chars - shorter
            for key, start, size, same in _probe(line, chars, edits, shorter, group):
                # rows of the index have met in their own segments
                other.append(_cut(F.when(fits & (F.col("probing") if same else F.lit(True)), key), start, size, True, chars - shorter))
        longer = rows.where(F.col("indexed") >= near_chars(edits))
        keyed = lambda cuts: longer.select("h1", "letters", "pairs", F.explode(F.array(*[c["key"] for c in cuts])).alias("key")).where("key is not null")
        index, probe = keyed(own), keyed(other)
        often = _shared(index, SHARED_LINES)
        if often is None:
            return [*found, (index, probe)]
        found.append((_other(index, often), _other(probe, often)))
        rows = _left(longer.select("h1", "letters", "pairs", "group", "probing", "indexed", "line"), [*own, *other], often)


def _cut(key: Column, start: Column, size: Column, probing: bool, indexed: Column) -> Column:
    """A key with its segment and the length of the indexed line that it belongs to."""
    return F.struct(key.alias("key"), start.alias("start"), size.alias("size"), F.lit(probing).alias("probe"), (indexed - size).alias("rest"))


def _left(rows: DataFrame, cuts: list[Column], often: DataFrame) -> DataFrame:
    """For each of the ``often`` keys of a line: what is left without the segment. ``indexed``: what is left of indexed lines."""
    keyed = rows.select("h1", "letters", "pairs", "line", F.inline(F.array(*cuts))).where("key is not null").join(often, "key", "left_semi")
    rest = F.expr("concat(substring(line, 1, start), substring(line, start + size + 1, length(line)))")
    return keyed.select("h1", "letters", "pairs", F.col("key").alias("group"), F.col("probe").alias("probing"), F.col("rest").alias("indexed"), rest.alias("line")).distinct()


def _deletions(edits: int) -> Column:
    """What is left of a short line after up to ``edits`` deletions; two lines within these edits have one in common."""
    found = F.array("line")
    for _ in range(edits):
        one = F.transform(found, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))))
        found = F.array_distinct(F.concat(found, F.flatten(one)))
    return found


def _dropped(links: DataFrame, places: DataFrame) -> DataFrame:
    """h1, h2 of the lines that go: those with a link to an earlier line that stays.

    ``places``: h1, h2, first. A line without an earlier linked line that is still undecided stays, and the lines linked to it
    go; this is repeated on what is left, so that the result is that of going through the lines in their order.
    """
    own, other = (places.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.struct("first", "h1", "h2").alias(f"{x}_at")) for x in "ab")
    placed = links.join(own, ["a1", "a2"]).join(other, ["b1", "b2"])
    ahead = F.col("a_at") < F.col("b_at")
    name = lambda x: F.concat_ws(":", f"{x}1", f"{x}2")
    open_ = placed.select(F.when(ahead, name("a")).otherwise(name("b")).alias("a"), F.when(ahead, name("b")).otherwise(name("a")).alias("b"))
    open_, gone, count = stage(open_, "line-order"), [], links.count()
    while count:
        stays = open_.join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone.append(stage(few(stays.select("b").distinct(), count), "line-gone"))
        left = open_.join(gone[-1], "b", "left_anti")
        open_ = stage(few(left.join(gone[-1].select(F.col("b").alias("a")), "a", "left_anti"), count), "line-order")
        count = open_.count()
    if not gone:
        return places.where("false").select("h1", "h2")
    parts = F.split("b", ":")
    return reduce(DataFrame.union, gone).select(parts[0].cast("long").alias("h1"), parts[1].cast("long").alias("h2"))


def line_classes(documents: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, line_no (from 0), class_id, n_links, kept for every line of ``documents`` (doc_id, text); lines end at line feeds.

    Two lines are linked if they are equal, or if both have ``near_chars(max_edits)`` characters or more and are within ``max_edits`` edits.
    n_links: other lines linked to this one. class_id: a hash that all lines reached over links share; null for lines of fewer than
    ``min_chars`` characters and for rows without an id, which are
    not compared. kept: false if an equal line, or a line linked to this one, stands before it by doc_id and line_no and is
    kept itself; so a line goes only where one within ``max_edits`` edits stays. Rows that repeat an id
    count as the same document. Ids are of any type that has an order. Null texts count as empty, which is one blank line.
    """
    lines = _lines(documents)
    compared = lines.where(_compared(min_chars))
    keys = {f"i_{k}": c for k, c in enumerate(index_keys(F.col("line"), F.col("chars"), max_edits))}
    keys |= {f"p_{k}": c for k, c in enumerate(probe_keys(F.col("line"), F.col("chars"), max_edits))}
    keys["letters"] = F.when(F.col("chars") >= near_chars(max_edits), letter_counts(F.col("line")))
    distinct = compared.select("h1", "h2", "place", *(c.alias(k) for k, c in keys.items())).groupBy("h1", "h2")
    distinct = stage(distinct.agg(F.count(F.lit(1)).alias("times"), F.min("place").alias("first"), *(F.max(k).alias(k) for k in keys)), "line-distinct")
    links = stage(_edit_links(compared, distinct, max_edits), "line-links")
    name = lambda x: F.concat_ws(":", f"{x}1", f"{x}2")
    roots = components(links.select(name("a").alias("a"), name("b").alias("b")))
    times = distinct.select("h1", "h2", "times", "first")
    ends = links.union(links.select("b1", "b2", "a1", "a2")).toDF("h1", "h2", "o1", "o2")
    others = times.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("times").alias("others"))
    near = ends.join(others, ["o1", "o2"]).groupBy("h1", "h2").agg(F.sum("others").alias("others"))
    several = times.withColumn("node", F.concat_ws(":", "h1", "h2")).join(roots, "node", "left").join(near, ["h1", "h2"], "left")
    several = several.where("times > 1 or root is not null").withColumn("root", F.coalesce("root", "node"))
    several = stage(several.select("h1", "h2", "root", "first", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "line-several")
    gone = _dropped(links, times).withColumn("gone", F.lit(True))
    known = several.join(gone, ["h1", "h2"], "left")
    known = known.select("h1", "h2", F.xxhash64("root").alias("class"), "n_links", F.when(F.col("gone").isNull(), F.col("first")).alias("stays"), F.lit(True).alias("several"))
    slim = lines.select("doc_id", "line_no", "place", *(F.when(_compared(min_chars), F.col(h)).alias(h) for h in ("h1", "h2")))
    return slim.join(known, ["h1", "h2"], "left").select(
        "doc_id",
        "line_no",
        F.when(F.col("h1").isNotNull(), F.coalesce("class", F.xxhash64(F.concat_ws(":", "h1", "h2")))).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("several").isNull() | F.coalesce(F.col("place") == F.col("stays"), F.lit(False))).alias("kept"),
    )


def without_repeated_lines(documents: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_DROPPED_CHARS) -> DataFrame:
    """``documents`` with the lines that ``line_classes`` doesn't keep taken out of text, and n_chars, if it is there, counted anew.

    All rows and columns stay; a document may become empty. Rows with a null id or text, and those without such lines, stay as they are.
    """
    dropped = line_classes(documents, max_edits, min_chars).where(~F.col("kept"))
    dropped = stage(dropped.groupBy("doc_id").agg(F.collect_set("line_no").alias("_dropped")), "line-dropped")
    # a few bytes for each dropped line, so their number bounds what is sent to all executors
    small = (dropped.agg(F.sum(F.size("_dropped"))).first()[0] or 0) <= BROADCAST_DROPPED
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_dropped", i)), "\n")
    text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(left)
    out = documents.join(F.broadcast(dropped) if small else dropped, "doc_id", "left").withColumn("text", text)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_dropped").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*documents.columns)
