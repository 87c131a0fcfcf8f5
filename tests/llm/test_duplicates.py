"""Near duplicates of documents and lines, and leaked test items, against brute force."""

import random
import re
from collections import Counter
from functools import cache

import numpy as np
import pytest
from samples import ODD, prose
from pyspark.sql import functions as F

from deedlink.llm import components, containment, jaccard_join as jj, line_dedup as ld
from deedlink.llm.common import shingle_sequence


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_join(rows, threshold=0.8):
    """rows: (id, text); links and least id reached, by place in rows."""
    sets = [shingles(t or "") for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return [(rows[i][0], links[i], least.get(top(i)) if links[i] else rows[i][0]) for i in range(len(rows))]


def key(t):
    return tuple((x is None, x or 0) for x in t)


def test_op3_equals_brute_force(spark, small, texts, queries):
    got = [(r.doc_id, r.n_links, r.class_id) for r in queries["op3_jaccard_join"](spark, small).collect()]
    assert sorted(got) == sorted(brute_join(list(texts.items())))
    assert any(n for _, n, _ in got)


def test_jaccard_of_odd_rows(odd, empty):
    got = [(r.doc_id, r.n_links, r.class_id) for r in jj.jaccard_join(odd).collect()]
    assert sorted(got, key=key) == sorted(brute_join([(r[0], r[1]) for r in ODD]), key=key)
    assert jj.jaccard_join(empty).collect() == []


def test_large_groups_of_near_copies_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "BUCKET_ROWS", 8)
    monkeypatch.setattr(jj, "GROUP_ROWS", 8)
    base = prose(5, 150).split()
    rows = []
    for i in range(60):
        words = list(base)
        words[i * 2] = f"new{i}"
        if i % 3 == 0:
            words[(i * 2 + 60) % 150] = f"more{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[0][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_links, r.class_id) for r in jj.jaccard_join(df).collect())
    assert got == sorted(brute_join(rows))


def test_one_of_each(odd):
    left = jj.one_of_each(odd)
    assert left.columns == odd.columns
    ids = sorted((r.doc_id for r in left.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 3, 4, 5, 6, 8, 9, 10, None, None] or ids == [1, 3, 4, 5, 6, 8, 9, 10, 11, None, None]


def test_bayes_limits_are_monotone_and_lenient():
    least = jj.least_matches(0.8)
    assert least == sorted(least)
    # a pair of similarity 0.8 is hardly ever given up
    rng = np.random.default_rng(1)
    seen = rng.binomial(1, 0.8, (20_000, jj.VALUES)).cumsum(1)[:, jj.STEP - 1 :: jj.STEP]
    assert (seen < np.array(least)).any(1).mean() < 1e-3


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    r = random.Random(shape)
    edges = {"path": [(i, i + 1) for i in range(200)], "star": [(0, i) for i in range(1, 300)], "random": [(r.randrange(200), r.randrange(200)) for _ in range(150)]}[shape]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: top(x) for x in root}


def edit(r, text, k):
    s = list(text)
    for _ in range(k):
        p = r.randrange(len(s) + 1)
        kind = r.randrange(3)
        if kind == 0:
            s.insert(p, r.choice("abé🙂"))
        elif s and kind == 1:
            s.pop(min(p, len(s) - 1))
        elif s:
            s[min(p, len(s) - 1)] = r.choice("abé🙂")
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    r = random.Random(edits)
    rows = []
    for n in range(700):
        a = "".join(r.choice("abé🙂") for _ in range(r.randrange(45) if n < 500 else r.randrange(90, 400)))
        rows.append((a, edit(r, a, r.randrange(5))))
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where(ld.within_edits("a", "b", edits) != (F.levenshtein("a", "b") <= edits)).collect() == []


def distance(a, b):
    """Edit distance; equal ends don't matter."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute_lines(rows, edits, min_chars):
    """rows: (id, text); (id, line number): (links, kept)."""
    lines = [(i, k, x) for i, t in rows if i is not None for k, x in enumerate((t or "").split("\n")) if len(x) >= min_chars]
    root, links = list(range(len(lines))), [0] * len(lines)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (_, _, a) in enumerate(lines):
        for m in range(n):
            b = lines[m][2]
            if a == b or abs(len(a) - len(b)) <= edits and len(a) < 200 and distance(a, b) <= edits:
                links[n] += 1
                links[m] += 1
                x, y = top(n), top(m)
                root[max(x, y)] = min(x, y)
    stays = {}
    for i, k, a in sorted(lines):
        stays[i, k] = not any(stays[j, m] and (a == b or abs(len(a) - len(b)) <= edits and len(a) < 200 and distance(a, b) <= edits) for j, m, b in lines if (j, m) in stays)
    return {(i, k): (links[n], stays[i, k]) for n, (i, k, _) in enumerate(lines)}


@pytest.mark.parametrize("edits", [1, 2])
def test_line_classes_equal_brute_force(spark, edits):
    r = random.Random(edits)
    bases = ["".join(r.choice("abcdefé ") for _ in range(r.randrange(18, 60))) for _ in range(12)]
    rows = [(i, "\n".join(edit(r, r.choice(bases), r.randrange(4)) for _ in range(r.randrange(6)))) for i in range(40)]
    rows += [(None, bases[0]), (50, None), (51, ""), (52, bases[0] + "\n" + bases[0])]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, line string")
    got = {(x.doc_id, x.line_no): x for x in ld.line_classes(df, edits).collect() if x.class_id is not None}
    want = brute_lines(rows, edits, ld.MIN_CHARS)
    assert {k: (v.n_links, v.kept) for k, v in got.items()} == want
    assert any(n for n, _ in want.values())


@pytest.mark.parametrize("edits", [1, 2])
def test_short_lines_have_classes(spark, edits):
    r = random.Random(edits)
    bases = ["".join(r.choice("abcé ") for _ in range(r.randrange(1, 22))) for _ in range(12)] + ["", "Menu", "------", "Home | About"]
    rows = [(i, "\n".join(edit(r, r.choice(bases), r.randrange(3)) for _ in range(r.randrange(8)))) for i in range(40)]
    rows += [(50, "Menu\nMenu\nMenus\n\nHome | About"), (51, "Home | about\n")]
    lines = [(i, k, x) for i, t in rows for k, x in enumerate(t.split("\n"))]
    near = lambda a, b: a == b or min(len(a), len(b)) >= ld.near_chars(edits) and distance(a, b) <= edits
    links = {(i, k): sum(near(x, y) for *_, y in lines) - 1 for i, k, x in lines}
    got = {(x.doc_id, x.line_no): x for x in ld.line_classes(spark.createDataFrame(rows, "doc_id long, text string"), edits).collect()}
    assert {k: v.n_links for k, v in got.items()} == links
    for i, k, x in lines:
        for j, m, y in lines:
            if near(x, y):
                assert got[i, k].class_id == got[j, m].class_id is not None
    assert (got[50, 0].class_id == got[50, 2].class_id) == (edits == 1)
    left = {x.doc_id: x.text for x in ld.without_repeated_lines(spark.createDataFrame([(1, "Menu\nMenu"), (2, "Menu")], "doc_id long, text string"), edits).collect()}
    assert left == {1: "Menu\nMenu", 2: "Menu"}


def test_line_keys_are_compiled(spark, capsys):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter."""
    lines = spark.range(3).select(F.repeat(F.col("id").cast("string"), 40).alias("line")).withColumn("chars", F.length("line"))
    keys = [*ld.index_keys(F.col("line"), F.col("chars"), 2), *ld.probe_keys(F.col("line"), F.col("chars"), 2), ld.letter_counts(F.col("line"))]
    lines.select(*keys).explain("codegen")
    assert all(int(n) < 8000 for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_what_may_be_near(spark, edits):
    """No near pair is told apart before its distance is found, and most others are."""
    r, rows = random.Random(edits), []
    for _ in range(600):
        a = "".join(r.choice("abcdefgh é") for _ in range(r.randrange(2 * edits + 2, 60)))
        b = edit(r, a, r.randrange(1, 2 * edits + 3))
        while a and b and a[0] == b[0]:
            a, b = a[1:], b[1:]
        while a and b and a[-1] == b[-1]:
            a, b = a[:-1], b[:-1]
        if min(len(a), len(b)) > edits:
            rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string").withColumn("may", F.expr(ld._may_be_near("a", "b", edits)))
    near = F.levenshtein("a", "b") <= edits
    assert df.where(near & ~F.col("may")).collect() == []
    assert df.where(~near & ~F.col("may")).count() > 20


def test_lines_of_often_segments_equal_brute_force(spark, monkeypatch):
    """Lines that share a segment with many, and others, meet in one join."""
    monkeypatch.setattr(ld, "SHARED_LINES", 3)
    r = random.Random(8)
    bases = ["Price list of the year " + "".join(r.choice("abcdef") for _ in range(12)) for _ in range(10)] + ["".join(r.choice("ghijkl ") for _ in range(25)) for _ in range(6)]
    rows = [(i, "\n".join(edit(r, r.choice(bases), r.randrange(4)) for _ in range(4))) for i in range(30)]
    got = {(x.doc_id, x.line_no): (x.n_links, x.kept) for x in ld.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows, 2, 0)


@pytest.mark.parametrize("shared", [200, 30])
def test_near_copies_are_told_apart_before_they_are_rows(spark, monkeypatch, shared):
    """Lines with one more word each of the same letters: every two share a segment, none are linked."""
    monkeypatch.setattr(ld, "SHARED_LINES", shared)
    met, meet = [], ld._meet
    monkeypatch.setattr(ld, "_meet", lambda *a: met.append(meet(*a)) or met[-1])
    r = random.Random(12)
    base, lines = "".join(r.choice("abcdefgh  ") for _ in range(300)), set()
    while len(lines) < 150:
        at = r.randrange(301)
        lines.add(base[:at] + "".join(r.sample("jklmqvwxyz", 10)) + base[at:])
    rows = [(i, x) for i, x in enumerate([*sorted(lines), base + "jk", base + "kj"])]
    got = ld.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.n_links for x in got} == {i: int(i >= 150) for i, _ in rows}
    assert met[0].count() < 20


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_pair_parities_let_all_near_lines_pass(spark, edits):
    r, rows = random.Random(edits), []
    for k in range(400):
        a = "".join(r.choice("abcdefghijklmnopqrstuvwxyz é😀") for _ in range(r.randrange(1, 90)))
        rows.append((a, edit(r, a, r.randrange(edits + 1)) if k % 2 else "".join(r.sample(a, len(a)))))
    df = spark.createDataFrame(rows, "a string, b string")
    df = df.select(ld.pairs_within(ld.pair_parities("a"), ld.pair_parities("b"), edits).alias("may"), (F.levenshtein("a", "b") <= edits).alias("near"))
    counts = {(x.may, x.near): x["count"] for x in df.groupBy("may", "near").count().collect()}
    assert (False, True) not in counts and counts[True, True] >= 200
    assert counts[False, False] > 140


def test_small_graphs_take_few_tasks(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        found = components.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"))
        assert len(found.inputFiles()) == 1 and {x.root for x in found.collect()} == {0}
    finally:
        spark.conf.set(key, before)


def test_op8_equals_brute_force(spark, small, texts, queries):
    rows = queries["op8_line_dedup"](spark, small).collect()
    assert len(rows) == sum(t.count("\n") + 1 for t in texts.values())
    every = [(i, k, x) for i in sorted(texts) for k, x in enumerate(texts[i].split("\n"))]
    count, first = {}, {}
    for i, k, x in every:
        count[x] = count.get(x, 0) + 1
        first.setdefault(x, (i, k))
    # lines within two edits share one of the texts that two deletions leave; long ones are compared by length and letters
    near, by_length = {}, {}
    for x in count:
        by_length.setdefault(len(x), []).append(x)
    letters = {x: {c: x.count(c) for c in set(x)} for x in count}
    for x in count:
        if len(x) < ld.near_chars(2):
            continue
        for n in (len(x), len(x) + 1, len(x) + 2):
            for y in by_length.get(n, ()):
                if (n, x) < (len(x), y) or n > len(x):
                    gap = sum(abs(letters[x].get(c, 0) - letters[y].get(c, 0)) for c in {*letters[x], *letters[y]})
                    if gap <= 4 and x != y and distance(x, y) <= 2:
                        near.setdefault(x, set()).add(y)
                        near.setdefault(y, set()).add(x)
    kept = set()
    for x in first:  # in the order of first places
        if not near.get(x, set()) & kept:
            kept.add(x)
    for r in rows:
        x = texts[r.doc_id].split("\n")[r.line_no]
        assert r.n_links == count[x] - 1 + sum(count[y] for y in near.get(x, ()))
        assert r.kept == (x in kept and first[x] == (r.doc_id, r.line_no))


@pytest.mark.parametrize("shared", [1, 200])
def test_lines_that_share_segments_with_many(spark, monkeypatch, shared):
    monkeypatch.setattr(ld, "SHARED_LINES", shared)
    r = random.Random(shared)
    prefix = "https://example.org/some/long/path/to/what/there/is/"
    lines = [prefix + "".join(r.choice("0123456789abcdef") for _ in range(30)) for _ in range(60)]
    lines += [f"Item number {i:04d} of the catalogue of parts" for i in range(0, 2000, 7)]
    lines += [edit(r, x, r.randrange(1, 4)) for x in lines[:60]] + [f"{i:06d}" for i in range(0, 3000, 41)] + [prefix, prefix + "ab", "x" * 40, "x" * 42, "x" * 41 + "y"]
    r.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 7 : i * 7 + 7])) for i in range(len(lines) // 7 + 1)]
    letters = {x: Counter(x) for x in lines}
    near = cache(lambda a, b: a == b or abs(len(a) - len(b)) <= 2 and (letters[a] - letters[b]).total() <= 2 and distance(a, b) <= 2)
    every = [(i, k, x) for i, t in rows for k, x in enumerate(t.split("\n")) if x]
    links = {(i, k): sum(near(x, y) for *_, y in every) - 1 for i, k, x in every}
    stays, kept = {}, []
    for i, k, x in every:
        stays[i, k] = not any(near(x, y) for y in kept)
        kept += [x] if stays[i, k] else []
    got = {(x.doc_id, x.line_no): (x.n_links, x.kept) for x in ld.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v for k, v in got.items() if k in links} == {k: (n, stays[k]) for k, n in links.items()}


def test_line_classes_of_text_ids(spark):
    rows = [("b", "a line of some length here"), ("a", "a line of some length there\nx"), ("c", "quite another line of text"), (None, "a line of some length here")]
    got = {(x.doc_id, x.line_no): (x.n_links, x.kept) for x in ld.line_classes(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("b", 0): (1, False), ("a", 0): (1, True), ("a", 1): (0, True), ("c", 0): (0, True), (None, 0): (0, True)}


@pytest.mark.parametrize("bound", [-1, 1_000_000])
def test_repeated_lines_are_taken_out(odd, empty, monkeypatch, bound):
    monkeypatch.setattr(ld, "BROADCAST_DROPPED", bound)
    left = ld.without_repeated_lines(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    rows = {}
    for r in left.collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert rows[1][0].text == ODD[0][1] and rows[2][0].text == "" and rows[2][0].n_chars == 0
    assert rows[3][0].text is None and rows[6][0].text == rows[7][0].text == "one two"
    assert [r.text for r in rows[8]] == [ODD[7][1]] * 2
    assert {r.text for r in rows[None]} == {ODD[0][1], None}
    assert ld.without_repeated_lines(empty).collect() == []


def brute_containment(docs, items, threshold=0.8):
    out = set()
    for d, text in docs:
        own = set(shingle_sequence(text or "", short=False).tolist())
        padded = f" {' '.join((text or '').lower().split())} "
        for i, item in items:
            words = (item or "").lower().split()
            if 0 < len(words) < 5 and f" {' '.join(words)} " in padded:
                out.add((d, i, 1, 1))
            want = set(shingle_sequence(item or "", short=False).tolist())
            if want and len(want & own) >= threshold * len(want) - 1e-9:
                out.add((d, i, len(want & own), len(want)))
    return out


def test_op10_equals_brute_force(spark, small, texts, queries):
    got = {tuple(r) for r in queries["op10_containment"](spark, small).collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    assert got == brute_containment(texts.items(), items) and got


def test_containment_of_planted_items(spark, monkeypatch):
    items = [(i, prose(20 + i, n)) for i, n in enumerate([5, 6, 9, 14, 30, 57, 120, 400])] + [(90, "too short"), (91, None), (92, prose(20, 5))]
    docs = []
    for i, (k, item) in enumerate(items[:8]):
        words = item.split()
        docs.append((3 * i, prose(60 + i, 700) + " " + item + " " + prose(80 + i, 900)))
        docs.append((3 * i + 1, prose(40 + i, 300) + " " + " ".join(words[: max(5, len(words) // 2)])))
        half = len(words) // 2
        docs.append((3 * i + 2, " ".join(words[half:]) + " " + prose(50 + i, 400) + " " + " ".join(words[:half])))
    docs += [(100, None), (101, ""), (None, items[4][1]), (102, items[4][1])]
    # items of one to four words: at both ends, alone, in another case, parted, and as a part of a longer word
    items += [(93, "Lone"), (94, "in four words exactly"), (95, "too short"), (96, " \n ")]
    docs += [(103, "Too\nshort it is"), (104, prose(31, 3000) + " too short"), (105, "too very short"), (106, "tattoo shorter"), (107, "LONE"),
             (108, "alone lonely"), (109, "said in Four words exactly so"), (110, "in four words"), (111, prose(32, 40_000) + " lone " + prose(33, 40_000))]
    documents = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute_containment(docs, items)
    assert {(d, i) for d, i, *_ in want if i in (90, 93, 94, 95)} == {
        (103, 90), (104, 90), (103, 95), (104, 95), (107, 93), (109, 94), (111, 93)}
    assert {tuple(r) for r in containment.contained_items(documents, benchmark).collect()} == want
    monkeypatch.setattr(containment, "PASS_ITEMS", 3)
    assert {tuple(r) for r in containment.contained_items(documents, benchmark).collect()} == want
    left = containment.without_contaminated(documents, benchmark)
    assert left.columns == documents.columns
    bad = {d for d, *_ in want if d is not None}
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)
    assert containment.contained_items(documents, benchmark.where("false")).collect() == []
    assert containment.contained_items(documents.where("false"), benchmark).collect() == []
