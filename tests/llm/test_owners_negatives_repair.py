"""Owners of equal texts, hard negatives and repaired conversations against brute force."""

import hashlib
import re
import zlib
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pytest
from samples import CLASHES, ODD, prose
from pyspark.sql import functions as F

from deedlink.llm import conversation_repair as cr, residue_negatives as rn, trie_owners as to


def least(row):
    return tuple((x is None, 0 if x is None else x) for x in row)


# owners


def brute_owners(rows):
    """(id, text) rows; per row id, owner, size, digest, and the ids that stay."""
    norm = [(i, re.sub("[ \t-\r]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    smallest = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, smallest[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=least), sorted(
        smallest.values(), key=lambda i: least((i,))
    )


def got_owners(df):
    rows = df.collect()
    kept = sorted((r.doc_id for r in rows if r.kept), key=lambda i: least((i,)))
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=least), kept


def test_owners_of_odd_rows(odd, empty):
    assert got_owners(to.owners(odd)) == brute_owners([r[:2] for r in ODD])
    assert to.owners(empty).collect() == []
    assert to.owners(odd).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_owners_on_the_table(spark, documents, texts, queries, small):
    assert got_owners(queries["op11_trie_owners"](spark, small)) == brute_owners(list(texts.items()))


@pytest.mark.parametrize("digits", [16, 0])
def test_owners_with_spills_hot_texts_and_colliding_hashes(spark, monkeypatch, digits):
    monkeypatch.setattr(to, "HASH_DIGITS", digits)
    texts = [prose(k, 30)[: 100 + k % 2] for k in range(40)] + ["", " ", "a", "a b", "a  b", "a b c"]
    rows = [(i, texts[0] if i % 3 == 0 else texts[i * 7 % len(texts)]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(17)
    assert got_owners(to.owners(df, trie_bytes=3_000, fan_in=2)) == brute_owners(rows)


def test_owners_by_text_ids(spark):
    df = spark.createDataFrame([("b", "x  y"), ("a", "x\ty"), ("c", None), (None, "")], "doc_id string, text string")
    found = {r.doc_id: (r.keep_id, r.kept) for r in to.owners(df).collect()}
    assert found == {"a": ("a", True), "b": ("a", False), "c": ("c", True), None: ("c", False)}


def test_trie_keeps_what_it_is_given_and_spills_whole_subtrees():
    trie, expected, spilled = to.Trie(), {}, []
    words = [prose(k % 7, 12)[: 5 + k % 60].encode() for k in range(400)] + [b"", b"a" * 50_000, b"a" * 49_999]
    for k, w in enumerate(words):
        trie.terminal(w, lambda: [0])[0] += 1
        expected[w] = expected.get(w, 0) + 1
        assert trie.root.weight == sum(len(n.label) + to.NODE_BYTES for n in nodes(trie.root))
        if k % 90 == 89:
            before = trie.root.weight
            part = list(trie.spill())
            assert part and trie.root.weight < before
            spilled += part
    total = {}
    for text, (count,) in [*spilled, *trie.walk()]:
        total[text] = total.get(text, 0) + count
    assert total == expected


def nodes(node):
    yield node
    for child in node.children.values():
        yield from nodes(child)


# hard negatives


def brute_negatives(rows, anchor, low=30, high=90, share=100, positives=5, negatives=10):
    """rows: (id, label, vector)."""
    usable = [(i, l, [int(np.floor(256 * float(x))) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    found = []

    def first(candidates, k):
        return sorted(candidates, key=lambda c: (-c[0], c[1] is None, c[1] or 0))[:k]

    for n, (i, label, v) in enumerate(usable):
        if i is None or not anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for m, (j, other, w) in enumerate(usable) if m != n]
        for p, j, _ in first([s for s in scored if s[2] == label], positives):
            inside = [s for s in scored if s[2] != label and low * p <= share * s[0] <= high * p]
            found += [(i, j, k, s[1], p, s[0]) for k, s in enumerate(first(inside, negatives), 1)]
    return sorted(found, key=least)


def got_negatives(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=least)


@pytest.fixture(scope="module")
def vectors():
    random = np.random.default_rng(3)
    rows = [(i, int(random.integers(0, 4)), [float(x) for x in random.normal(0.1, 0.4, 6)]) for i in range(300)]
    common = [0.3, 0.2, 0.1, 0.3, -0.1, 0.4]
    rows = [(i, l, common if i % 3 == 0 else v) for i, l, v in rows]
    odd = [(300, None, common), (301, 1, None), (302, 1, [1.0, None]), (303, 2, [float("nan")]), (304, 2, [float("inf"), 0.0]), (305, 2, [])]
    return rows + odd + [(20, 1, [0.5, 0.5, 0.5]), (20, 1, [0.5, 0.5, 0.5]), (306, 3, [900.5, -700.25, 3.0]), (None, 1, common), (None, 2, [0.4, 0.1])]


def test_negatives_equal_brute_force_in_small_blocks(spark, vectors, monkeypatch):
    for name, n in (("ROW_BLOCK", 37), ("ANCHOR_BLOCK", 4), ("ANCHORS_OF_TASK", 8)):
        monkeypatch.setattr(rn, name, n)
    clash = ", ".join(f"`{c}` string" for c in CLASHES if c != "label")
    rows = [(*r, *["x"] * (len(CLASHES) - 1)) for r in vectors]
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<float>, {clash}").repartition(3)
    got = got_negatives(rn.hard_negatives(df, F.col("vec_id") % 10 == 0))
    assert got == brute_negatives([(i, l, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, l, v in vectors], lambda i: i % 10 == 0)
    assert got


def test_negatives_of_few_and_no_rows(spark):
    kind = "vec_id long, label int, embedding array<float>"
    assert rn.hard_negatives(spark.createDataFrame([], kind), F.col("vec_id") % 10 == 0).collect() == []
    one = spark.createDataFrame([(10, 1, [1.0]), (11, 2, [0.5])], kind)
    assert rn.hard_negatives(one, F.col("vec_id") % 10 == 0).collect() == []  # no positive
    two = spark.createDataFrame([(10, 1, [1.0]), (11, 2, [0.5]), (12, 1, [1.0])], kind)
    assert got_negatives(rn.hard_negatives(two, F.col("vec_id") == 10)) == [(10, 12, 1, 11, 65536, 32768)]
    with pytest.raises(ValueError):
        rn.hard_negatives(spark.createDataFrame([(10, 1, [1e30])], kind), F.col("vec_id") == 10)


def test_negatives_on_the_table(spark, small, queries):
    rows = [(r.vec_id, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert got_negatives(queries["op12_residue_negatives"](spark, small)) == brute_negatives(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("size", [3, 300, 1 << 13, 1 << 25])
def test_residue_products_are_exact(size):
    random = np.random.default_rng(size)
    a, b = (random.integers(-size, size + 1, (n, 1500)) for n in (7, 9))
    a[0], b[0], b[1] = size, size, -size
    bound = max(int((m * m).sum(axis=1).max()) for m in (a, b))
    moduli = rn.primes(bound)
    got = rn.scores([rn.residues(a, p) for p in moduli], [rn.residues(b, p) for p in moduli], moduli)
    assert (got == a @ b.T).all()


# conversations


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows, convs):
    """The verdict of every conversation, its repair by trying all edits."""
    found = {}
    for conv in {*convs, *(r[0] for r in rows)}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()[:16]))
        turns = [t for t, _, _ in mine if t is not None]
        faults, seen = [], set()
        for _, role, text in mine:
            body = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        legal = {"su", "ua", "au"}
        illegal = sum(a[1][:1] + b[1][:1] not in legal for a, b in pairwise(mine))

        @lru_cache(None)
        def inserted(at, initials, left):
            options = [plain(at, initials, left)]
            if left:
                for name in ("user", "assistant"):
                    if (after := step(initials, name[0])) is not None:
                        cost, audit, rest = inserted(at, after, left - 1)
                        options.append((3 + cost, "I" + audit, (f"{name}:", *rest)))
            return min(options)

        @lru_cache(None)
        def plain(at, initials, left):
            options = []
            if at == len(mine):
                return (0, "", ()) if initials in ("", "ua") else (10**9, "", ())
            _, role, text = mine[at]
            cost, audit, rest = inserted(at + 1, initials, 3)
            options.append((4 + cost, "D" + audit, rest))
            if faults[at] not in ("blank", "duplicate"):
                extra = 3 * (faults[at] == "truncated")
                for edit, price, name in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                    if (after := step(initials, name[:1])) is not None:
                        cost, audit, rest = inserted(at + 1, after, 3)
                        options.append((price + extra + cost, edit + audit, (f"{name}:{text}", *rest)))
            return min(options)

        cost, audit, out = inserted(0, "", 3)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return found


def step(initials, new):
    """What matters of the initials after one more: nothing, s, u after s or a, or a whole pair."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "ua", ("ua", "u"): "u"}.get((initials, new))


def got_repair(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def test_repair_on_the_table(spark, small, queries):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = got_repair(queries["op13_conversation_repair"](spark, small))
    assert got == brute_repair(brute_damage(rows), {r[0] for r in rows})
    assert any("R" in v[6] or "I" in v[6] for v in got.values())


@pytest.fixture(scope="module")
def talks():
    random = np.random.default_rng(5)
    roles, words = ["user", "assistant", "system", "tool", "User", None, "", "assistant", "user"], ["Yes.", "no", "", " \n", "What?", "Go! ", None, "x" * 70_000, "é🙂."]
    rows = []
    for conv in range(150):
        for _ in range(random.integers(1, 12)):
            turn = None if random.random() < 0.05 else int(random.integers(-3, 9))
            rows.append((conv, turn, roles[random.integers(len(roles))], words[random.integers(len(words))]))
    return rows + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (None, None, None, None), (900, None, "user", "Hi."), (900, None, "user", "Hi.")]


@pytest.mark.parametrize("turns", [4096, 2])
def test_repair_of_odd_rows(spark, talks, monkeypatch, turns):
    monkeypatch.setattr(cr, "PIECE_TURNS", turns)
    clash = ", ".join(f"`{c}` string" for c in [*CLASHES, "piece", "letters", "copies", "digest"])
    df = spark.createDataFrame([(*r, *["x"] * (len(CLASHES) + 4)) for r in talks], f"conv_id long, turn long, role string, text string, {clash}").repartition(5)
    convs = {r[0] for r in talks} | {5000}
    more = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    assert got_repair(cr.repair(df, more)) == brute_repair(talks, convs)
    assert got_repair(cr.repair(cr.damaged(df), more)) == brute_repair(brute_damage(talks), convs)


def test_repair_without_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair(none).collect() == []
    nothing = hashlib.sha256(b"").hexdigest()
    got = got_repair(cr.repair(none, spark.createDataFrame([(7,), (7,), (None,)], "conv_id long")))
    assert got == {7: (0, 0, 0, 0, 0, 0, "", nothing), None: (0, 0, 0, 0, 0, 0, "", nothing)}


def test_shared_suffixes_give_each_signature_what_it_gets_alone():
    random = np.random.default_rng(8)
    signatures = sorted({"".join(random.choice(list("suaxSUAXd"), random.integers(0, 9))) for _ in range(500)}, key=lambda s: s[::-1])
    together = cr.Suffixes()
    assert [together.audit(s) for s in signatures] == [cr.Suffixes().audit(s) for s in signatures]
    long = cr.Suffixes().audit("ua" * 50_000)
    assert long == (0, "K" * 100_000)
