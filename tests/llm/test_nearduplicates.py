import random

import numpy as np
import pytest

from tests.llm.cases import empty, frame, odd, odd_rows, prose, real
from tidemark.llm import nearduplicates


def shingles(text):
    words = (text or "").encode().lower().split()  # bytes.lower changes A-Z alone
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> (n_shingles, component), all pairs; ids are unique."""
    sets = {i: shingles(t) for i, t in rows}
    part = {i: i for i in sets}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and part[a] != part[b] and 100 * both >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((part[a], part[b]))
                part = {k: low if v == high else v for k, v in part.items()}
    return {i: (len(sets[i]), part[i]) for i in ids}


def edited(rng, bases, copies):
    """Copies with a few words changed, so that similarities lie around the threshold."""
    rows = []
    for base in bases:
        words = base.split()
        for _ in range(copies):
            new = list(words)
            for _ in range(rng.randint(0, 4)):
                new[rng.randrange(len(new))] = f"edit{rng.randint(0, 5)}"
            rows.append((len(rows) * 3 % 1009, " ".join(new)))
    return rows


def check(spark, rows):
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nearduplicates.duplicates(docs).collect()}
    want = brute(rows)
    assert got == want
    return want


def test_shingle_sets_equal_python_sets():
    rng = random.Random(2)
    texts = ["", " ", "one", "One tWo", "a b c d", "a b c d e", "a\tb\nc\x0bd\x0ce f", "é É ß 中 a b c d e f é", "ab c d e f", "a bc d e f",
             prose(rng, 300), "x " * 2000]
    found = nearduplicates.shingle_sets([t.encode() for t in texts])
    for t, s in zip(texts, found):
        assert len(s) == len(shingles(t))
    for i, s in enumerate(found):
        for k, o in enumerate(found):
            assert len(np.intersect1d(s, o)) == len(shingles(texts[i]) & shingles(texts[k]))
    alone = [nearduplicates.shingle_sets([t.encode()])[0] for t in texts]
    assert all((a == b).all() for a, b in zip(alone, found))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    agree = (nearduplicates.signature(a) == nearduplicates.signature(b)).mean()
    assert abs(agree - 900 / 1100) < 0.12


def test_edited_copies_equal_brute_force(spark):
    rng = random.Random(7)
    rows = edited(rng, [prose(rng, 90) for _ in range(8)], 30)
    want = check(spark, rows)
    sizes = [list(c for _, c in want.values()).count(x) for x in {c for _, c in want.values()}]
    assert max(sizes) > 5 and sizes.count(1) > 5


@pytest.mark.parametrize("node,depth", [(8, 6), (8, 1)])
def test_large_nodes_branch_or_are_compared_in_blocks(spark, monkeypatch, node, depth):
    monkeypatch.setattr(nearduplicates, "NODE", node)
    monkeypatch.setattr(nearduplicates, "DEPTH", depth)
    monkeypatch.setattr(nearduplicates, "SET_LIMIT", 700)
    rng = random.Random(8)
    passage = prose(rng, 60)
    rows = edited(rng, [prose(rng, 90)], 90)
    rows += [(5000 + i, passage + " " + prose(rng, 60)) for i in range(60)]
    check(spark, rows)


def chained(rng, n):
    """A hot group: copies of one text and of edited copies of it, so that many lie too far from any one of them."""
    rows = [prose(rng, 120)]
    for _ in range(n - 1):
        words = rng.choice(rows).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = f"edit{rng.randint(0, 9)}"
        rows.append(" ".join(words))
    return list(enumerate(rows))


@pytest.mark.parametrize("blocks", [False, True])
def test_hot_groups_of_near_copies(spark, monkeypatch, blocks):
    some = {"DEPTH": 1, "SET_LIMIT": 3000, "BROADCAST_BYTES": 0, "BROADCAST_ROWS": 0} if blocks else {}
    for name, value in ({"NODE": 20, "BLOCK": 16} | some).items():
        monkeypatch.setattr(nearduplicates, name, value)
    rng = random.Random(12)
    want = check(spark, chained(rng, 150) + [(1000 + i, t) for i, t in chained(rng, 100)] + [(5000 + i, prose(rng, 60)) for i in range(30)])
    assert max(list(c for _, c in want.values()).count(x) for x in {c for _, c in want.values()}) > 50


def test_rows_stay_in_proportion_to_a_hot_group(spark, monkeypatch):
    """3,000 near copies, and nodes of 100: levels and blocks must not multiply them."""
    written = {}
    settled = nearduplicates.settle

    def counting(df, purpose):
        out = settled(df, purpose)
        written[purpose] = written.get(purpose, 0) + out.count()
        return out

    monkeypatch.setattr(nearduplicates, "settle", counting)
    monkeypatch.setattr(nearduplicates, "NODE", 100)
    monkeypatch.setattr(nearduplicates, "BLOCK", 100)
    rng = random.Random(13)
    base = prose(rng, 400).split()
    rows = []
    for i in range(3000):
        words = list(base)
        words[rng.randrange(400)] = f"edit{rng.randint(0, 400)}"
        rows.append((i, " ".join(words), "en", "a", 0))
    found = nearduplicates.duplicates(frame(spark, rows))
    assert found.filter("kept").count() == 1 and found.count() == 3000
    assert written["nodes"] < 3000 * 3 * nearduplicates.TREES and written["likely"] < 3000 * 2 * nearduplicates.TREES


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(1, 1), (3, 2), (2, 3)]
    got = dict(map(tuple, nearduplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in (7, *range(200, 260))}, 2: 2, 3: 2}
    assert nearduplicates.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_given_documents(spark):
    check(spark, [(r.doc_id, r.text) for r in real(spark).collect()])


def test_odd_rows_and_filter(spark):
    rows = nearduplicates.duplicates(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id and r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert {r.component_id for r in rows if r.doc_id in (5, 6, -9)} == {-9}
    null = sorted((r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is None)
    assert null[0] == (0, None, True) and null[1][1:] == (-9, False)
    tens = [r for r in rows if r.doc_id == 10]
    assert len(tens) == 2 and all(r.kept and r.component_id == 10 for r in tens)
    held = nearduplicates.keep_one(odd(spark))
    kept = [r.doc_id for r in held.collect()]
    assert held.columns == odd(spark).columns and sorted(k for k in kept if k is not None) == [-9, 1, 2, 3, 4, 7, 8, 9, 10, 10]
    assert kept.count(None) == 1  # the text of the other one is a document's
    assert nearduplicates.duplicates(empty(spark)).count() == 0 and nearduplicates.keep_one(empty(spark)).count() == 0


def test_what_contraction_leaves_is_joined_at_once(spark, monkeypatch):
    """A long path takes many rounds of contraction; its last edges are one move, with the same components."""
    rng = random.Random(6)
    names = rng.sample(range(-10**12, 10**12), 3000)
    edges = [(a, b) for a, b in zip(names, names[1:]) if rng.random() > 0.01]
    want, linked, group = {}, set(edges), [names[0]]
    for a, b in zip(names, names[1:]):
        if (a, b) in linked:
            group.append(b)
            continue
        want |= dict.fromkeys(group, min(group)) if len(group) > 1 else {}
        group = [b]
    want |= dict.fromkeys(group, min(group)) if len(group) > 1 else {}
    df, written, settle = spark.createDataFrame(edges + edges[:50], "a long, b long"), [], nearduplicates.settle
    monkeypatch.setattr(nearduplicates, "settle", lambda df, purpose: written.append(purpose) or settle(df, purpose))
    assert {r.v: r.c for r in nearduplicates.components(df).collect()} == want
    assert written.count("moves") == 1
    monkeypatch.setattr(nearduplicates, "LAST_EDGES", 40)
    assert {r.v: r.c for r in nearduplicates.components(df).collect()} == want
    assert written.count("moves") > 3
