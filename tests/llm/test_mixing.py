import collections
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.cases import empty, frame, odd, odd_rows, real
from tidemark.llm import mixing


def test_targets_stop_at_twice_the_size_and_share_the_rest():
    got = mixing.targets([10, 100, 100], [3, 1, 2], 315)
    assert got[0] == 20 and abs(got[1] - 295 / 3) < 1e-9 and abs(got[2] - 590 / 3) < 1e-9
    got = mixing.targets([10, 20, 100], [3, 1, 2], 195)
    assert got == [20.0, 40.0, 135.0]
    assert mixing.targets([0, 0], [1, 1], 0) == [0, 0]


def test_points_are_reversed_digits(spark):
    rows = spark.range(64).select(mixing.reversed_bits(F.col("id"), 6).alias("r")).collect()
    assert [r.r for r in rows] == [int(f"{i:06b}"[::-1], 2) for i in range(64)]


@pytest.mark.parametrize("bits", [31, 32, 33, 35, 40, 62])
def test_points_of_large_schedules(spark, bits):
    rng = random.Random(bits)
    slots = [0, 1, 2, (1 << bits) - 1, *(rng.randrange(1 << bits) for _ in range(50))]
    total = rng.randrange(1 << (bits - 1), 1 << bits)
    rows = spark.createDataFrame([(i,) for i in slots], "id long").select(
        "id", mixing.reversed_bits(F.col("id"), bits).alias("r"), mixing.scaled_point(F.col("id"), total, bits).alias("leaf")).collect()
    for row in rows:
        point = int(f"{row.id:0{bits}b}"[::-1], 2)
        assert (row.r, row.leaf) == (point, point * total >> bits)


def test_too_many_blocks_or_sources_are_refused(spark, monkeypatch):
    with pytest.raises(ValueError, match="larger"):
        mixing.schedule(empty(spark), [{"id": 0, "blocks": 1 << 63}])
    monkeypatch.setattr(mixing, "SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(frame(spark, [(i, "a b", "en", str(i), 0) for i in range(3)]))


def spark_hash(doc_id):
    """xxhash64(doc_id, 7) as Spark chains it; a null leaves the seed as it is."""
    seed = 42 if doc_id is None else xxhash.xxh64(struct.pack("<q", doc_id), seed=42).intdigest()
    return xxhash.xxh64(struct.pack("<i", 7), seed=seed).intdigest()


def brute(rows):
    """(doc_id, size, source_size, target, taken) from the shuffled order and the targets alone."""
    chunks, own = max(1, -(-len(rows) // mixing.CHUNK)), collections.defaultdict(list)
    for doc_id, text, _, source, *_ in rows:
        place = spark_hash(doc_id)
        signed = place - (1 << 64) if place >> 63 else place
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        own[source].append(((place >> 20) % chunks, signed, doc_id is not None, doc_id or 0, size, doc_id))
    names = sorted(own, key=lambda s: (s is None, s or ""))
    sizes = [sum(r[4] for r in own[s]) for s in names]
    aims = mixing.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes))
    out = []
    for source, whole, aim in zip(names, sizes, aims):
        at = 0
        for *_, size, doc_id in sorted(own[source]):
            spans = [(low, min(low + size, round(aim))) for low in (at, at + whole)]
            out.append((doc_id, size, whole, aim, sum(max(0, high - low) for low, high in spans)))
            at += size
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", ["given", "odd", "many"])
def test_words_taken_equal_a_plain_version(spark, monkeypatch, rows):
    monkeypatch.setattr(mixing, "BLOCK", 1 if rows == "many" else 64)
    monkeypatch.setattr(mixing, "CHUNK", 16)
    rng = random.Random(3)
    table = {"given": [tuple(r) for r in real(spark).collect()], "odd": odd_rows(),
             "many": [(i, "w " * rng.randint(0, 300), "en", rng.choice("abcde"), 0) for i in range(400)]}[rows]
    assert sorted(map(tuple, mixing.mix(frame(spark, table)).collect()), key=str) == brute(table)


def test_rows_that_differ_in_a_column_are_told_apart(spark):
    rows = [(1, "same text here", "en", s, n) for s in ("a", "b", None) for n in range(4)] + [(1, "same text here", "en", "a", 0)]
    docs = frame(spark, rows)
    words = sum(r.taken for r in mixing.mix(docs).collect())
    held = collections.Counter(tuple(r) for r in mixing.taken_documents(docs).collect())
    assert set(held) <= set(rows) and 3 * sum(held.values()) >= words and held[rows[0]] <= 4


def test_every_source_gets_its_slots_spread_evenly(spark):
    sources = [{"id": 0, "blocks": 1}, {"id": 1, "blocks": 70}, {"id": 2, "blocks": 29}, {"id": 3, "blocks": 0}]
    rows = sorted(mixing.schedule(empty(spark), sources).collect(), key=lambda r: r.slot)
    for s in sources:
        own = [r for r in rows if r.id == s["id"]]
        assert [r.block for r in own] == list(range(s["blocks"]))  # ranked in slot order
    half = [r.id for r in rows[:len(rows) // 2]]
    assert abs(half.count(1) - 35) <= 3 and abs(half.count(2) - 14) <= 3


def test_words_taken_meet_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    docs = real(spark)
    rows = mixing.mix(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    words = {r.doc_id: len(r.text.split(" ")) for r in docs.collect()}
    sums = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.size > 0 and words
        own = sums[source[r.doc_id]]
        own[0], own[1], own[2] = own[0] + r.size, own[1] + r.taken, r.target
        assert r.target <= 2 * r.source_size
    assert all(abs(taken - target) <= 1 for _, taken, target in sums.values())
    assert abs(sum(t for _, _, t in sums.values()) - 1.5 * sum(s for s, _, _ in sums.values())) < 1e-6
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, rows))


def test_segments_add_up_and_follow_the_shuffled_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    docs, segments = mixing.mixed(real(spark))
    taken = {r.doc_id: r.taken for r in docs.collect()}
    sums = collections.Counter()
    for r in segments.collect():
        assert 0 < r.words <= 64
        sums[r.doc_id] += r.words
    assert sums == {k: v for k, v in taken.items() if v}


def test_odd_rows(spark):
    rows = mixing.mix(odd(spark)).collect()
    assert len(rows) == len(odd_rows()) and all(r.taken <= 2 * r.size for r in rows)
    assert all(r.size == r.taken == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert mixing.mix(empty(spark)).count() == 0 and mixing.taken_documents(empty(spark)).count() == 0
    blank = frame(spark, [(1, None, "en", "a", 0), (2, " ", "en", None, 0)])
    assert [tuple(r)[1:] for r in mixing.mix(blank).collect()] == [(0, 0, 0.0, 0)] * 2
    held = mixing.taken_documents(odd(spark))
    assert held.columns == odd(spark).columns and 0 < held.count() <= 2 * len(odd_rows())


def test_taken_documents_follow_the_mix(spark):
    taken = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix(real(spark)).collect() if r.taken}
    assert collections.Counter(r.doc_id for r in mixing.taken_documents(real(spark)).collect()) == taken
