import collections
import zlib

from tests.llm.cases import empty, frame, odd, odd_rows, real
from tidemark.llm import sharding


def test_sizes_slots_and_groups(spark):
    rows = sharding.byte_shards(real(spark)).collect()
    texts = {r.doc_id: r.text for r in real(spark).collect()}
    sizes, slots, homes = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[texts[r.doc_id]].add(r.shard)
    total, mean = sum(sizes.values()), sum(sizes.values()) / 40
    longest = max(r.size for r in rows)
    assert set(sizes) <= set(range(40)) and total and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(s - mean) <= longest + mean / 32 for s in sizes.values())
    counts = collections.Counter(texts.values())
    whole = [t for t in counts if counts[t] * (len(t.encode()) + 16) * 32 * 40 <= total]
    assert all(len(homes[t]) == 1 for t in whole)


def hot(spark):
    rows = [(i, "hot text " * 5, "en", "a", 0) for i in range(2000)]
    return frame(spark, rows + [(10_000 + i, f"text number {i} " * (1 + i % 7), "en", "a", 0) for i in range(4000)])


def test_a_group_of_a_third_of_all_rows_is_cut_evenly(spark):
    sizes = collections.Counter()
    for r in sharding.byte_shards(hot(spark)).collect():
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and all(abs(s - mean) < 0.06 * mean for s in sizes.values())


def test_result_does_not_depend_on_the_samples(spark, monkeypatch):
    want = sorted(map(tuple, sharding.byte_shards(hot(spark)).collect()))
    monkeypatch.setattr(sharding, "SAMPLES", 200)
    monkeypatch.setattr(sharding, "RANGES", 7)
    few = sharding.byte_shards(hot(spark).repartition(5))
    assert sorted(map(tuple, few.collect())) == want


def test_overfull_ranges_are_subdivided(spark):
    from pyspark.sql import functions as F
    rows = sharding.record_sizes(hot(spark).filter("doc_id >= 10000")).withColumn("key", F.col("digest")).cache()
    total = rows.agg(F.sum("size")).first()[0]
    first = sharding._splitters(rows, 30 / total, 10, 0)
    more = sharding.range_splitters(rows, total, ranges=10, samples=30)
    assert set(first) <= set(more)
    # A splitter list that misses most boundaries is filled up by the later rounds.
    few = sharding.range_splitters(rows, total, ranges=400, samples=40)
    sums = rows.withColumn("range", sharding._range_of(few)).groupBy("range").agg(
        F.sum("size").alias("s"), (F.min("key") < F.max("key")).alias("mixed")).filter("mixed").collect()
    assert max(r.s for r in sums) <= sharding.OVERFULL * total / 400 + 2**16
    rows.unpersist()


def test_odd_rows_and_files(spark, tmp_path):
    rows = sharding.byte_shards(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 1} == {(16, 0)}
    assert sharding.byte_shards(empty(spark)).count() == 0
    docs = real(spark)
    placed = sharding.byte_shards(docs)
    sharding.write_shards(docs, placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in placed.collect()}
