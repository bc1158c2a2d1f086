"""Shards of near-equal bytes by sampled splitters.

Records are ordered by (digest of the text, doc_id). Size-weighted key samples give range
boundaries; ranges that turn out overfull are cut again by a denser sample of their own; exact sums
per range then place every record in the global order without any task seeing more than one range.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWEST, prepare, settle, unsigned_crc32

OVERHEAD = 16  # bytes a record costs besides its text
WHOLE = 32  # groups of equal texts up to 1/WHOLE of a shard are never cut
SAMPLES = 20_000  # expected draws of one sampling round; bounds what reaches the driver
RANGES = 1_000  # ranges of the first round
OVERFULL = 3  # times the mean bytes or rows of a range
ROUNDS = 4


def record_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, digest): one row per document; a null text has only the overhead
    and the empty digest."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"),
        unsigned_crc32(body).alias("text_crc32"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("digest"))


def _sort_key(heavy: Column) -> Column:
    """The digest, and for heavy groups also doc_id in an encoding that sorts as numbers do."""
    number = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(LOWEST))), 16, "0")
    return F.when(heavy, F.concat("digest", F.coalesce(number, F.lit("")))).otherwise(F.col("digest"))


def _draws(rate: float, salt: int) -> Column:
    """How many samples a record gives: its size times the rate, rounded up or down by a hash."""
    unit = (F.pmod(F.xxhash64("digest", "doc_id", F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    return F.floor(F.col("size") * F.lit(rate) + unit)


def _splitters(rows: DataFrame, rate: float, pieces: int, salt: int) -> list[str]:
    """Boundaries of ``pieces`` ranges of equal weight in a size-weighted sample."""
    drawn = (rows.select("key", _draws(rate, salt).alias("n")).filter("n > 0")
             .groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").collect())
    if not drawn or pieces < 2:
        return []
    weights = np.cumsum([r.n for r in drawn])
    at = np.searchsorted(weights, weights[-1] * np.arange(1, pieces) / pieces)
    return sorted({drawn[i].key for i in at})


def _range_of(splitters: list[str]):
    bounds = np.array(splitters, dtype="S48")

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy().astype("S48"), side="right").astype("int32"))

    return place("key")


def range_splitters(rows: DataFrame, total: int, ranges: int = RANGES, samples: int = SAMPLES,
                    rounds: int = ROUNDS) -> list[str]:
    """Splitters over ``key``; ranges with over OVERFULL times the mean bytes or rows are subdivided.

    A range of one key cannot be cut and is left as it is."""
    splitters = _splitters(rows, samples / total, ranges, 0)
    for salt in range(1, rounds + 1):
        sums = (rows.withColumn("range", _range_of(splitters)).groupBy("range")
                .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"),
                     (F.min("key") < F.max("key")).alias("mixed")).collect())
        mean_size, mean_n = total / ranges, sum(r.n for r in sums) / ranges
        full = [r for r in sums if r.mixed and (r["size"] > OVERFULL * mean_size + 2**16
                                                or r.n > OVERFULL * mean_n + 100)]
        added = set()
        for r in full[:ranges]:
            low = splitters[r.range - 1] if r.range else ""
            own = rows.filter(F.col("key") >= low)
            if r.range < len(splitters):
                own = own.filter(F.col("key") < splitters[r.range])
            pieces = 1 + max(int(r["size"] / mean_size), int(r.n / mean_n))
            added |= set(_splitters(own, 32 * pieces / r["size"], pieces, salt)) - set(splitters)
        if not added:
            break
        for key in sorted(added):
            bisect.insort(splitters, key)
    return splitters


def byte_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per document.

    ``size`` is the UTF-8 bytes of the text plus 16. The global order is (digest, doc_id); a record
    goes to the shard in which its middle byte falls, and equal texts go together by the middle of
    their group unless the group is over 1/32 of a shard, when its records are placed one by one.
    So shards differ from the mean by one group or one document at most. ``slot`` counts a shard's
    records from 0. Nulls: a null text is a group of its own without bytes; a null doc_id sorts first. Equal rows
    share a place in the order and get any of its slots. An empty table gives no rows. ``grown_shard``
    is null, as this law fills shards by bytes.
    """
    prepare(docs.sparkSession)
    rows = settle(record_sizes(docs), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 1
    # At most WHOLE * shards groups can be larger than 1/WHOLE of a shard, hence the broadcast.
    heavy = (rows.groupBy("digest").agg(F.sum("size").alias("group_size"))
             .filter(F.col("group_size") * WHOLE * shards > F.lit(total))
             .select("digest", F.lit(True).alias("heavy")))
    rows = (rows.join(F.broadcast(heavy), "digest", "left")
            .withColumn("heavy", F.coalesce("heavy", F.lit(False)))
            .withColumn("key", _sort_key(F.col("heavy"))))
    rows = settle(rows, "keys")
    splitters = range_splitters(rows, total)
    ranged = rows.withColumn("range", _range_of(splitters))
    # One row per range: their number is bounded by the splitters.
    base = (ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
            .select("range", *[F.sum(c).over(Window.orderBy("range").rowsBetween(
                Window.unboundedPreceding, -1)).alias(f"before_{c}") for c in ("bytes", "n")]))
    order = Window.partitionBy("range").orderBy("digest", "doc_id", "size")
    group = Window.partitionBy("range", "digest")
    placed = (ranged.join(F.broadcast(base.na.fill(0)), "range")
              .withColumn("rank", F.col("before_n") + F.row_number().over(order) - 1)
              .withColumn("start", F.col("before_bytes") - F.col("size") + F.sum("size").over(
                  order.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("group_start", F.when(F.col("heavy"), F.col("start"))
                          .otherwise(F.min("start").over(group)))
              .withColumn("group_size", F.when(F.col("heavy"), F.col("size"))
                          .otherwise(F.sum("size").over(group)))
              .withColumn("shard", F.expr(
                  f"least({shards - 1}, (2 * group_start + group_size) * {shards} div (2 * {total}L))")
                  .cast("int"))
              .select("doc_id", "size", "text_crc32", "shard", "rank"))
    placed = settle(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # one row per shard
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("rank") - F.col("first")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write the documents in one folder per shard, in slot order within each file.

    Joined by doc_id, so doc_id must be unique and not null here."""
    (docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
     .hint("rebalance", "shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
