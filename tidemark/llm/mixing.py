"""Mixing sources to target weights by a low-discrepancy schedule.

Base-2 van der Corput points pass through the cumulative block counts of the sources, which names
the source of every slot; slots are ranked per source. Each source's documents are put in a shuffled
order, whose words, read twice over, are cut into blocks of equal words; slot k of a source takes
its block k. Ranks and positions are prefix sums over chunks, so a hot source spreads over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import packed_rows, prepare, settle, unpacked, word_count

WEIGHTS = (3, 1, 2)  # of the sources in code point order, null last, repeating
SHARE = 1.5  # of all words
PASSES = 2  # a source is read at most so often
BLOCK = 1024  # words of a block
SOURCES = 100_000
CHUNK = 1024  # slots or documents of a chunk


def targets(sizes: list[int], weights: list[float], total: float, passes: int = PASSES) -> list[float]:
    """``total`` shared by weight; targets stop at ``passes`` times their source's size and the
    excess is shared again until none is above."""
    result, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    rest = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / weight > passes * sizes[i]]
        if not over:
            for i in open_:
                result[i] = rest * weights[i] / weight
            break
        for i in over:
            result[i] = float(passes * sizes[i])
            rest -= result[i]
        open_ = [i for i in open_ if i not in over]
    return result


def source_table(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> list[dict]:
    """A row per source with its size, target and number of blocks; at most SOURCES of them."""
    found = (rows.groupBy("source").agg(F.sum("size").alias("size")).limit(SOURCES + 1)
             .orderBy(F.col("source").asc_nulls_last()).collect())
    if len(found) > SOURCES:
        raise ValueError(f"there are more than {SOURCES} sources; their list is held by the driver and sent to all tasks")
    sizes = [r["size"] for r in found]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(sizes))
    return [{"id": i, "source": r.source, "source_size": r["size"], "target": aim,
             "words": round(aim), "blocks": -(-round(aim) // BLOCK)} for i, (r, aim) in enumerate(zip(found, aims))]


_MASKS = ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF),
          (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF))
MOST_BITS = 62  # of a slot's number


def reversed_bits(i: Column, bits: int) -> Column:
    """The binary digits of ``i`` below 2**bits in reverse, the van der Corput point times 2**bits."""
    for step, mask in _MASKS:
        i = (F.shiftrightunsigned(i, step).bitwiseAND(F.lit(mask))
             .bitwiseOR(F.shiftleft(i.bitwiseAND(F.lit(mask)), step)))
    return F.shiftrightunsigned(i, 64 - bits)


def scaled_point(i: Column, total: int, bits: int) -> Column:
    """The point of slot ``i`` times ``total``, rounded down, as a long; of a product beyond longs in decimals."""
    point = reversed_bits(i, bits)
    if 2 * bits <= MOST_BITS:
        return F.shiftright(point * F.lit(total), bits)
    whole = point.cast("decimal(19,0)") * F.lit(total).cast("decimal(19,0)")
    # At most 38 digits, which decimals hold without rounding.
    return F.call_function("div", whole, F.lit(1 << bits).cast("decimal(19,0)")).cast("long")


def schedule(docs: DataFrame, sources: list[dict]) -> DataFrame:
    """(slot, id, block): the source of each slot and the block it takes.

    With 2**bits points for at most 2**bits blocks each unit of the cumulative counts holds a point,
    so every source gets all its slots; further ones are left out. Up to 2**MOST_BITS blocks."""
    spark = docs.sparkSession
    total = sum(s["blocks"] for s in sources)
    bits = max(1, (total - 1).bit_length())
    if bits > MOST_BITS:
        raise ValueError(f"{total} blocks are more than 2**{MOST_BITS}: take larger ones")
    upper = np.cumsum([s["blocks"] for s in sources])

    @F.pandas_udf("int")
    def owner(leaf: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(upper, leaf.to_numpy(), side="right").astype("int32"))

    slots = (spark.range(1 << bits if total else 0).select(
        F.col("id").alias("slot"), owner(scaled_point(F.col("id"), total, bits)).alias("id"))
        .withColumn("chunk", F.expr(f"slot div {CHUNK}")))
    before = (slots.groupBy("id", "chunk").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(
                  Window.partitionBy("id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)),
                  F.lit(0))).drop("n"))
    local = F.row_number().over(Window.partitionBy("id", "chunk").orderBy("slot"))
    ranked = (slots.withColumn("local", local).join(before, ["id", "chunk"])
              .select("slot", "id", (F.col("before") + F.col("local") - 1).alias("block")))
    wanted = spark.createDataFrame([(s["id"], s["blocks"]) for s in sources], "id int, blocks long")
    return (ranked.join(F.broadcast(wanted), "id").filter("block < blocks").drop("blocks"))  # a row per source


def positions(rows: DataFrame, n_rows: int) -> DataFrame:
    """Adds ``start``: a document's first word in the shuffled order of its source."""
    chunks = max(1, -(-n_rows // CHUNK))
    place = F.xxhash64(F.col("doc_id"), F.lit(7))
    rows = rows.withColumn("place", place).withColumn(
        "chunk", F.pmod(F.shiftrightunsigned("place", 20), F.lit(chunks)))
    before = (rows.groupBy("id", "chunk").agg(F.sum("size").alias("size"))
              .withColumn("before", F.coalesce(F.sum("size").over(
                  Window.partitionBy("id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)),
                  F.lit(0))).drop("size"))
    upto = F.sum("size").over(Window.partitionBy("id", "chunk").orderBy("place", "doc_id", "size")
                              .rowsBetween(Window.unboundedPreceding, 0))
    return (rows.withColumn("upto", upto).join(before, ["id", "chunk"])
            .withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
            .drop("place", "chunk", "upto", "before"))


def row_hash(docs: DataFrame) -> Column:
    """Names a row by all its columns; rows with equal ones can stand for each other."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE
          ) -> tuple[DataFrame, DataFrame]:
    """(documents, segments). Documents: doc_id, size, row_hash, source_size, target, taken, one row each.
    Segments: slot, doc_id, first_word, words: what each slot of the mix takes, in order.

    Sizes are words; a null or blank text has none and takes none. A null source is a source of its
    own, last in order. Each source takes its target, rounded to a word; no document exceeds twice
    its size. The order is a hash of doc_id, ties are settled by size, and equal rows can stand for
    each other, so reruns agree. An empty table gives no rows."""
    prepare(docs.sparkSession)
    rows = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                              F.col("source").cast("string").alias("source"), row_hash(docs).alias("row_hash"),
                              word_count(F.col("text")).alias("size")), "sizes")
    sources, n_rows = source_table(rows, weights, share), rows.count()
    table = docs.sparkSession.createDataFrame(
        [(s["id"], s["source"], s["source_size"], s["target"], s["words"]) for s in sources],
        "id int, source string, source_size long, target double, aim long")
    rows = rows.alias("r").join(F.broadcast(table).alias("t"),  # a row per source
                                F.col("r.source").eqNullSafe(F.col("t.source"))).select(
        "r.doc_id", "r.size", "r.row_hash", "t.id", "t.source_size", "t.target", "t.aim")
    placed = positions(rows, n_rows)
    # Each pass of a document, then each block it touches.
    spans = (placed.filter("size > 0 AND aim > 0")
             .withColumn("pass", F.explode(F.array(*[F.lit(k) for k in range(PASSES)])))
             .withColumn("low", F.col("start") + F.col("pass") * F.col("source_size"))
             .withColumn("high", F.least(F.col("low") + F.col("size"), F.col("aim")))
             .filter("low < high")
             .withColumn("block", F.explode(F.expr(f"sequence(low div {BLOCK}, (high - 1) div {BLOCK})")))
             .withColumn("from", F.greatest("low", F.col("block") * BLOCK))
             .withColumn("to", F.least("high", (F.col("block") + 1) * BLOCK)))
    segments = spans.join(schedule(docs, sources), ["id", "block"]).select(
        "slot", "id", "doc_id", "start", "size", (F.col("from") - F.col("low")).alias("first_word"),
        (F.col("to") - F.col("from")).alias("words"))
    # A document's place in its source names its row, also where doc_id repeats or is null.
    taken = segments.groupBy("id", "start", "size").agg(F.sum("words").alias("taken"))
    result = (placed.join(taken.withColumnsRenamed({"id": "i", "start": "s", "size": "z"}),
                          (F.col("id") == F.col("i")) & (F.col("start") == F.col("s"))
                          & (F.col("size") == F.col("z")), "left")
              .select("doc_id", "size", "row_hash", "source_size", "target",
                      F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))
    return result, segments.select("slot", "doc_id", "first_word", "words")


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return mixed(docs)[0].drop("row_hash")


def taken_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, whole and with all their columns: once for each pass in which the mix
    takes a word of them, so never more often than PASSES times; not at all if it takes none. The mix ends
    within a document of each source, which comes whole too. Rows equal in all columns share their copies;
    null and wordless texts are never taken; an empty table gives no rows."""
    times = (mixed(docs)[0].filter("taken > 0").groupBy(F.col("doc_id").alias("id"), F.col("row_hash").alias("hash"))
             .agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("times")))
    rows = packed_rows(docs, doc_id=F.col("doc_id").cast("long"), row_hash=row_hash(docs)).dropDuplicates(["doc_id", "row_hash"])
    held = rows.join(times, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("hash")))
    return unpacked(held.select("row", F.explode(F.expr("sequence(1, times)"))))
