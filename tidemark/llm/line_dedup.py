"""Near-duplicate lines by a deletion-neighbourhood join, in SQL expressions.

Two lines within one edit have a variant in common: the lines themselves, or what is left when a
character of each goes. Variants are emitted as hashed keys and equal ones joined. As one edit leaves
the first or the last half of a line alone, variants are needed only of lines that share a half with
another line; this loses no pair.

Equal lines need no variants: with ``every``, all lines that are not blank are grouped by their hashes, and
MIN_CHARS only says which lines are compared within an edit. A blank line (nothing but space and \\t to \\r)
of fewer code points parts paragraphs and always stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, packed_rows, settle, unpacked

MIN_CHARS = 20  # shorter lines are not compared within an edit: it would change too much of them
BROADCAST_ROWS = 200_000  # longer lists of keys or lines are joined by a shuffle
LAST = (1 << 63) - 1  # stands for a null doc_id, which comes last


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def hashed(value: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes; together they name a text."""
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def compared(line: Column, every: bool) -> Column:
    """Whether a line can be dropped: it is not blank (``every``), or has at least MIN_CHARS code points."""
    long = F.length(line) >= MIN_CHARS
    return line.rlike(WORD) | long if every else long


def lines(docs: DataFrame, every: bool = False) -> DataFrame:
    """(_id, _h, line_no, line, h1, h2): the lines that are ``compared``.

    (_id, _h) names a document by doc_id and a hash of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), F.xxhash64(text).alias("_h"),
                       F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    h1, h2 = hashed(F.col("line"))
    return rows.filter(compared(F.col("line"), every)).withColumn("h1", h1).withColumn("h2", h2)


def half_keys(line: Column) -> Column:
    """Hashes of the halves at which a line can meet another one that is one edit away.

    Of lines of n and n or n + 1 characters either the first floor(n / 2) characters agree or the last
    ones; a line may be the longer or the shorter one, so it gives the keys of both roles."""
    n = F.length(line)
    sizes = F.array_distinct(F.array(F.floor(n / 2), F.floor((n - 1) / 2)))
    first = F.transform(sizes, lambda k: F.xxhash64(F.lit(1), k, F.substring(line, F.lit(1), k.cast("int"))))
    last = F.transform(sizes, lambda k: F.xxhash64(F.lit(2), k, F.substring(line, (n - k + 1).cast("int"), k.cast("int"))))
    return F.concat(first, last)


def distinct_lines(docs: DataFrame, every: bool = False) -> DataFrame:
    """(h1, h2, first, n): each distinct line with its earliest place and its number of places."""
    return lines(docs, every).groupBy("h1", "h2").agg(F.min(F.struct("_id", "_h", "line_no")).alias("first"),
                                               F.count(F.lit(1)).alias("n"))


def shared_halves(docs: DataFrame) -> DataFrame:
    """Keys of halves that different lines have."""
    keys = lines(docs).select("h1", F.explode(half_keys(F.col("line"))).alias("key"))
    return keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("z")).filter("a < z").select("key")


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2, line, first): distinct lines that share a half with a different one."""
    keys = settle(shared_halves(docs), "halves")
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        held = lines(docs).withColumn("key", F.explode(half_keys(F.col("line")))).join(F.broadcast(keys), "key")
        texts = held.groupBy("h1", "h2").agg(F.first("line").alias("line"))
    else:  # the keys travel without texts; then each line is asked once
        some = (lines(docs).select("h1", "h2", F.explode(half_keys(F.col("line"))).alias("key")).join(keys, "key")
                .select("h1", "h2").distinct())
        texts = (lines(docs).select("h1", "h2", "line").join(some, ["h1", "h2"], "left_semi")
                 .groupBy("h1", "h2").agg(F.first("line").alias("line")))
    return texts.join(distinct.select("h1", "h2", "first"), ["h1", "h2"])


def variants(near: DataFrame) -> DataFrame:
    """(v1, v2, at, h1, h2, first): each line itself (at 0) and without its character number ``at``."""
    line = F.col("line")
    v1, v2 = hashed(F.col("variant"))
    left = F.concat(F.substring(line, F.lit(1), F.col("at") - 1), F.substring(line, F.col("at") + 1, F.length(line)))
    cut = near.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("line"))))
    return (cut.withColumn("variant", F.when(F.col("at") == 0, line).otherwise(left))
            .select(v1.alias("v1"), v2.alias("v2"), "at", "h1", "h2", "first"))


def near_pairs(near: DataFrame) -> DataFrame:
    """(h1, h2, k1, k2): a line and an earlier one within one edit, at least one for each line that has
    an earlier one. Lines that share a variant and the place of the deletion differ by one character
    there: each meets the earliest of them. A line that equals the variant of another meets that one.
    Groups are bounded by the number of characters there are and the places in a line."""
    group = Window.partitionBy("v1", "v2")
    rows = (variants(near).repartition("v1", "v2")
            .withColumn("head", F.min(F.struct("first", "h1", "h2")).over(Window.partitionBy("v1", "v2", "at")))
            .withColumn("whole", F.max(F.when(F.col("at") == 0, F.struct("first", "h1", "h2"))).over(group)))
    met = rows.filter("at > 0").select("h1", "h2", "first", F.explode(F.array("head", "whole")).alias("other"))
    met = met.filter("other IS NOT NULL AND other.first <> first")
    later = F.col("first") > F.col("other.first")
    own, other = F.struct("h1", "h2"), F.struct("other.h1", "other.h2")
    pairs = met.select(F.when(later, own).otherwise(other).alias("late"), F.when(later, other).otherwise(own).alias("early"))
    pairs = pairs.select(F.col("late.h1").alias("h1"), F.col("late.h2").alias("h2"),
                         F.col("early.h1").alias("k1"), F.col("early.h2").alias("k2")).distinct()
    texts = near.select("h1", "h2", "line")
    both = pairs.join(texts, ["h1", "h2"]).join(texts.selectExpr("h1 AS k1", "h2 AS k2", "line AS earlier"), ["k1", "k2"])
    return both.filter(F.levenshtein("line", "earlier", 1) >= 0).select("h1", "h2", "k1", "k2")


def kept_lines(docs: DataFrame, every: bool = False) -> DataFrame:
    """(_id, _h, line_no): places of compared lines that stay: the earliest of equal lines, unless it is
    long and an earlier different long line is within one edit."""
    distinct = settle(distinct_lines(docs, every), "lines")
    near = settle(near_lines(docs, distinct), "near")
    dropped = settle(near_pairs(near).select("h1", "h2").distinct(), "dropped")
    return distinct.join(small(dropped), ["h1", "h2"], "left_anti").select("first.*")


def line_report(docs: DataFrame, every: bool = False) -> DataFrame:
    """One row per document: doc_id, n_lines, n_long, n_kept, kept_sum; with ``every`` also n_compared.

    Lines are pieces between line feeds. With ``every``, as in the registered query, all lines that are not
    blank are compared for equality and those of at least 20 code points also within an edit; blank lines
    under 20 stay and count nowhere but in ``n_lines``. Without it, only lines of at least 20 take part.
    ``n_long`` counts the lines of at least 20 and ``n_compared`` those that take part; ``n_kept`` counts
    those of them that stay and ``kept_sum`` adds their numbers, from 1. Order is by
    doc_id (null last), a hash of the text, and line number. A null text has no lines. Equal rows share
    their lines: both keep them. An empty table gives no rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = (kept_lines(docs, every).groupBy("_id", "_h").agg(F.count(F.lit(1)).alias("n_kept"),
                                                             F.sum(F.col("line_no") + 1).alias("kept_sum")))
    pieces = F.split(text, "\n", -1)
    size = lambda kind: F.size(F.filter(pieces, lambda x: compared(x, kind))).cast("long")
    more = [size(True).alias("n_compared")] if every else []
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"),
        F.xxhash64(text).alias("_h"), F.when(F.col("text").isNull(), 0).otherwise(F.size(pieces)).cast("long").alias("n_lines"),
        size(False).alias("n_long"), *more)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(kept, ["_id", "_h"], "left").select(
        "doc_id", "n_lines", "n_long", zero("n_kept"), zero("kept_sum"), *["n_compared"] * every)


def cleaned(docs: DataFrame, every: bool = False) -> DataFrame:
    """The documents with the dropped lines taken out of their texts; all columns stay. ``every`` is as in
    ``line_report``: with it, repeats of short lines go too."""
    kept = (kept_lines(docs, every).groupBy("_id", "_h").agg(F.collect_list("line_no").alias("_kept")))  # as long as the document
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = packed_rows(docs, _id=F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), _h=F.xxhash64(text))
    text = F.col("row.text").cast("string")
    stays = F.filter(F.split(text, "\n", -1), lambda x, i: ~compared(x, every) | F.coalesce(
        F.array_contains("_kept", i), F.lit(False)))
    whole = F.col("row").withField("text", F.when(text.isNotNull(), F.array_join(stays, "\n")))
    return unpacked(rows.join(kept, ["_id", "_h"], "left").select(whole.alias("row")))
