"""Benchmark decontamination by a distributed positional inverted index.

Words of the benchmark are counted over all training documents. Every window of an item is looked up
by its rarest words only: their postings (word, document, position) are stored, and lists shifted by
the word's place in the item are intersected, which leaves (document, item, shift). There the words
of the document and of the item are compared one by one; runs as long as a window are phrase matches.
Words of one item close together but at another distance than in it are proximity matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWEST, ascii_lower, packed_rows, settle, unpacked, word_count

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ITEM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10  # words
RAREST = 2  # words of a window whose lists are intersected
SEGMENT = 256  # words of a document compared at once
BROADCAST_ROWS = 100_000  # longer lists of words or documents are joined by a shuffle


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATOR), "")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _id, _h): a key that also serves null and repeated ids; rows with equal keys are
    equal and share their result."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), text.alias("text"),
                       F.coalesce(doc_id, F.lit(LOWEST)).alias("_id"), F.xxhash64(text).alias("_h"))


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast only if it is no longer than BROADCAST_ROWS."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def item_words(benchmark: DataFrame) -> DataFrame:
    """(iid, item_id, words): items with a word; iid names the row."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                            words(F.coalesce("text", F.lit(""))).alias("words"))
    return settle(rows.filter(F.size("words") > 0).select(
        F.monotonically_increasing_id().alias("iid"), "item_id", "words"), "items")


def word_counts(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n) over all documents, for words of ``vocabulary``."""
    tokens = texts.select(F.explode(words(F.col("text"))).alias("word"))
    return tokens.join(small(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(iid, word, place): of every window its rarest words."""
    places = (items.select("iid", F.posexplode("words").alias("place", "word")).join(counts, "word", "left")
              .groupBy("iid").agg(F.array_sort(F.collect_list(F.struct(
                  "place", F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("all")))  # as long as the item
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    chosen = F.transform(starts, lambda i: F.slice(F.array_sort(F.transform(
        F.slice("all", i + 1, window), lambda x: F.struct(x["n"].alias("n"), x["place"].alias("place"),
                                                          x["word"].alias("word")))), 1, rarest))
    return (places.select("iid", F.explode(F.array_distinct(F.flatten(chosen))).alias("a"))
            .select("iid", "a.word", "a.place"))


def postings(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The index: (word, _id, _h, position) of the words of ``vocabulary`` in all documents."""
    tokens = texts.select("_id", "_h", F.posexplode(words(F.col("text"))).alias("position", "word"))
    return settle(tokens.join(small(vocabulary), "word"), "postings")


def shifts(index: DataFrame, anchor: DataFrame, items: DataFrame) -> DataFrame:
    """(_id, _h, iid, shift): shifts of an item against a document at which at least two of its
    anchors (one, if it has no more words) stand in place. Every window has two anchors, so no match is lost."""
    lists = index.join(small(anchor), "word").withColumn("shift", F.col("position") - F.col("place"))
    met = lists.groupBy("_id", "_h", "iid", "shift").agg(F.min("place").alias("a"), F.max("place").alias("z"))
    sizes = small(items.select("iid", F.size("words").alias("n_item")))
    return met.join(sizes, "iid").filter("a < z OR n_item = 1").select("_id", "_h", "iid", "shift", "n_item")


def _runs(equal: Column, least: Column) -> Column:
    """array<struct<from, to>>: maximal runs of true with at least ``least`` entries."""
    none = F.array().cast("array<struct<from:int,to:int>>")

    def step(state: Column, x: Column) -> Column:
        at = state["at"] + 1
        ended = ~x & (state["run"] >= least)
        return F.struct(at.alias("at"), F.when(x, state["run"] + 1).otherwise(0).alias("run"),
                        F.when(ended, F.concat(state["out"], F.array(F.struct(
                            (state["at"] - state["run"]).alias("from"), state["at"].alias("to")))))
                        .otherwise(state["out"]).alias("out"))

    return F.aggregate(F.concat(equal, F.array(F.lit(False))), F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("run"), none.alias("out")), step, lambda s: s["out"])


def phrase_matches(texts: DataFrame, items: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_id, _h, iid, start, end): runs of document words equal to a run of item words of at least a
    window (the whole item, if shorter). Documents are compared in segments that overlap by a window."""
    documents = settle(found.select("_id", "_h").distinct(), "candidates")
    held = texts.join(small(documents), ["_id", "_h"]).dropDuplicates(["_id", "_h"])
    split = held.select("_id", "_h", words(F.col("text")).alias("words"))
    segments = (split.select("_id", "_h", F.size("words").alias("n"), "words")
                .select("_id", "_h", F.explode(F.transform(
                    F.sequence(F.lit(0), F.expr(f"(n - 1) div {SEGMENT}").cast("int")),
                    lambda s: F.struct(s.alias("segment"), F.slice(
                        "words", s * SEGMENT + 1, SEGMENT + window - 1).alias("have")))).alias("x"))
                .select("_id", "_h", "x.segment", "x.have"))
    low = F.greatest(F.col("shift"), F.lit(0))
    cut = found.filter("shift + n_item > 0").withColumn("segment", F.explode(F.expr(
        f"sequence(cast(greatest(shift, 0) div {SEGMENT} as int), cast((shift + n_item - 1) div {SEGMENT} as int))")))
    both = cut.join(segments, ["_id", "_h", "segment"]).join(items.select("iid", F.col("words").alias("want")), "iid")
    base = F.col("segment") * SEGMENT
    first = F.greatest(low, base)  # first word compared
    last = F.least(F.col("shift") + F.col("n_item"), base + F.size("have"))
    both = both.withColumn("first", first.cast("int")).withColumn("size", F.greatest(last.cast("int") - F.col("first"), F.lit(0)))
    equal = F.zip_with(F.slice("have", F.col("first") - base + 1, F.col("size")),
                       F.slice("want", F.col("first") - F.col("shift") + 1, F.col("size")), lambda a, b: a == b)
    runs = _runs(equal, F.least(F.lit(window), F.col("n_item")))
    return (both.select("_id", "_h", "iid", "first", F.explode(runs).alias("r"))
            .select("_id", "_h", "iid", (F.col("first") + F.col("r.from")).alias("start"),
                    (F.col("first") + F.col("r.to")).alias("end")))


def proximity_matches(index: DataFrame, anchor: DataFrame, slop: int = 5) -> DataFrame:
    """(_id, _h, iid, near): documents in which two anchors of an item stand at most ``slop`` words off
    their distance in the item, but not at it; ``near`` counts the postings that have one of another place of the
    item at a shift less by 1 to ``slop``.

    The shifts of an item's anchors in a document are sorted; the least and the last place among the shifts in
    reach tell whether another place is there. Places of one shift share that, and a place has a shift once, so
    a frame holds at most ``slop`` times the item's anchors. Equal rows count once."""
    keys = ["_id", "_h", "iid"]
    shift = F.col("position") - F.col("place")
    lists = index.join(small(anchor), "word").select(*keys, "place", shift.alias("shift")).repartition(*keys).distinct()
    reach = Window.partitionBy(*keys).orderBy("shift").rangeBetween(-slop, -1)
    near = lists.withColumn("least", F.min("place").over(reach)).withColumn("last", F.max("place").over(reach))
    return near.filter("least <> place OR last <> place").groupBy(*keys).agg(F.count(F.lit(1)).alias("near"))


def indexed(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(texts, items, index, anchors) of documents and benchmark."""
    texts, items = keyed(docs), item_words(benchmark)
    vocabulary = settle(items.select(F.explode("words").alias("word")).distinct(), "vocabulary")
    counts = settle(word_counts(texts, vocabulary), "counts")
    anchor = settle(anchors(items, counts), "anchors")
    return texts, items, postings(texts, settle(anchor.select("word").distinct(), "rarest")), anchor


def matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(texts, items, phrase matches, (index, anchors)) of documents and benchmark."""
    texts, items, index, anchor = indexed(docs, benchmark)
    found = settle(shifts(index, anchor, items), "shifts")
    return texts, items, phrase_matches(texts, items, found), (index, anchor)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, n_near_items.

    A word is hit if it lies in an occurrence of any window of 10 consecutive item words (of all words of
    a shorter item). ``n_near`` adds the counts of ``proximity_matches``, ``n_near_items`` counts the items with
    one; they do not make a document contaminated. A null, empty or wordless text has no words and no hits;
    wordless items have no windows; items without an item_id hit words but are not listed; repeated rows each
    get the full result. An empty table gives no rows, an empty benchmark no hits."""
    texts, items, found, (index, anchor) = matches(docs, benchmark)
    found = settle(found.join(items.select("iid", "item_id"), "iid"), "matches")
    order = Window.partitionBy("_id", "_h").orderBy("start", "end")
    before = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = F.greatest(F.col("end") - F.greatest("start", before), F.lit(0))
    hits = (found.select("_id", "_h", "start", "end").distinct().withColumn("new", covered)
            .groupBy("_id", "_h").agg(F.sum("new").alias("n_hit")))
    # One string per document, as long as the list of its items.
    listed = (found.select("_id", "_h", "item_id").filter("item_id IS NOT NULL").distinct().groupBy("_id", "_h")
              .agg(F.array_sort(F.collect_list("item_id")).alias("items")))
    near = (proximity_matches(index, anchor).groupBy("_id", "_h")
            .agg(F.sum("near").alias("n_near"), F.count(F.lit(1)).alias("n_near_items")))
    counted = texts.select("doc_id", "_id", "_h", word_count(F.col("text"), ITEM_WORD).alias("n_words"))
    result = settle(hits.join(listed, ["_id", "_h"], "left").join(near, ["_id", "_h"], "full"), "found")
    joined = counted.join(result, ["_id", "_h"], "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    n_hit, n_near, n_near_items = (F.coalesce(c, F.lit(0)).cast("long") for c in ("n_hit", "n_near", "n_near_items"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                         F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
                         n_near.alias("n_near"), n_near_items.alias("n_near_items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a phrase match, with all their columns.

    Rows are judged by doc_id and text, so repeated rows go or stay together; null, empty and wordless texts
    stay. An empty table gives no rows, an empty benchmark takes none away."""
    _, _, found, _ = matches(docs, benchmark)
    hit = settle(found.select("_id", "_h").distinct(), "contaminated")
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return unpacked(packed_rows(docs, _id=F.coalesce(doc_id, F.lit(LOWEST)), _h=F.xxhash64(text))
                    .join(small(hit), ["_id", "_h"], "left_anti"))
