"""Quality rules with thresholds that adapt to each language and source.

Counts per document feed mergeable quantile sketches (counts per bucket of at most 1/32 relative
width, so merging is adding), one per language, source and measure. Sketches of sources merge into
those of languages and of the whole table, which stand in where a source has few documents. Fences
beyond the upper quartile (and below the lower one) are joined back to the documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WORD, packed_rows, prepare, released, settle, unpacked

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCUMENTS = 50  # a sketch of fewer documents gives way to the next wider one
FENCE = 6  # widths beyond a quartile
# measure -> (least width, lower fence too): hundredths of a character per word, else per mille.
MEASURES = {"word_length": (100, True), "symbols": (40, False), "dup_lines": (80, False),
            "repeats": (50, False), "capitals": (50, False)}

_WORD = re.compile(WORD)
_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = bytearray(len(words))
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered[i:i + 3] = b"\1\1\1"
    return sum(covered)


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of ``_COUNTS`` for one text; all 0 for null."""
    if not text:
        return (0,) * len(_COUNTS)
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    raw = text.encode("utf-8", "replace")
    return (len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines),
            len(raw) - len(raw.translate(None, _CAPITALS)))


def counted(docs: DataFrame, packed: bool = False) -> DataFrame:
    """Adds ``_counts``, a struct of ``_COUNTS``, to the rows; all their columns stay. The text is in the column
    ``text``, or in that field of the column ``row``."""
    prepare(docs.sparkSession)
    kind = T.StructType([T.StructField(name, T.LongType()) for name in _COUNTS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["row"].field("text") if packed else batch["text"]
            rows = [text_counts(text.as_py()) for text in texts]
            columns = list(zip(*rows)) or [()] * len(_COUNTS)
            counts = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], _COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], [*batch.schema.names, "_counts"])

    return docs.mapInArrow(released(count), T.StructType([*docs.schema.fields, T.StructField("_counts", kind)]))


def _measures(within: str = "") -> dict[str, Column]:
    def share(part: str, whole: str, scale: int) -> Column:
        part, whole = within + part, within + whole
        return F.expr(f"CASE WHEN {whole} = 0 THEN 0L ELSE {part} * {scale} div {whole} END")
    return {"word_length": share("word_chars", "n_words", 100),
            "symbols": share("n_symbols", "word_chars", 1000),
            "dup_lines": share("n_dup_lines", "n_lines", 1000),
            "repeats": share("n_repeat_words", "n_words", 1000),
            "capitals": share("n_capitals", "word_chars", 1000)}


def bucket(value: str) -> Column:
    """The lower end of a value's bucket: its six leading binary digits."""
    shift = f"greatest(length(bin({value})) - 6, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {shift}), {shift})")


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, bucket, n): sketches of documents with a word that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES]))
    return (measured.filter("NOT base_failed").select(*keys, pairs.alias("pair"))
            .select(*keys, "pair.measure", bucket("pair.value").alias("bucket"))
            .groupBy(*keys, "measure", "bucket").agg(F.count(F.lit(1)).alias("n")))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, low_<measure>, high_<measure>): quartiles read from the sketches, then the fences.

    A window holds one sketch, some hundred buckets at most."""
    part = Window.partitionBy(*keys, "measure")
    ranked = (sketch.withColumn("total", F.sum("n").over(part))
              .withColumn("upto", F.sum("n").over(part.orderBy("bucket").rowsBetween(
                  Window.unboundedPreceding, 0))))
    quartiles = ranked.groupBy(*keys, "measure").agg(
        F.max("total").alias("n"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("q3"))
    cuts = []
    for name, (least, lower) in MEASURES.items():
        here = F.col("measure") == name
        width = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * FENCE
        cuts.append(F.max(F.when(here, F.col("q3") + width)).alias(f"high_{name}"))
        if lower:
            cuts.append(F.max(F.when(here, F.col("q1") - width / 2)).cast("long").alias(f"low_{name}"))
    return quartiles.groupBy(*keys).agg(F.max("n").alias("n"), *cuts)


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, cuts): a source's own cuts, else its language's, else those of all documents."""
    own = sketches(measured, ["lang", "source"])
    by_lang, overall = merged(own, ["lang"]), merged(own, [])
    names = [c for m, (_, lower) in MEASURES.items() for c in ([f"high_{m}", f"low_{m}"] if lower else [f"high_{m}"])]

    def named(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
        return df.select(*keys, *[F.when(F.col("n") >= MIN_DOCUMENTS, F.col(c)).alias(f"{tag}_{c}")
                                  if tag != "all" else F.col(c).alias(f"all_{c}") for c in names])

    source = named(fences(own, ["lang", "source"]), ["lang", "source"], "own").alias("s")
    lang = named(fences(by_lang, ["lang"]), ["lang"], "lang").alias("l")
    whole = named(fences(overall, []), [], "all")
    joined = source.join(lang, F.col("s.lang").eqNullSafe(F.col("l.lang")), "left")
    joined = joined.join(F.broadcast(whole), F.lit(True), "left")  # one row
    return joined.select("s.lang", "s.source", *[
        F.coalesce(f"own_{c}", f"lang_{c}", f"all_{c}").alias(c) for c in names])


_BASE = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
BROADCAST_ROWS = 10_000  # thresholds of more languages and sources are joined by a shuffle


def measured_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, the counts, base_failed, the measures), one row per document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return (counted(slim).select("doc_id", "lang", "source", "_counts.*")
            .withColumn("base_failed", F.expr(_BASE)).withColumns(_measures()))


def beyond(measure: Column, cuts: Column) -> Column:
    """Whether one of the measures in a struct lies outside the fences in another."""
    outside = F.lit(False)
    for name, (_, lower) in MEASURES.items():
        out = measure[name] > cuts[f"high_{name}"]
        if lower:
            out = out | (measure[name] < cuts[f"low_{name}"])
        outside = outside | F.coalesce(out, F.lit(False))
    return outside


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept and the measures.

    The base rules reject texts under 50 words and texts of which over half the words repeat; a text
    without words (null, empty, white space) fails them. All others are kept unless a measure lies
    beyond the fence of their language and source (null is a language or source of its own). With
    ties and repeated rows each row is judged alone. An empty table gives no rows.
    """
    measured = settle(measured_counts(docs), "measured")
    cuts = thresholds(measured).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                                       F.struct("*").alias("cuts"))
    joined = measured.join(cuts, F.col("lang").eqNullSafe(F.col("_lang"))
                           & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select("doc_id", *_COUNTS, "base_failed",
                         (~F.col("base_failed") & ~beyond(F.struct(*MEASURES), F.col("cuts"))).alias("kept"),
                         *MEASURES)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns, judged one by one: so ties and repeated rows go or
    stay together, and null, empty and wordless texts go. An empty table gives no rows.

    Counts are taken once for the thresholds and once more beside the texts, which so need no
    shuffle unless there are over BROADCAST_ROWS thresholds."""
    cuts = settle(thresholds(settle(measured_counts(docs), "measured")).select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct("*").alias("_cuts")), "cuts")
    if cuts.count() <= BROADCAST_ROWS:
        cuts = F.broadcast(cuts)
    rows = counted(packed_rows(docs, own_lang=F.col("lang").cast("string"), own_source=F.col("source").cast("string")), packed=True)
    joined = rows.join(cuts, F.col("own_lang").eqNullSafe(F.col("_lang"))
                       & F.col("own_source").eqNullSafe(F.col("_source")), "left")
    inner = "_counts."
    failed = F.expr(re.sub(r"\bn_", inner + "n_", _BASE))
    measures = F.struct(*[c.alias(m) for m, c in _measures(inner).items()])
    return unpacked(joined.filter(~failed & ~beyond(measures, F.col("_cuts"))))
