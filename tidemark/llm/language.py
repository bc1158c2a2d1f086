"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of the last bytes, up to ORDER of them, with counts of the byte that
followed, frozen after fitting. A byte costs -log2 of its share where its context knows it; else an
escape is paid and the next shorter context is asked, down to an even guess among 256 bytes. The
language in which a whole text has the shortest code wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, released, settle


ORDER = 3  # bytes of the longest context
FIT_DOCUMENTS = 1000  # expected number of whole texts per language from which the trees are grown
CHUNK = 1 << 20  # text bytes scored at once
UNKNOWN = "und"
START = b"\n" * ORDER  # what stands before a text

_WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a code point of the text is a letter (category L)."""
    return any(m[0].isalpha() for m in _WORD.finditer(text))


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(each byte of the texts with the ORDER bytes before it as one number, lengths of the texts)."""
    raw = np.frombuffer(b"".join(START + t for t in texts), np.uint8).astype(np.uint32)
    number = raw.copy()
    for k in range(1, ORDER + 1):
        number[k:] |= raw[:-k] << np.uint32(8 * k)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    real = np.ones(len(raw), bool)
    for at in (np.cumsum(lengths + ORDER) - lengths - ORDER).tolist():
        real[at:at + ORDER] = False
    return number[real], lengths


class Trees:
    """Code lengths of bytes under the frozen counts of all languages."""

    def __init__(self, rows: list[tuple[str, int, int]]) -> None:
        self.languages = sorted({lang for lang, _, _ in rows})
        place = {lang: i for i, lang in enumerate(self.languages)}
        number = np.array([g for _, g, _ in rows], np.uint32)
        lang = np.array([place[x] for x, _, _ in rows], np.int64)
        n = np.array([c for _, _, c in rows], np.float64)
        self.levels = []
        for order in range(ORDER + 1):
            known, at = np.unique(number & _mask(order + 1), return_inverse=True)
            count = np.zeros((len(known), len(self.languages)))
            np.add.at(count, (at, lang), n)
            context, up = np.unique(known >> np.uint32(8), return_inverse=True)
            total, distinct = np.zeros((2, len(context), len(self.languages)))
            np.add.at(total, up, count)
            np.add.at(distinct, up, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                all_ = (total + distinct)[up]
                bits = np.where(count > 0, np.log2(all_) - np.log2(count), np.nan)
                escape = np.where(total > 0, np.log2(total + distinct) - np.log2(distinct), 0)
            self.levels.append((known, bits.astype(np.float32), context, escape.astype(np.float32)))

    def bits(self, numbers: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte in every language."""
        cost = np.zeros((len(numbers), len(self.languages)), np.float32)
        open_ = np.ones(cost.shape, bool)
        for order in range(ORDER, -1, -1):
            known, bits, context, escape = self.levels[order]
            gram = numbers & _mask(order + 1)
            at = np.searchsorted(known, gram).clip(max=len(known) - 1)
            here = np.where((known[at] == gram)[:, None], bits[at], np.nan)
            found = open_ & ~np.isnan(here)
            cost[found] += here[found]
            open_ &= ~found
            above = gram >> np.uint32(8)
            at = np.searchsorted(context, above).clip(max=len(context) - 1)
            paid = np.where((context[at] == above)[:, None], escape[at], 0)
            cost += np.where(open_, paid, 0)
        return cost + np.where(open_, np.float32(8), 0)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each whole text in every language; texts must not be empty."""
        numbers, sizes = grams(texts)
        distinct, at = np.unique(numbers, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(self.bits(distinct)[at], starts, axis=0, dtype=np.float64)


def _mask(size: int) -> np.uint32:
    return np.uint32((1 << 8 * size) - 1)


def _runs(texts: list[bytes]) -> Iterator[list[int]]:
    """Indexes of texts, in runs of about CHUNK bytes."""
    run, held = [], 0
    for i, text in enumerate(texts):
        run.append(i)
        held += len(text)
        if held >= CHUNK:
            yield run
            run, held = [], 0
    if run:
        yield run


def fit(docs: DataFrame, per_language: int = FIT_DOCUMENTS) -> Trees:
    """Trees from a sample of labelled documents outside the held-out fold.

    ``per_language`` bounds the expected number of documents per language; a hash of doc_id draws them,
    at a rate taken from a count of all. The counts of the sample come to the driver, as many as it has
    distinct grams; a row per language too."""
    labelled = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select(
        "doc_id", F.col("lang").cast("string").alias("lang"), "text").filter(fold(F.col("doc_id")) != 2)
    rates = {r.lang: min(1.0, per_language / r["n"])
             for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not rates:
        return Trees([])
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("lang"))
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1 << 40)) / F.lit(float(1 << 40))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch["lang"].to_pylist(), batch["text"].to_pylist()
            for lang in sorted(set(langs)):
                own = [t.encode("utf-8", "replace") for t, x in zip(texts, langs) if x == lang]
                for run in _runs(own):
                    number, n = np.unique(grams([own[i] for i in run])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(number.astype(np.int64)),
                                                      pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    sample = labelled.filter(unit < rate).select("lang", "text")
    rows = (sample.mapInArrow(released(count), "lang string, gram long, n long").groupBy("lang", "gram")
            .agg(F.sum("n").alias("n")).collect())
    return Trees([tuple(r) for r in rows])


def identify(docs: DataFrame, per_language: int = FIT_DOCUMENTS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    ``score`` is the winner's posterior under equal priors; ties go to the first language by code point.
    A null text or one without a letter, or any text where no language could be learned, gives ``und``
    with score 0. A null doc_id is in no fold: it is neither learned from nor held out. Rows are judged
    one by one from the text alone, so repeated rows agree; an empty table gives no rows."""
    spark = docs.sparkSession
    prepare(spark)
    trees = spark.sparkContext.broadcast(fit(docs, per_language))  # bounded by the sample
    names = ["doc_id", "held_out", "lang_pred", "score"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trees.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            some = [i for i, t in enumerate(texts) if t and model.languages and has_letter(t)]
            raw = [texts[i].encode("utf-8", "replace") for i in some]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for run in _runs(raw):
                bits = model.lengths([raw[i] for i in run])
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(-(bits - bits.min(axis=1, keepdims=True)).clip(max=1000)).sum(axis=1)
                for k, i in enumerate(run):
                    lang[some[i]], score[some[i]] = model.languages[best[k]], float(share[k])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(lang, pa.string()),
                                              pa.array(score, pa.float64())], names)

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(fold(doc_id) == 2, F.lit(False)).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return settle(rows.mapInArrow(released(predict), "doc_id long, held_out boolean, lang_pred string, score double"), "languages")
