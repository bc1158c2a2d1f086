"""Documents with every odd case, and small corpora, for the corpus operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside; documents may have columns of these names.
EXTRA = "size long, kept boolean, key string, word string, line string, v long, shard int, n_words long, start long, "
EXTRA += ("_id long, _h long, _hash long, _nth int, _kept int, _counts int, _times int, _text string, _lang string, _l string, _cuts int, "
          "row int, times int, hash long, row_hash long, text_hash long, nth int, id long, own_lang string")
DATA = "/root/testdata/sf0.001"


def prose(rng: random.Random, n: int, words: list[str] | None = None) -> str:
    words = words or [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "so", "ba", "ne") for b in (
        "ran", "dol", "fis", "gem", "hut", "jon", "ket", "lum", "nop", "paq")]
    return " ".join(rng.choice(words) for _ in range(n))


def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    long_text = "\n".join(prose(rng, 40) for _ in range(400))  # some 100,000 characters
    shared = prose(rng, 80)
    return [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\x0b ", None, None, None),
        (4, long_text, "en", "a", len(long_text)), (5, shared, "en", None, 1), (6, shared, None, "b", 1),
        (6, shared, None, "b", 1), (None, shared, "en", "b", 1), (None, None, None, None, None),
        (7, "ÀÉß ŒUVRE 中文字符 𝔘𝔫𝔦 😀 ǅ İ ²½", "fr", "c", 9), (8, "one two three", "en", "c", 3), (-9, shared + " end", "en", "c", 1),
        (9, "x" * 5000, "en", "a", 5000), (10, "12345 67890 !!!", "en", "a", 5), (10, prose(rng, 70), "en", "a", 5)]


def frame(spark: SparkSession, rows: list[tuple], extra: bool = False) -> DataFrame:
    if extra:
        extra = (1, True, "k", "w", "l", 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, "t", "la", "l2", 13, 14, 15, 16, 17, 18, 19, 20, "o")
        return spark.createDataFrame([(*r, *extra) for r in rows], f"{SCHEMA}, {EXTRA}")
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark: SparkSession) -> DataFrame:
    return frame(spark, odd_rows(), extra=True)


def empty(spark: SparkSession) -> DataFrame:
    return frame(spark, [])


def real(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{DATA}/documents.parquet")
