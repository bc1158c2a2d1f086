"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import run_folder, ship_package

# A word: a run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
# The end of the code range of longs, for keys that must sort nulls first.
LOWEST = -(1 << 63)


# While a table is written, an Arrow batch holds 1,000 rows where the session has Spark's default of 10,000: texts of
# some kilobytes make batches of some megabytes then, on both sides of the pipe.
ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def prepare(spark: SparkSession) -> None:
    """Before Python reads rows: ship this package to the workers."""
    ship_package(spark)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """ARROW_ROWS for what runs inside; the session's own number afterwards."""
    name, default, rows = ARROW_ROWS
    before = spark.conf.get(name)
    if before == default:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
             ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a task's worker, which lives on, gives its free memory back to the system."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return whole


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as a table below the shared folder and go on from there: it is computed once,
    is read by column, and survives the loss of executors. The folder's owner clears it."""
    path = run_folder(df.sparkSession, purpose)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed_rows(df: DataFrame, **names: Column) -> DataFrame:
    """All columns of ``df`` in one struct column ``row`` and the given columns beside it, so that no name clashes."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in names.items()])


def unpacked(df: DataFrame) -> DataFrame:
    """The columns of ``row``."""
    return df.select("row.*")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. ``lower`` does that much faster where no other letter of the
    text has a lower case."""
    return (F.when(text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^\x00-\x7F]]"),
                   F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            .otherwise(F.lower(text)))


def word_count(text: Column, pattern: str = WORD) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def unsigned_crc32(text: Column) -> Column:
    return F.crc32(text.cast("binary"))
