"""Readers with declared schemas, and small literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions import fixed_values as fv

CORRUPT = "_corrupt_record"


def read_payload(spark: SparkSession, path: str | None, schema: T.StructType,
                 lines: bool = False) -> DataFrame:
    """Rows of JSON payload files: one object, an array of objects, or one object per line.

    Anything else fails the read; without a path the result is empty. Whole-file JSON is for
    hand-off files; bulk feeds should be line-delimited (``lines=True``) so files can be split.
    """
    if path is None:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema).option("multiLine", not lines)
            .option("mode", "FAILFAST").json(path))


def read_payload_with_rejects(spark: SparkSession, path: str, schema: T.StructType,
                              lines: bool = True) -> DataFrame:
    """As ``read_payload``, but unreadable records arrive as rows with their raw text."""
    with_raw = T.StructType(list(schema) + [T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(with_raw).option("multiLine", not lines)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .json(path))


def read_repo_map(spark: SparkSession, path: str) -> DataFrame:
    """Asset to repository lookup; entries with an empty part are dropped."""
    entries = read_payload(spark, path, schemas.REPO_MAP)
    return entries.filter(
        (F.length("asset_id") > 0) & (F.length("owner") > 0) & (F.length("repo") > 0))


def route_policy(spark: SparkSession) -> DataFrame:
    """Limits per route (four literal rows)."""
    return spark.createDataFrame(fv.ROUTE_POLICY, schemas.ROUTE_POLICY)


def series_names(spark: SparkSession) -> DataFrame:
    """Names of the macro series (four literal rows)."""
    return spark.createDataFrame(list(fv.MACRO_SERIES.items()), "series_id string, series_name string")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """A table as a file stream, whether it is one parquet file or a folder of them;
    ``files_per_batch`` bounds a micro-batch."""
    path, schema = f"{folder.rstrip('/')}/{name}.parquet", read_table(spark, folder, name).schema
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if system.getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
