"""Sinks and merges on plain parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import moment
from tidemark.operators.latest import dedup_batch, latest_version


def append_table(df: DataFrame, name: str) -> None:
    df.write.mode("append").format("parquet").saveAsTable(name)


def overwrite_table(df: DataFrame, name: str) -> None:
    """Replace rows and schema."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def overwrite_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the partitions present in ``df`` and leave the others alone.

    The rows are rebalanced by the partition columns: files stay few, and a hot partition is split
    into as many tasks as its measured size asks for.
    """
    (df.hint("rebalance", *by)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))


def write_clustered(df: DataFrame, path: str, cols: Sequence[str]) -> None:
    """Range-clustered layout: narrow min/max statistics per file, so filters on ``cols`` skip
    files. Range bounds come from a sample and split hot ranges over several files."""
    (df.repartitionByRange(*cols).sortWithinPartitions(*cols)
     .write.mode("overwrite").parquet(path))


def publish_table(df: DataFrame, name: str, folder: str) -> str:
    """Replace the rows of the catalog table ``name`` in one statement; returns the new version's folder.

    The rows are written to a folder of their own below ``folder`` first, so ``df`` may read the table, and a run
    that ends before the last statement leaves the old rows in place and readable. Then the table's location moves;
    a view of that name, or a table of another schema, gives way to a new table. Readers see all old rows
    or all new ones. Folders of older versions stay for readers that began with them; their owner clears them."""
    spark, version = df.sparkSession, f"{folder.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.write.parquet(version)
    drop_if_view(spark, name)
    if spark.catalog.tableExists(name):
        fields = lambda schema: [(f.name, f.dataType) for f in schema]
        if fields(spark.table(name).schema) == fields(df.schema):
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{version}'")
            spark.catalog.refreshTable(name)
            return version
        spark.sql(f"DROP TABLE {name}")  # the folders of a table with a location of its own stay
    spark.catalog.createTable(name, version, "parquet", df.schema)
    return version


def ensure_table(spark: SparkSession, name: str, schema: T.StructType,
                 partition_by: Sequence[str] = ()) -> None:
    """Create the table with a declared schema unless it exists."""
    if spark.catalog.tableExists(name):
        return
    writer = spark.createDataFrame([], schema).write.format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def drop_if_view(spark: SparkSession, name: str) -> bool:
    """Make room for a table where a view of that name exists."""
    if not spark.catalog.tableExists(name):
        return False
    if spark.catalog.getTable(name).tableType != "VIEW":
        return False
    spark.sql(f"DROP VIEW {name}")
    return True


def with_handoff_defaults(df: DataFrame, source: str, now: datetime | str | Column) -> DataFrame:
    """Fill ``source`` and ``created_at`` where a row has none."""
    have = set(df.columns)
    existing = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    return (df.withColumn("source", F.coalesce(existing("source"), F.lit(source)))
            .withColumn("created_at", F.coalesce(existing("created_at").cast("timestamp"),
                                                 moment(now))))


def write_handoff(df: DataFrame, path: str, source: str, now: datetime | str | Column) -> None:
    """Hand rows to another job as JSON lines, times with their microseconds."""
    (with_handoff_defaults(df, source, now).write.mode("overwrite")
     .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path))


# Merges ------------------------------------------------------------------------------------------

def new_rows(target: DataFrame, source: DataFrame, keys: Sequence[str],
             order: Sequence[Column] | None = None) -> DataFrame:
    """Source rows whose key the target lacks, one per key. Only the key columns of the target
    are read; repeated keys in it are combined before the exchange the join needs anyway."""
    fresh = dedup_batch(source, keys, order)
    known = target.select(*keys).distinct()
    return fresh.join(known, list(keys), "left_anti").select(*source.columns)


def merge_insert_only(target: DataFrame, source: DataFrame, keys: Sequence[str],
                      order: Sequence[Column] | None = None) -> DataFrame:
    """Target after an insert-only merge: existing rows are kept as they are."""
    return target.unionByName(new_rows(target, source, keys, order))


def append_new_rows(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str],
                    order: Sequence[Column] | None = None, prune_by: str | None = None) -> None:
    """Insert-only merge into the parquet folder ``path``: append what is new, rewrite nothing.

    ``prune_by`` names a key column (a time, usually): the target scan is then limited to the
    range of that column in the batch, so parquet skips the row groups outside it.
    """
    target = _read_or_empty(spark, path, source.schema)
    if prune_by:
        low, high = source.agg(F.min(prune_by), F.max(prune_by)).first()
        target = target.filter(F.col(prune_by).between(F.lit(low), F.lit(high)))
    new_rows(target, source, keys, order).write.mode("append").parquet(path)


def merge_upsert_newest(target: DataFrame, source: DataFrame, keys: Sequence[str],
                        version_col: str) -> DataFrame:
    """Target after an upsert: per key the row with the newest version; on equal versions the
    source wins. Union and group limit: one shuffle, one row per key and map task."""
    columns = target.columns
    both = (target.withColumn("_from_source", F.lit(0))
            .unionByName(source.select(*columns).withColumn("_from_source", F.lit(1))))
    order = [F.col(version_col).desc_nulls_last(), F.col("_from_source").desc()]
    order += [F.col(name).desc_nulls_last() for name in columns
              if name not in keys and name != version_col]
    return latest_version(both, list(keys), order).select(*columns)


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def replace_folder(df: DataFrame, path: str) -> None:
    """Write next to ``path`` and swap, so ``df`` may read from ``path`` and a failed write
    leaves the old rows in place."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    final, fresh, old = (hadoop.Path(path + suffix) for suffix in ("", "__new", "__old"))
    system = final.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(path + "__new")
    if system.exists(final):
        system.delete(old, True)
        system.rename(final, old)
    system.rename(fresh, final)
    system.delete(old, True)
