"""Insert-only ingest of a folder of JSON feeds, with rejects kept once per micro-batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tidemark import schemas
from tidemark.operators.validate import REASONS, Checked, normalize_market, validate_market
from tidemark.sources.align import to_bronze_market
from tidemark.sources.writers import append_new_rows


RAW = "raw_line"
UNREADABLE = "unreadable"


def market_stream(spark: SparkSession, in_path: str, files_per_batch: int = 1000) -> DataFrame:
    """Feed files (JSON lines) as typed rows with the reasons against each. A line that is no JSON object of the
    feed is a row too: its text is in ``raw_line`` and its only reason is ``unreadable``."""
    fields = T.StructType([*schemas.MARKET_FEED, T.StructField(RAW, T.StringType())])
    feed = (spark.readStream.schema(fields).option("maxFilesPerTrigger", files_per_batch)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW).json(in_path))
    rows = validate_market(normalize_market(feed, F.current_timestamp(), keep=[RAW])).checked
    return rows.withColumn(REASONS, F.when(F.col(RAW).isNull(), F.col(REASONS)).otherwise(F.array(F.lit(UNREADABLE))))


def quarantine_folder(path: str, checkpoint: str, epoch: int) -> str:
    """The rejects of one micro-batch. Batches are counted per checkpoint, so its name is part of the folder's."""
    return f"{path}/stream={hashlib.md5(checkpoint.encode()).hexdigest()}/batch={epoch}"


def stream_ingest(rows: DataFrame, out_path: str, checkpoint: str,
                  keys: Sequence[str] = ("asset_id", "observed_at"), ts: str = "observed_at",
                  quarantine_path: str | None = None,
                  finish: Callable[[DataFrame], DataFrame] | None = to_bronze_market
                  ) -> DataStreamWriter:
    """Writer that inserts each key once.

    Each micro-batch is merged into the target: repeats in it, keys that are there already, and
    batches replayed after a failure add nothing, while a late or back-filled row is new and comes
    in however old it is. The merge reads the target only in the time range of the batch. Rows that
    failed their checks (a non-empty list of reasons) go to ``quarantine_path``, if one is given, in a folder
    of the micro-batch that a replay of it replaces.
    """
    keys = list(keys)

    def insert(batch: DataFrame, epoch: int) -> None:
        held = batch.persist()
        checked = Checked(held) if REASONS in held.columns else None
        good = held if checked is None else checked.good.drop(RAW)
        if checked is not None and quarantine_path:
            bad, folder = checked.quarantine, quarantine_folder(quarantine_path, checkpoint, epoch)
            if not bad.isEmpty():
                bad.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)
        good = finish(good) if finish else good
        if not good.isEmpty():
            append_new_rows(batch.sparkSession, out_path, good, keys, prune_by=ts)
        held.unpersist()

    return rows.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
