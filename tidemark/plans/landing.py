"""Landing runs: feed files into their tables, what does not fit into quarantine, then the gate.

A landing has a name. Its rows and its rejects lie in folders of that name, which a rerun of the landing
replaces, so nothing is there twice and no older row is read. The market table is the exception: its rows
have a key, and a landing inserts the keys that the table lacks.

Every record of the files ends up in one of the two places. A record that is no object of the feed, and a
value that the table's type cannot hold, are reasons like those of the feed's own rules. Files without
records land an empty folder.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions.columns import blank_to_null, labels_where, moment
from tidemark.operators import validate
from tidemark.operators.latest import dedup_batch
from tidemark.operators.validate import REASONS, Checked
from tidemark.sources import readers, writers
from tidemark.sources.align import conform

RECORD = "record"  # a feed record as JSON text, or the text that could not be read
BROKEN = "broken"  # whether it could not be read
UNREADABLE = "unreadable"
KEPT = [RECORD, BROKEN]
QUARANTINE = T.StructType([
    T.StructField("feed", T.StringType()), T.StructField(RECORD, T.StringType()),
    T.StructField(REASONS, T.ArrayType(T.StringType())), T.StructField("landed_at", T.TimestampType())])


class Feed(NamedTuple):
    """What a feed's files hold, the table they go to, and the rules between; the judged rows have the columns KEPT."""

    files: T.StructType
    table: T.StructType
    judge: Callable[[DataFrame, Column], Checked]
    required: str  # a column without nulls, which the gate looks at
    once: tuple[str, ...] = ()  # one row per key stays of a landing; without a key every row does
    merged: tuple[str, ...] = ()  # keys that the whole table holds once


class Landed(NamedTuple):
    rows: int  # good ones, repeats of a key left out
    rejects: int


def _market(rows: DataFrame, now: Column) -> Checked:
    return validate.validate_market(validate.normalize_market(rows, now, keep=KEPT))


def _protocols(rows: DataFrame, now: Column) -> Checked:
    return validate.validate_protocols(rows, now, keep=KEPT)


def _macro(rows: DataFrame, now: Column) -> Checked:
    judged = validate.validate_observations(rows, readers.series_names(rows.sparkSession), now, record=RECORD).checked
    # a record that could not be read has no observations to judge
    return Checked(judged.withColumn(BROKEN, F.lit(False)).unionByName(
        rows.filter(BROKEN).select(*KEPT, F.array().cast("array<string>").alias(REASONS)), allowMissingColumns=True))


def _repos(rows: DataFrame, now: Column) -> Checked:
    checked = validate.check(rows, validate.missing(["asset_id", "owner", "repo"])).checked
    kept = [*KEPT, REASONS]
    return Checked(validate.normalize_activity(validate.repo_activity(checked, now, kept), now, kept))


_RECORD_KEY = ("source_system", "source_record_id")
FEEDS = {
    "market": Feed(schemas.MARKET_FEED, schemas.BRONZE_MARKET, _market, "asset_id", merged=("asset_id", "observed_at")),
    "protocols": Feed(schemas.PROTOCOL_FEED, schemas.BRONZE_PROTOCOLS, _protocols, "protocol_slug", _RECORD_KEY),
    "macro": Feed(schemas.MACRO_FEED, schemas.BRONZE_MACRO, _macro, "series_id", _RECORD_KEY),
    "repos": Feed(schemas.REPO_FEED, schemas.BRONZE_REPOS, _repos, "asset_id", _RECORD_KEY),
    "usage": Feed(schemas.USAGE_FEED, schemas.USAGE_EVENTS, lambda rows, now: validate.validate_usage(rows), "request_id"),
    "runs": Feed(schemas.RUN_FEED, schemas.JOB_RUNS, lambda rows, now: validate.validate_runs(rows), "job_name"),
    "alerts": Feed(schemas.ALERT_FEED, schemas.ALERTS, lambda rows, now: validate.validate_alerts(rows), "kind"),
}


def _fits(checked: Checked, table: T.StructType) -> Checked:
    """Adds a reason for each value that the type of its column in ``table`` cannot hold."""
    rows = checked.checked
    lost = [(blank_to_null(F.col(f.name).cast("string")).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(),
             f"invalid:{f.name}") for f in table if f.name in rows.columns]
    return Checked(rows.withColumn(REASONS, F.when(F.col(BROKEN), F.array(F.lit(UNREADABLE)))
                                   .otherwise(F.array_union(REASONS, labels_where(lost)))))


def landing_name(feed_path: str | None, now: datetime | str) -> str:
    """The name of a landing that was given none: its files and its time, so a retry has the same."""
    return hashlib.md5(f"{feed_path}|{now}".encode()).hexdigest()


def _replace(df: DataFrame, path: str, landing: str) -> int:
    """Write the folder of a landing; its rows, counted from the footers."""
    folder = f"{path.rstrip('/')}/landing={landing}"
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder).count()


def land(spark: SparkSession, name: str, feed_path: str | None, table_path: str, quarantine_path: str,
         now: datetime | str, landing: str | None = None, lines: bool = True, min_rows: int = 0) -> Landed:
    """Files of the feed ``name`` into its table; raises ``ValueError`` where the gate finds less than
    ``min_rows`` rows, or nulls in the required column, in what the landing wrote (market: in the table).

    ``lines`` tells JSON lines, whose files can be split, from whole-file JSON. Without a path nothing lands."""
    feed, at = FEEDS[name], moment(now)
    landing = landing or landing_name(feed_path, now)
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", landing):
        raise ValueError("a landing's name has letters, digits, '_', '.' and '-' only")
    fields = [f.name for f in feed.files]
    if feed_path is None:
        read = spark.createDataFrame([], T.StructType([*feed.files, T.StructField(readers.CORRUPT, T.StringType())]))
    else:
        read = readers.read_payload_with_rejects(spark, feed_path, feed.files, lines)
    text = F.col(readers.CORRUPT)
    read = (read.withColumns({RECORD: F.coalesce(text, F.to_json(F.struct(*fields))), BROKEN: text.isNotNull()})
            .drop(readers.CORRUPT))
    # judged once; what follows reads the judged rows, or computes those that went with an executor
    held = _fits(feed.judge(read, at), feed.table).checked.persist()
    try:
        checked = Checked(held)
        rejects = checked.quarantine.select(F.lit(name).alias("feed"), RECORD, REASONS, at.alias("landed_at"))
        good = conform(checked.good, feed.table)
        rejected = _replace(rejects, quarantine_path, landing)
        if feed.merged:
            good = good.withColumn("symbol", F.upper("symbol"))
            writers.append_new_rows(spark, table_path, good, list(feed.merged), prune_by=feed.merged[-1])
            rows = dedup_batch(good, list(feed.merged)).count()
            written = landed_rows(spark, table_path, feed.table)
        else:
            rows = _replace(dedup_batch(good, list(feed.once)) if feed.once else good, table_path, landing)
            written = landed_rows(spark, f"{table_path.rstrip('/')}/landing={landing}", feed.table)
        validate.assert_quality(written, min_rows, [feed.required])
        return Landed(rows, rejected)
    finally:
        held.unpersist()


def landed_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all landings below ``path``, in the columns of the table (or QUARANTINE)."""
    return writers._read_or_empty(spark, path, schema).select(*[f.name for f in schema])
