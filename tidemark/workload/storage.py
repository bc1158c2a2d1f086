"""Queries that write tables and streams and read them back: sinks, merges, ingest, admission.

Each run writes to a new folder below the shared one.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions.columns import moment
from tidemark.operators import validate
from tidemark.plans import incremental, landing
from tidemark.session import run_folder
from tidemark.sources import align, layout, readers, writers
from tidemark.workload.roles import AS_OF, role
from tidemark.workload.text import admission_sql
from tidemark.workload.views import Views, sql

QUERIES: dict = {}

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def query(name: str, text: str | None = None, round6: str = ""):
    def register(build):
        QUERIES[name] = (build, sql(text, round6) if text else None)
        return build
    return register


@query("overwrite_partitioned", """
  SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag FROM lineitem
  WHERE l_returnflag <> 'A'
  UNION ALL SELECT l_orderkey, l_linenumber, -l_extendedprice, l_returnflag FROM lineitem
  WHERE l_returnflag = 'A'""")
def _(v: Views):
    """Write all partitions, then replace one of them."""
    path = run_folder(v.spark, "partitioned")
    lines = readers.read_table(v.spark, v.folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    writers.overwrite_partitioned(lines, path, ["l_returnflag"])
    again = lines.filter("l_returnflag = 'A'").withColumn("l_extendedprice", -F.col("l_extendedprice"))
    writers.overwrite_partitioned(again, path, ["l_returnflag"])
    return v.spark.read.parquet(path)


@query("write_clustered", "SELECT l_suppkey, count(*) AS n, max(l_shipdate) AS newest FROM lineitem "
       "WHERE l_suppkey BETWEEN 10 AND 20 GROUP BY l_suppkey")
def _(v: Views):
    """Range-clustered by supplier; the read skips files by their statistics."""
    path = run_folder(v.spark, "clustered")
    lines = readers.read_table(v.spark, v.folder, "lineitem").select("l_suppkey", "l_shipdate")
    writers.write_clustered(lines, path, ["l_suppkey", "l_shipdate"])
    return (v.spark.read.parquet(path).filter(F.col("l_suppkey").between(10, 20))
            .groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("newest")))


@query("write_curve", """SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_returnflag FROM lineitem""")
def _(v: Views):
    """Laid out by supplier, date and flag at once, and read back whole."""
    path = run_folder(v.spark, "curve")
    lines = readers.read_table(v.spark, v.folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_returnflag")
    layout.write_curve(lines, path, ["l_suppkey", "l_shipdate", "l_returnflag"])
    return v.spark.read.parquet(path)


def _refreshed(v: Views, name: str):
    """Silver of all bronze but two days of it, brought up to date with the rows of these days."""
    path, rows = run_folder(v.spark, "incremental"), v.role("bronze")
    first = rows.agg(F.min(incremental.day_of())).first()[0]
    days = [first + timedelta(days=3), first + timedelta(days=14)]
    late = incremental.day_of().isin(days)
    rows.filter(~late).write.parquet(f"{path}/bronze")
    incremental.rebuild(v.spark, f"{path}/bronze", f"{path}/silver", measure=T.DoubleType())
    rows.filter(late).write.mode("append").parquet(f"{path}/bronze")
    incremental.refresh(v.spark, rows.filter(late), f"{path}/bronze", f"{path}/silver", measure=T.DoubleType())
    return incremental.read_silver(v.spark, f"{path}/silver", name)


@query("incremental_changes", "SELECT * FROM changes", "price_change_pct_1h price_change_pct_24h price_change_pct_7d")
def _(v: Views):
    return _refreshed(v, "silver_market_changes")


@query("incremental_dominance", "SELECT * FROM dominance", "market_cap_usd dominance_pct")
def _(v: Views):
    return _refreshed(v, "silver_market_dominance")


@query("incremental_comparison", "SELECT * FROM comparison", "price_change_pct_24h price_change_pct_7d")
def _(v: Views):
    return _refreshed(v, "silver_cross_asset_comparison")


def _database(v: Views) -> tuple[str, str]:
    """A new database whose tables lie in a folder of the run, and the folder."""
    path = run_folder(v.spark, "catalog")
    name = "tidemark_" + path.rsplit("-", 1)[-1]
    v.spark.sql(f"CREATE DATABASE {name} LOCATION '{path}/tables'")
    return name, path


@query("append_table", "SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM customer")
def _(v: Views):
    """A declared table, appended to twice."""
    name = f"{_database(v)[0]}.customers"
    rows = readers.read_table(v.spark, v.folder, "customer").select("c_custkey", "c_mktsegment")
    writers.ensure_table(v.spark, name, rows.schema)
    writers.ensure_table(v.spark, name, rows.schema)
    for _ in range(2):
        writers.append_table(rows, name)
    return v.spark.table(name)


@query("overwrite_table", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def _(v: Views):
    """Rows and schema of a table replaced by others."""
    name = f"{_database(v)[0]}.held"
    writers.overwrite_table(readers.read_table(v.spark, v.folder, "customer"), name)
    orders = readers.read_table(v.spark, v.folder, "orders")
    writers.overwrite_table(orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), name)
    return v.spark.table(name)


@query("drop_view_for_table", "SELECT n_nationkey, n_name FROM nation")
def _(v: Views):
    """A view makes room for a table of its name; a table stays."""
    name = f"{_database(v)[0]}.nations"
    rows = readers.read_table(v.spark, v.folder, "nation").select("n_nationkey", "n_name")
    v.spark.sql(f"CREATE VIEW {name} AS SELECT 1 AS one")
    dropped = writers.drop_if_view(v.spark, name)
    writers.overwrite_table(rows, name)
    return v.spark.table(name).filter(F.lit(dropped and not writers.drop_if_view(v.spark, name)))


@query("publish_table", "SELECT s_suppkey, -s_acctbal AS s_acctbal FROM supplier")
def _(v: Views):
    """A table published from its own rows: the second version reads the first."""
    base, path = _database(v)
    writers.publish_table(readers.read_table(v.spark, v.folder, "supplier").select("s_suppkey", "s_acctbal"), f"{base}.suppliers", path)
    writers.publish_table(v.spark.table(f"{base}.suppliers").withColumn("s_acctbal", -F.col("s_acctbal")), f"{base}.suppliers", path)
    return v.spark.table(f"{base}.suppliers")


@query("append_new_rows", """SELECT asset_id, observed_at, max(source_record_id) AS record
  FROM bronze GROUP BY asset_id, observed_at""")
def _(v: Views):
    """Insert-only merge of the same batch twice: the second run adds nothing."""
    path = run_folder(v.spark, "merged")
    rows = v.role("bronze").select("asset_id", "observed_at", F.col("source_record_id").alias("record"))
    for _ in range(2):
        writers.append_new_rows(v.spark, path, rows, ["asset_id", "observed_at"],
                                [F.desc("record")], prune_by="observed_at")
    return v.spark.read.parquet(path)


@query("handoff", """SELECT request_id, kind, coalesce(source, 'watch') AS source, created_at FROM alerts""")
def _(v: Views):
    """Alerts handed over as JSON lines and read with the declared feed schema."""
    path = run_folder(v.spark, "handoff")
    writers.write_handoff(v.role("alerts"), path, "watch", AS_OF)
    rows = readers.read_payload(v.spark, path, schemas.ALERT_FEED, lines=True)
    return rows.select("request_id", "kind", "source", F.col("created_at").cast("timestamp").alias("created_at"))


_GOOD_FEED = """SELECT DISTINCT coalesce(nullif(asset_id, ''), id) AS asset_id,
    CAST(coalesce(observed_at, last_updated) AS TIMESTAMP) AS observed_at FROM market_feed
  WHERE coalesce(nullif(asset_id, ''), id) IS NOT NULL AND symbol <> '' AND volume_24h_usd <> ''
    AND coalesce(source_system, '') <> 'unsupported' AND market_cap_rank <> 'x'
    AND coalesce(market_cap_usd, market_cap) <> 'n/a'"""


@query("read_payload", _GOOD_FEED)
def _(v: Views):
    """Feed text to typed bronze keys: JSON read, normalise, validate, dedup."""
    path = run_folder(v.spark, "feed")
    role(v.spark, v.folder, "market_feed").write.json(path)
    feed = readers.read_payload(v.spark, path, schemas.MARKET_FEED, lines=True)
    good = validate.validate_market(validate.normalize_market(feed, moment(AS_OF))).good
    return align.to_bronze_market(good).select("asset_id", "observed_at").distinct()


@query("stream_ingest", _GOOD_FEED)
def _(v: Views):
    """The same feed as a stream into an insert-only table."""
    from tidemark.streaming.ingest import market_stream, stream_ingest
    path = run_folder(v.spark, "ingest")
    role(v.spark, v.folder, "market_feed").write.json(f"{path}/feed")
    (stream_ingest(market_stream(v.spark, f"{path}/feed"), f"{path}/bronze", f"{path}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return v.spark.read.parquet(f"{path}/bronze").select("asset_id", "observed_at")


def _landed(v: Views, feed: str, role_name: str, key: str):
    """The feed landed twice under one name: the keys in the table, and those in quarantine with their reasons."""
    path = run_folder(v.spark, f"land-{feed}")
    role(v.spark, v.folder, role_name).write.json(f"{path}/feed")
    for _ in range(2):
        landing.land(v.spark, feed, f"{path}/feed", f"{path}/table", f"{path}/bad", AS_OF, "one")
    good = landing.landed_rows(v.spark, f"{path}/table", landing.FEEDS[feed].table)
    bad = landing.landed_rows(v.spark, f"{path}/bad", landing.QUARANTINE)
    return good.select(F.col(key).alias("id"), F.lit("").alias("reasons")).unionByName(bad.select(
        F.get_json_object(landing.RECORD, f"$.{key}").alias("id"), F.array_join(landing.validate.REASONS, "|").alias("reasons")))


@query("land_usage", """
  SELECT request_id AS id, concat_ws('|', CASE WHEN request_id = '' THEN 'missing:request_id' END,
    CASE WHEN tenant_id IS NULL THEN 'missing:tenant_id' END,
    CASE WHEN route_selected = 'elsewhere' THEN 'unsupported:route_selected' END,
    CASE WHEN response_status = 'ok' THEN 'unsupported:response_status' END,
    CASE WHEN latency_ms = 'slow' THEN 'invalid:latency_ms' END,
    CASE WHEN prompt_tokens = 'many' THEN 'invalid:prompt_tokens' END) AS reasons FROM usage_feed""")
def _(v: Views):
    return _landed(v, "usage", "usage_feed", "request_id")


@query("land_runs", """
  SELECT run_id AS id, concat_ws('|', CASE WHEN job_name = '' THEN 'missing:job_name' END,
    CASE WHEN status = 'BROKEN' THEN 'unsupported:status' END,
    CASE WHEN duration_ms = 'long' THEN 'invalid:duration_ms' END) AS reasons FROM run_feed""")
def _(v: Views):
    return _landed(v, "runs", "run_feed", "run_id")


@query("stream_rate_limit", admission_sql("SELECT *, user_id AS k, ts AS seen FROM events", 2, 86400))
def _(v: Views):
    """Admission per user on a stream of the event table, two a day."""
    from tidemark.streaming.admission import stream_rate_limit
    path, before = run_folder(v.spark, "admission"), v.spark.conf.get(_PROVIDER)
    events = readers.stream_table(v.spark, v.folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id")
    v.spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        (stream_rate_limit(events, ["user_id"], "ts", ["event_id"], limit=2, seconds=86400)
         .writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows")
         .option("checkpointLocation", f"{path}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        v.spark.conf.set(_PROVIDER, before)
    return v.spark.read.parquet(f"{path}/rows").select("event_id", "admitted", "retry_after_s")
