"""Request log: classes, tiers, admission, dispatch and usage rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import fixed_values as fv
from tidemark.functions import text
from tidemark.functions.admission import admit_each


def classify_route(df: DataFrame, col: str = "message_text") -> DataFrame:
    """Adds route, reason and the matched signals of the message."""
    marked = (df.withColumn("_lowered", F.lower(col))
              .withColumn("_structured", text.signals("_lowered", fv.STRUCTURED_SIGNALS))
              .withColumn("_narrative", text.signals("_lowered", fv.NARRATIVE_SIGNALS)))
    route, reason, found = text.route_class(F.col("_structured"), F.col("_narrative"))
    return (marked.withColumns({"route": route, "route_reason": reason, "route_signals": found})
            .drop("_lowered", "_structured", "_narrative"))


def classify_tier(df: DataFrame, col: str = "message_text", assets: str | None = None,
                  turns: str | None = None) -> DataFrame:
    """Adds tier, reason, signals and token estimate; ``assets`` and ``turns`` name count
    columns."""
    count = lambda name: F.coalesce(F.col(name), F.lit(0)) if name else F.lit(0)
    marked = (df.withColumn("_words", text.word_count(col))
              .withColumn("_lowered", F.lower(col))
              .withColumn("_complex", text.signals("_lowered", fv.COMPLEX_SIGNALS))
              .withColumn("_light", text.signals("_lowered", fv.LIGHT_SIGNALS)))
    tier, reason, found, tokens = text.tier_class(
        F.col("_words"), F.col("_complex"), F.col("_light"), count(assets), count(turns))
    return (marked.withColumns({"tier": tier, "tier_reason": reason, "tier_signals": found,
                                "estimated_prompt_tokens": tokens})
            .drop("_words", "_lowered", "_complex", "_light"))


def estimate_cost(df: DataFrame, tier: str = "model_tier",
                  tokens: str = "total_tokens") -> DataFrame:
    return df.withColumn("cost_usd", text.token_cost(tier, tokens))


def rate_limit(df: DataFrame, key: Sequence[str], ts: str, tie: Sequence[str], limit: int = 12,
               seconds: int = 60) -> DataFrame:
    """Adds ``admitted`` and ``retry_after_s``: at most ``limit`` admitted events per key and
    window; only admitted events count. A missing key part counts as ``anonymous``. Events without
    a time cannot be placed: both new columns are null for them.

    Admission looks back over admitted events and is sequential within a key, but not without
    end. Time is cut into slots as long as the window and events are counted per (key, slot). If
    a slot and the one before hold at most ``limit`` events together, every event of the slot is
    admitted, and what follows depends on this slot only; after an empty slot nothing is left of
    the past. Both are exact cuts. Quiet slots are decided in SQL; only crowded stretches between
    two cuts go to Python, sorted by Spark and streamed batch by batch with the window's few
    admitted times as state. A key above its limit without a pause stays one stretch.
    """
    keys = [f"_k{i}" for i in range(len(key))]
    width = seconds * 1_000_000
    named = df.withColumns({k: F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")),
                                          F.lit("anonymous")) for k, name in zip(keys, key)})
    timed, untimed = named.filter(F.col(ts).isNotNull()), df.filter(F.col(ts).isNull()).withColumns(
        {"admitted": F.lit(None).cast("boolean"), "retry_after_s": F.lit(None).cast("long")})
    events = (timed.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
              .withColumn("_slot", F.floor(F.col("_t") / width).cast("long")))
    counts = events.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_slot")
    before = F.when(F.lag("_slot").over(order) == F.col("_slot") - 1, F.lag("_n").over(order))
    prior = F.coalesce(before, F.lit(0))
    slots = (counts.withColumn("_prior", prior)
             .withColumn("_cut", (F.col("_prior") == 0)
                         | (F.col("_prior") + F.col("_n") <= limit))
             .withColumn("_stretch", F.sum(F.col("_cut").cast("long")).over(order))
             .withColumn("_quiet", F.col("_prior") + F.col("_n") <= limit)
             .withColumn("_leads", ~F.coalesce(F.lead("_cut").over(order), F.lit(True)))
             .select(*keys, "_slot", "_stretch",
                     (F.col("_quiet") & ~F.col("_leads")).alias("_settled")))
    placed = events.join(slots, [*keys, "_slot"])
    settled = placed.filter("_settled").withColumns(
        {"admitted": F.lit(True), "retry_after_s": F.lit(0).cast("long")})
    crowded = (placed.filter("NOT _settled").repartition(*keys, "_stretch")
               .sortWithinPartitions(*keys, "_stretch", "_t", *tie))
    out_schema = T.StructType(list(crowded.schema) + [
        T.StructField("admitted", T.BooleanType()), T.StructField("retry_after_s", T.LongType())])
    decided = crowded.mapInArrow(_stretch_decider(keys, limit, width), out_schema)
    return (settled.unionByName(decided).select(*df.columns, "admitted", "retry_after_s")
            .unionByName(untimed))


def _stretch_decider(keys: list[str], limit: int, width: int):
    """Decides sorted rows event by event: the held times begin anew where a stretch ends. The rows
    themselves pass by; only their times and the starts of stretches are looked at."""
    group = [*keys, "_stretch"]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, deque()
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            starts = np.zeros(rows, dtype=bool)
            for name in group:
                column = batch.column(name)
                starts[1:] |= pc.not_equal(column.slice(1), column.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
            starts[0] = tuple(batch.column(name)[0].as_py() for name in group) != current
            current = tuple(batch.column(name)[rows - 1].as_py() for name in group)
            admitted, retry, held = admit_each(batch.column("_t").to_pylist(), starts.tolist(), held, limit, width)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(admitted, pa.bool_()), pa.array(retry, pa.int64())],
                [*batch.schema.names, "admitted", "retry_after_s"])

    return decide


def dispatch(df: DataFrame) -> DataFrame:
    """Surface of each request, and whether the rate limit applies to it."""
    classified = classify_route(df)
    hint = F.col("request_type_hint")
    overview = ((F.col("channel") == "web_dashboard")
                & F.trim(F.lower("message_text")).isin(fv.OVERVIEW_PHRASES))
    surface = (F.when(hint == "dashboard_query", "dashboard")
               .when(hint == "analytics_nlq", "genie").when(hint == "copilot", "copilot")
               .when(overview, "dashboard").otherwise(F.col("route")))
    return classified.withColumn("surface", surface).withColumn(
        "rate_limited_surface", F.col("surface") != "dashboard")


def usage_rows(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Usage log rows from requests and their responses (joined on the request id)."""
    dashboard = F.col("surface_type") == "dashboard_payload"
    joined = classify_route(requests).join(responses, "request_id")
    return joined.select(
        F.col("responded_at").alias("event_time"), "request_id", "tenant_id", "user_id",
        F.when(dashboard, fv.DASHBOARD_ROUTE).otherwise(F.col("route"))
        .alias("route_selected"),
        F.when(dashboard, fv.DASHBOARD_ENGINE).otherwise(
            F.coalesce("model_id", F.lit(fv.DEFAULT_ENGINE))).alias("model_or_engine"),
        F.when(~dashboard, F.coalesce("model_tier", F.lit(fv.DEFAULT_TIER))).alias("model_tier"),
        "prompt_tokens", "completion_tokens", "total_tokens", "latency_ms", "cost_estimate",
        "freshness_watermark", F.lit("success").alias("response_status"))


def merge_sources(df: DataFrame) -> DataFrame:
    """Per request the sources of its parts, distinct and in first-seen order, and the token
    total. Input: request_id, part (order), sources (array), token_count.

    Sources are reduced to their first position before they are collected, so the array is
    bounded by the distinct sources, not by the rows of a request.
    """
    each = df.select("request_id", "part", "token_count", F.posexplode_outer("sources"))
    # part and position in one number: a plain minimum stays a hash aggregate
    place = F.shiftleft(F.col("part").cast("bigint"), 32) + F.col("pos")
    first = each.groupBy("request_id", F.col("col").alias("_source")).agg(
        F.min(place).alias("_at"),
        F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("token_count"))).alias("_tokens"))
    listed = F.array_sort(F.collect_list(F.when(
        F.col("_source").isNotNull(), F.struct("_at", "_source"))))
    return first.groupBy("request_id").agg(
        F.transform(listed, lambda s: s["_source"]).alias("sources"),
        F.coalesce(F.sum("_tokens"), F.lit(0)).alias("total_tokens"))
