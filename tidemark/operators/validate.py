"""Row validation: every check is a column, bad rows go to quarantine with their reasons."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import fixed_values as fv
from tidemark.functions.columns import blank_to_null, cap_bucket, labels_where

REASONS = "reasons"
Rule = tuple[Column, str]  # (violated when true, reason)


class Checked(NamedTuple):
    """Result of a validation: the annotated frame and its two halves (lazy filters on it)."""

    checked: DataFrame

    @property
    def good(self) -> DataFrame:
        return self.checked.filter(F.size(REASONS) == 0).drop(REASONS)

    @property
    def quarantine(self) -> DataFrame:
        return self.checked.filter(F.size(REASONS) > 0)


def check(df: DataFrame, rules: Sequence[Rule]) -> Checked:
    return Checked(df.withColumn(REASONS, labels_where(rules)))


def is_missing(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name).cast("string") == "")


def missing(names: Sequence[str]) -> list[Rule]:
    return [(is_missing(name), f"missing:{name}") for name in names]


def not_in(name: str, allowed: Sequence[str]) -> Rule:
    return (~F.col(name).isin(list(allowed)), f"unsupported:{name}")


def not_castable(name: str, raw: Column, data_type: str) -> Rule:
    """A non-empty text that is no value of the type."""
    text = blank_to_null(raw)
    return text.isNotNull() & text.try_cast(data_type).isNull(), f"invalid:{name}"


# Market feed -----------------------------------------------------------------------------------

MARKET_REQUIRED = [field.name for field in schemas.BRONZE_MARKET]


def normalize_market(df: DataFrame, now: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Feed aliases, defaults and record id; all columns still text where the feed has text. Columns in ``keep``
    stay as they are."""
    first = lambda *names: F.coalesce(*[blank_to_null(name) for name in names])
    asset, seen = first("asset_id", "id"), first("observed_at", "last_updated")
    return df.select(
        F.coalesce(blank_to_null("source_system"), F.lit(fv.DEFAULT_SOURCE_SYSTEM))
        .alias("source_system"),
        F.coalesce(blank_to_null("source_record_id"),
                   F.when(asset.isNotNull() & seen.isNotNull(), F.concat_ws(":", asset, seen)))
        .alias("source_record_id"),
        asset.alias("asset_id"),
        F.upper("symbol").alias("symbol"),
        F.coalesce(blank_to_null("name"), F.lit("unmapped")).alias("name"),
        F.coalesce(blank_to_null("category"), F.lit("unclassified")).alias("category"),
        seen.alias("observed_at"),
        F.coalesce(blank_to_null("ingested_at"), now.cast("string")).alias("ingested_at"),
        F.coalesce("market_cap_usd", "market_cap").alias("market_cap_usd"),
        F.coalesce("price_usd", "current_price").alias("price_usd"),
        F.coalesce("volume_24h_usd", "total_volume").alias("volume_24h_usd"),
        F.col("circulating_supply"),
        F.col("market_cap_rank"),
        F.coalesce(blank_to_null("payload_version"), F.lit(fv.DEFAULT_PAYLOAD_VERSION))
        .alias("payload_version"), *keep)


def validate_market(df: DataFrame) -> Checked:
    numbers = ["market_cap_usd", "price_usd", "volume_24h_usd", "circulating_supply"]
    return check(df, [
        *missing(MARKET_REQUIRED),
        not_in("source_system", fv.SOURCE_SYSTEMS),
        *[not_castable(name, F.col(name).cast("string"), "double") for name in numbers],
        not_castable("market_cap_rank", F.col("market_cap_rank").cast("string"), "bigint"),
        *[not_castable(name, F.col(name).cast("string"), "timestamp")
          for name in ("observed_at", "ingested_at")]])


# Enrichment feeds --------------------------------------------------------------------------------

def _number(value: Column) -> Column:
    return value.cast("string").try_cast("double")


def _scalar_or_last(value: str, history: str) -> Column:
    """The scalar if it is set and not zero, else the last entry of the history."""
    text = F.col(value).cast("string")
    usable = blank_to_null(text).isNotNull() & (F.coalesce(_number(text), F.lit(1.0)) != 0)
    return F.coalesce(_number(F.when(usable, text)), F.when(
        ~F.coalesce(usable, F.lit(False)), _number(F.try_element_at(F.col(history), F.lit(-1)))))


def normalize_protocols(df: DataFrame, now: Column, strict_chain: bool = False) -> DataFrame:
    """Protocol rows; without slug or numeric TVL a row is dropped."""
    return validate_protocols(df, now, strict_chain).good


def validate_protocols(df: DataFrame, now: Column, strict_chain: bool = False, keep: Sequence[str] = ()) -> Checked:
    """Protocol rows with the reasons against those without slug or numeric TVL. Columns in ``keep`` stay as they are.

    ``strict_chain`` reproduces a precedence quirk: ``chain`` then counts only where ``chains``
    is not empty.
    """
    slug = F.coalesce(blank_to_null("slug"), blank_to_null(
        F.regexp_replace(F.lower("name"), " ", "-")))
    tvl, mcap = _number(F.col("tvl")), _number(F.col("mcap"))
    first_chain = F.try_element_at(F.col("chains"), F.lit(1))
    chain = F.coalesce(blank_to_null("chain"), first_chain)
    if strict_chain:
        chain = F.when(F.size("chains") > 0, chain)
    return check(df.select(
        F.lit(fv.PROTOCOL_SOURCE).alias("source_system"),
        slug.alias("source_record_id"),
        slug.alias("protocol_slug"),
        F.coalesce(blank_to_null("name"), slug).alias("protocol_name"),
        F.coalesce(chain, F.lit("unknown")).alias("chain"),
        F.coalesce(blank_to_null("category"), F.lit("unclassified")).alias("category"),
        tvl.alias("tvl_usd"),
        _scalar_or_last("fees", "feesHistory").alias("fees_24h_usd"),
        _scalar_or_last("revenue", "revenueHistory").alias("revenue_24h_usd"),
        F.when((mcap != 0) & (tvl > 0), F.round(mcap / tvl, 6)).alias("mcap_tvl_ratio"),
        F.coalesce(blank_to_null("last_updated").try_cast("timestamp"), now).alias("observed_at"),
        now.alias("ingested_at"),
        F.lit(fv.PROTOCOL_VERSION).alias("payload_version"), *keep), missing(["protocol_slug", "tvl_usd"]))


def normalize_observations(df: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """Macro observations: one row per dated numeric value of a known series.

    ``names`` is the table of series names.
    """
    return validate_observations(df, names, now).good


def validate_observations(df: DataFrame, names: DataFrame, now: Column, record: str | None = None) -> Checked:
    """Every observation of every series, with the reasons against those without a date or a numeric value and those
    of unknown series. ``record`` names a column to add that holds the observation with its series as JSON text."""
    raw = F.to_json(F.struct("series_id", F.col("o.date").alias("date"), F.col("o.value").alias("value")))
    rows = (df.select("series_id", F.explode("observations").alias("o"))
            .select("series_id", F.col("o.date").alias("observation_date"), _number(F.col("o.value")).alias("value"),
                    *([raw.alias(record)] if record else [])))
    known = rows.join(names, "series_id", "left").select(
        F.lit(fv.MACRO_SOURCE).alias("source_system"),
        F.concat_ws(":", "series_id", "observation_date").alias("source_record_id"),
        "series_id", "series_name", "observation_date", "value",
        now.alias("observed_at"), now.alias("ingested_at"),
        F.lit(fv.MACRO_VERSION).alias("payload_version"), *([record] if record else []))
    return check(known, [(F.col("series_name").isNull(), "unsupported:series_id"),
                         *missing(["observation_date", "value"])])


def repo_activity(df: DataFrame, as_of: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Activity of a repository from its weekly commit totals; fewer than four weeks count as
    none. The last 13 weeks are the quarter, the last 4 the month. Columns in ``keep`` stay as they are."""
    totals = F.transform("weeks", lambda w: F.coalesce(w["total"], F.lit(0)))
    weeks = F.col("_weeks")
    tail = lambda n: F.slice(weeks, F.greatest(F.size(weeks) - (n - 1), F.lit(1)), n)
    total = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x)
    enough = F.size(weeks) >= 4
    created = blank_to_null("created_at").try_cast("timestamp")
    age = F.floor((F.unix_micros(as_of) - F.unix_micros(created)) / F.lit(86_400_000_000))
    return df.withColumn("_weeks", totals).select(
        "asset_id",
        F.concat_ws("/", "owner", "repo").alias("repo_full_name"),
        F.coalesce("stargazers_count", F.lit(0)).alias("stars"),
        F.coalesce("forks_count", F.lit(0)).alias("forks"),
        F.coalesce("open_issues_count", F.lit(0)).alias("open_issues"),
        F.when(enough, F.size(F.filter(tail(13), lambda x: x > 0))).otherwise(0).cast("bigint")
        .alias("contributors_count"),
        F.when(enough, total(tail(4))).otherwise(0).alias("commits_30d"),
        F.when(enough, total(tail(13))).otherwise(0).alias("commits_90d"),
        F.coalesce(age, F.lit(0)).cast("bigint").alias("repo_age_days"),
        F.coalesce("pushed_at", F.lit("")).alias("last_push_at"), *keep)


def normalize_activity(df: DataFrame, now: Column, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(
        F.lit(fv.REPO_SOURCE).alias("source_system"),
        F.col("asset_id").alias("source_record_id"),
        "asset_id", "repo_full_name", "stars", "forks", "open_issues", "contributors_count",
        "commits_30d", "commits_90d", "repo_age_days", "last_push_at",
        now.alias("observed_at"), now.alias("ingested_at"),
        F.lit(fv.REPO_VERSION).alias("payload_version"), *keep)


# Operations feeds ----------------------------------------------------------------------------------

def validate_usage(df: DataFrame) -> Checked:
    """Usage events; known route aliases are mapped before the allow-list is applied."""
    aliased = F.col("route_selected")
    for alias, route in fv.ROUTE_ALIASES.items():
        aliased = F.when(F.col("route_selected") == alias, route).otherwise(aliased)
    optional = {"prompt_tokens": "int", "completion_tokens": "int", "total_tokens": "int",
                "cost_estimate": "double"}
    rules = [
        *missing(["event_time", "request_id", "tenant_id", "route_selected", "model_or_engine",
                  "latency_ms", "response_status"]),
        not_in("route_selected", fv.ROUTES), not_in("response_status", fv.RESPONSE_STATUSES),
        *[not_castable(name, F.col(name).cast("string"), kind)
          for name, kind in {"latency_ms": "int", **optional}.items()]]
    return check(df.withColumn("route_selected", aliased), rules)


def validate_runs(df: DataFrame) -> Checked:
    return check(df, [
        *missing(["job_name", "status"]), not_in("status", fv.RUN_STATUSES),
        not_castable("duration_ms", F.col("duration_ms").cast("string"), "int")])


def validate_alerts(df: DataFrame) -> Checked:
    kinds = fv.RUNTIME_ALERTS + fv.RUN_ALERTS + fv.MODEL_ALERTS
    defaulted = df.withColumn("source", F.coalesce(blank_to_null("source"),
                                                   F.lit(fv.DEFAULT_ALERT_SOURCE)))
    return check(defaulted, [*missing(["kind", "message"]), not_in("kind", kinds)])


def validate_requests(df: DataFrame) -> Checked:
    """Request log: required fields, allow-lists, identifier shapes, sizes."""
    ids = ["tenant_id", "session_id", "request_id", "user_id"]
    version = F.coalesce(blank_to_null("api_version"), F.lit(fv.API_VERSIONS[0]))
    assets = F.coalesce("selected_assets", F.array().cast("array<string>"))
    return check(df.withColumn("api_version", version), [
        *missing(["tenant_id", "session_id", "request_id", "locale", "channel",
                  "request_type_hint", "message_text"]),
        not_in("api_version", fv.API_VERSIONS), not_in("channel", fv.CHANNELS),
        not_in("request_type_hint", fv.REQUEST_HINTS),
        (F.length("message_text") > 2000, "too_long:message_text"),
        *[(~is_missing(name) & ~F.col(name).rlike(fv.RUNTIME_ID_PATTERN), f"invalid:{name}")
          for name in ids],
        (F.size(assets) > 25, "too_many:selected_assets"),
        (F.exists(assets, lambda a: ~F.coalesce(a.rlike(fv.ASSET_ID_PATTERN), F.lit(False))),
         "invalid:selected_assets")])


# Silver row contracts -------------------------------------------------------------------------------

def conform_changes(df: DataFrame) -> Checked:
    rows = (df.withColumn("symbol", F.upper("symbol"))
            .withColumn("name", F.coalesce(blank_to_null("name"), F.lit("unmapped")))
            .withColumn("window_id", F.substring(F.col("observed_at").cast("string"), 1, 10)))
    return check(rows, missing(["asset_id", "symbol", "observed_at", "volume_24h_usd",
                                "market_cap_usd"]))


def conform_dominance(df: DataFrame) -> Checked:
    return check(df, missing(["observed_at", "dominance_group", "market_cap_usd"]))


def conform_comparison(df: DataFrame) -> Checked:
    rows = (df.withColumn("symbol", F.upper("symbol"))
            .withColumn("correlation_bucket", cap_bucket(
                F.col("market_cap_rank").cast("string").try_cast("bigint"))))
    return check(rows, missing(["asset_id", "symbol", "observed_at", "price_usd",
                                "market_cap_usd", "volume_24h_usd"]))


# Declarative contracts --------------------------------------------------------------------------------

USAGE_CONTRACT = {
    "required": ["event_time", "request_id", "tenant_id", "route_selected", "model_or_engine",
                 "latency_ms", "response_status"],
    "enum": {"route_selected": fv.ROUTES, "response_status": fv.RESPONSE_STATUSES},
    "min0": ["prompt_tokens", "completion_tokens", "total_tokens", "latency_ms",
             "cost_estimate"],
    "fields": [field.name for field in schemas.USAGE_EVENTS if field.name != "model_tier"],
}
RUN_CONTRACT = {
    "required": ["job_name", "status"], "enum": {"status": fv.RUN_STATUSES},
    "min0": ["duration_ms"],
    "fields": ["job_name", "run_id", "status", "result_state", "update_time", "duration_ms"],
}
ALERT_CONTRACT = {
    "required": ["kind", "message"],
    "enum": {"kind": fv.RUNTIME_ALERTS + fv.RUN_ALERTS}, "min0": [],
    "fields": [field.name for field in schemas.ALERTS],
}


def check_contract(df: DataFrame, contract: Mapping, raw_json: str | None = None) -> Checked:
    """Required, enum, minimum 0 and no extra fields. Extra fields are seen in the raw JSON text
    of the row (``raw_json`` names that column), else in the columns of the frame."""
    rules: list[Rule] = [(F.col(name).isNull(), f"required:{name}")
                         for name in contract["required"]]
    rules += [(F.col(name).isNotNull() & ~F.col(name).isin(list(allowed)), f"enum:{name}")
              for name, allowed in contract["enum"].items()]
    rules += [(F.col(name).try_cast("double") < 0, f"minimum:{name}") for name in contract["min0"]]
    if raw_json:
        extra = F.array_except(F.json_object_keys(raw_json),
                               F.array(*[F.lit(name) for name in contract["fields"]]))
        rules.append((F.size(extra) > 0, "additional_fields"))
    else:
        known = {*contract["fields"]}
        rules += [(F.col(name).isNotNull(), f"additional:{name}")
                  for name in df.columns if name not in known]
    return check(df, rules)


# Gates ------------------------------------------------------------------------------------------------

def filter_assets(df: DataFrame, asset_ids: Sequence[str] | None) -> DataFrame:
    """Keep the listed assets; no list keeps all. The identifiers are checked first."""
    if not asset_ids:
        return df
    if any(not re.match(fv.ASSET_ID_PATTERN, asset) for asset in asset_ids):
        raise ValueError("asset_id contains invalid characters")
    return df.filter(F.col("asset_id").isin(list(asset_ids)))


def quality_counts(df: DataFrame, not_null: Sequence[str] = ("asset_id",)) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"),
                  *[F.count_if(F.col(name).isNull()).alias(f"null_{name}") for name in not_null])


def assert_quality(df: DataFrame, min_rows: int = 1,
                   not_null: Sequence[str] = ("asset_id",)) -> None:
    """Raise when the frame is too small or a key column holds nulls (one aggregate)."""
    counts = quality_counts(df, not_null).first().asDict()
    if counts["row_count"] < min_rows:
        raise ValueError(f"Quality gate failed: {counts['row_count']} rows, expected >= {min_rows}")
    for name in not_null:
        if counts[f"null_{name}"]:
            raise ValueError(f"Quality gate failed: {counts[f'null_{name}']} rows with null {name}")


def runs_healthy(df: DataFrame) -> DataFrame:
    """One row: true when every run succeeded; no runs count as healthy."""
    good = F.coalesce(F.upper("status").isin(fv.RUN_SUCCESS), F.lit(False))
    return df.agg(F.coalesce(F.bool_and(good), F.lit(True)).alias("healthy"))
