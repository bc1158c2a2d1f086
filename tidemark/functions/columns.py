"""Row formulas of the market, operations and model layers."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv

ColumnLike = Column | str


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def moment(value: datetime | str | Column) -> Column:
    """The evaluation time as a TIMESTAMP literal."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def before(as_of: datetime | str | Column, *, days: float = 0, hours: float = 0) -> Column:
    return moment(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                              F.lit(days * 86400.0 + hours * 3600.0))


def labels_where(pairs: Sequence[tuple[Column, Column | str]]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[
        F.when(condition, F.lit(label) if isinstance(label, str) else label)
        for condition, label in pairs]))


def blank_to_null(value: ColumnLike) -> Column:
    return F.nullif(col(value), F.lit(""))


# Market ------------------------------------------------------------------------------------

def pct_change(current: ColumnLike, base: ColumnLike, scale: int | None = None) -> Column:
    """Change in percent; null where the base is null or zero."""
    current, base = col(current), col(base)
    change = (current - base) / base * 100
    return F.when(base != 0, change if scale is None else F.round(change, scale))


def dominance_group(symbol: ColumnLike) -> Column:
    symbol = col(symbol)
    return (F.when(symbol == "BTC", "btc").when(symbol == "ETH", "eth")
            .when(symbol.isin(fv.STABLECOINS), "stablecoins").otherwise("long_tail"))


def cap_bucket(rank: ColumnLike) -> Column:
    rank = col(rank)
    return (F.when(rank <= 10, "large_cap").when(rank <= 50, "mid_cap")
            .otherwise("broad_market"))


def direction(change: ColumnLike) -> Column:
    change = col(change)
    return F.when(change > 0, "positive").when(change < 0, "negative").otherwise("flat")


def move_band(change: ColumnLike) -> Column:
    size = F.abs(col(change))
    return F.when(size >= 20, "high").when(size >= 5, "medium").otherwise("low")


def dominance_band(share: ColumnLike) -> Column:
    share = col(share)
    return F.when(share >= 50, "macro").when(share >= 20, "major").otherwise("long_tail")


def pass_or_review(condition: Column) -> Column:
    """Three-valued: a condition that is null gives ``review``."""
    return F.when(condition, "pass").otherwise("review")


def vol_to_cap(volume: ColumnLike, cap: ColumnLike) -> Column:
    cap = col(cap)
    return F.when(cap != 0, col(volume) / cap)


def momentum(change_24h: ColumnLike, change_7d: ColumnLike) -> Column:
    return (col(change_24h).cast("double") * F.lit(0.4)
            + col(change_7d).cast("double") * F.lit(0.6))


def dev_activity_score(commits: ColumnLike, stars: ColumnLike, contributors: ColumnLike) -> Column:
    points = (F.coalesce(col(commits), F.lit(0)) * 2
              + F.coalesce(col(stars), F.lit(0)) / F.lit(1000.0)
              + F.coalesce(col(contributors), F.lit(0)) * 5)
    return F.least(F.lit(100.0), points).cast("int")


def macro_regime_label(series_id: ColumnLike, value: ColumnLike, change: ColumnLike) -> Column:
    series_id, value, change = col(series_id), col(value), col(change)
    rules = [
        ("DGS10", value > 4.0, "high_rates"),
        ("DGS10", value < 2.0, "low_rates"),
        ("DTWEXBGS", change > 2.0, "usd_strengthening"),
        ("DTWEXBGS", change < -2.0, "usd_weakening"),
        ("CPIAUCSL", change > 0.3, "inflation_rising"),
        ("M2SL", change > 1.0, "liquidity_expanding"),
        ("M2SL", change < -1.0, "liquidity_contracting"),
    ]
    label = F.when((series_id == rules[0][0]) & rules[0][1], rules[0][2])
    for series, condition, name in rules[1:]:
        label = label.when((series_id == series) & condition, name)
    return label.otherwise("neutral")


# Operations ----------------------------------------------------------------------------------

def is_stale(watermark: ColumnLike) -> Column:
    watermark = col(watermark)
    return watermark.isNull() | watermark.isin(fv.STALE_WATERMARKS)


def latency_band(latency: ColumnLike) -> Column:
    latency = col(latency)
    return F.when(latency >= 1000, "slow").when(latency >= 500, "warm").otherwise("fast")


def cost_band(cost: ColumnLike) -> Column:
    cost = F.coalesce(col(cost), F.lit(0.0))
    return F.when(cost >= 0.05, "high").when(cost >= 0.01, "medium").otherwise("low")


def run_state(status: ColumnLike) -> Column:
    status = F.upper(col(status))
    return (F.when(status.isin(fv.RUN_SUCCESS), "success")
            .when(status.isin(fv.RUN_ACTIVE), "running")
            .when(status.isin(fv.RUN_CANCELLED), "cancelled").otherwise("failed"))


def duration_band(duration: ColumnLike) -> Column:
    duration = col(duration)
    return (F.when(duration.isNull(), "unknown").when(duration < 1000, "fast")
            .when(duration < 10000, "normal").otherwise("slow"))


def alert_family(kind: ColumnLike) -> Column:
    kind = col(kind)
    return (F.when(kind.isin(fv.RUN_ALERTS), "bundle")
            .when(kind.isin(fv.RUNTIME_ALERTS), "runtime").otherwise("other"))


def severity(kind: ColumnLike) -> Column:
    kind = col(kind)
    return (F.when(kind.isin(fv.RUN_ALERTS), "high")
            .when(kind.isin(fv.MEDIUM_SEVERITY_KINDS), "medium").otherwise("low"))


def badge(label: ColumnLike) -> Column:
    """Dashboard class of an alert from the words in its severity or kind."""
    text = F.lower(F.coalesce(blank_to_null(label), F.lit("info")))
    return (F.when(text.contains("critical") | text.contains("error"), "critical")
            .when(text.contains("warning") | text.contains("latency") | text.contains("cost"),
                  "warning").otherwise("info"))


def lookup(value: ColumnLike, table: dict[str, object], default: object = None) -> Column:
    """Constant table as a chain of comparisons (small, fixed tables only)."""
    value, chain = col(value), None
    for key, result in table.items():
        chain = (F.when(value == key, F.lit(result)) if chain is None
                 else chain.when(value == key, F.lit(result)))
    return chain.otherwise(F.lit(default))


def escalation(kind: ColumnLike) -> Column:
    return lookup(kind, fv.ESCALATIONS, "review")


# Models ----------------------------------------------------------------------------------------

def regime_label(change_7d: ColumnLike) -> Column:
    change = col(change_7d)
    return (F.when(change > 5.0, "bull").when(change < -5.0, "risk_off")
            .when(change.between(-2.0, 2.0), "neutral").otherwise("bear"))
