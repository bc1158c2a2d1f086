"""Text signals, cleaning, tiers and costs of request messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.functions.columns import ColumnLike, col, labels_where, lookup

# Whitespace as a text split sees it: the Unicode White_Space set and the ASCII separators.
_WORD = "(?U)[^\\s\\x1c-\\x1f]+"


def word_count(text: ColumnLike) -> Column:
    return F.regexp_count(col(text), F.lit(_WORD))


def signals(lowered: ColumnLike, words: list[str]) -> Column:
    """The phrases of ``words`` found in a text already in lower case, in list order."""
    lowered = col(lowered)
    return labels_where([(lowered.contains(word), word) for word in words])


def sanitize(text: ColumnLike, limit: int = 2000) -> Column:
    """Drop control characters (tab and newline stay), strip, cut at ``limit`` characters."""
    visible = F.regexp_replace(F.coalesce(col(text), F.lit("")), "[\\x00-\\x08\\x0b-\\x1f]", "")
    return F.substring(F.regexp_replace(visible, "(?U)^\\s+|\\s+$", ""), 1, limit)


def route_class(structured: Column, narrative: Column) -> tuple[Column, Column, Column]:
    """(route, reason, signals): structured words win over narrative ones."""
    route = F.when(F.size(structured) > 0, "genie").otherwise("copilot")
    reason = (F.when(F.size(structured) > 0, "structured_analytics_request")
              .when(F.size(narrative) > 0, "narrative_market_request")
              .otherwise("default_copilot_path"))
    found = F.when(F.size(structured) > 0, structured).otherwise(narrative)
    return route, reason, found


def tier_class(words: Column, complex_hits: Column, light_hits: Column, assets: Column,
               turns: Column) -> tuple[Column, Column, Column, Column]:
    """(tier, reason, signals, estimated prompt tokens)."""
    has_complex = F.size(complex_hits) > 0
    is_complex = has_complex | (words >= 60) | (assets >= 4) | (turns >= 5)
    is_light = (F.size(light_hits) > 0) & (words <= 12) & (turns <= 1) & (assets <= 1)
    tier = F.when(is_complex, "complex").when(is_light, "light").otherwise("standard")
    reason = (F.when(has_complex, "complex_signal").when(words >= 60, "long_query")
              .when(assets >= 4, "high_asset_count").when(turns >= 5, "deep_conversation")
              .when(is_light, "simple_factual_lookup").otherwise("standard_market_analysis"))
    found = (F.when(is_complex, complex_hits).when(is_light, light_hits)
             .otherwise(F.array().cast("array<string>")))
    floor = F.when(is_complex, 200).when(is_light, 30).otherwise(80)
    return tier, reason, found, F.greatest(words * 2, floor)


def token_cost(tier: ColumnLike, tokens: ColumnLike) -> Column:
    rate = lookup(tier, fv.COST_PER_1K_TOKENS, fv.COST_PER_1K_TOKENS["standard"])
    return F.round(col(tokens) / F.lit(1000.0) * rate, 6)
