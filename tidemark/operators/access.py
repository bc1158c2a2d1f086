"""Row filter and column mask; the caller's identity is a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv


def is_admin(groups: Sequence[str]) -> bool:
    return bool(set(groups) & set(fv.ADMIN_GROUPS))


def row_filter(df: DataFrame, user: str, groups: Sequence[str],
               owner_col: str | None = "user_id") -> DataFrame:
    """Admins see all rows, others their own; without an owner column they see none."""
    if is_admin(groups):
        return df
    return df.filter(F.col(owner_col) == user if owner_col else F.lit(False))


def mask(df: DataFrame, col: str, groups: Sequence[str]) -> DataFrame:
    """The value for admins, null for everybody else."""
    if is_admin(groups):
        return df
    return df.withColumn(col, F.lit(None).cast(df.schema[col].dataType))
