"""Typing of frames at the edge: casts to a declared or an existing schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas

_CASTABLE = (T.DecimalType, T.DoubleType, T.LongType, T.IntegerType, T.TimestampType,
             T.StringType)


def _typed(name: str, data_type: T.DataType) -> Column:
    return F.col(name).try_cast(data_type).alias(name)


def align_to_schema(df: DataFrame, target: T.StructType) -> DataFrame:
    """Shared columns only, in target order; scalar columns cast, others passed on as they are."""
    shared = [field for field in target if field.name in df.columns]
    if not shared:
        return df
    return df.select(*[
        F.col(f.name).cast(f.dataType).alias(f.name) if isinstance(f.dataType, _CASTABLE)
        else F.col(f.name) for f in shared])


def conform(df: DataFrame, target: T.StructType) -> DataFrame:
    """Exactly the declared columns; values that do not fit become null, not an error."""
    return df.select(*[
        _typed(f.name, f.dataType) if f.name in df.columns
        else F.lit(None).cast(f.dataType).alias(f.name) for f in target])


def to_bronze_market(df: DataFrame) -> DataFrame:
    """The 14 typed landing columns, symbol in upper case."""
    return conform(df, schemas.BRONZE_MARKET).withColumn("symbol", F.upper("symbol"))
