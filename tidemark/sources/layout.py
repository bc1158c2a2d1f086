"""Layout by several columns at once: rows in the order of a curve that fills the grid of their quantiles.

Each column's values become ranks among quantiles taken in one pass, the ranks' binary digits are interleaved,
and rows are range-partitioned by the result. A file then spans a small range of every column, so the
statistics of parquet let a filter on any one of them skip most files.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 6  # of a rank: up to 63 quantiles of a column, a list that fits in an expression
ACCURACY = 2_000  # of the quantile sketches, which merge over tasks


def ordered_number(column: Column, kind: T.DataType) -> Column:
    """A number in the order of the values; of texts and bytes in that of their first seven bytes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        head = F.rpad(F.substring(column.cast("binary"), 1, 7), 7, F.lit(b"\0"))
        return F.conv(F.hex(head), 16, 10).cast("double")
    if isinstance(kind, (T.DateType, T.BooleanType)):
        return F.unix_date(column).cast("double") if isinstance(kind, T.DateType) else column.cast("int").cast("double")
    if isinstance(kind, (T.NumericType, T.TimestampType)):
        return column.cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return column.cast("timestamp").cast("double")
    raise ValueError(f"a column of {kind.simpleString()} has no order to lay rows out by")


def quantiles(df: DataFrame, cols: Sequence[str], bits: int = BITS) -> dict[str, list[float]]:
    """Distinct quantiles of each column, at most 2**bits - 1; none of a column without values."""
    shares = F.array(*[F.lit(k / (1 << bits)) for k in range(1, 1 << bits)])
    found = df.agg(*[F.percentile_approx(ordered_number(F.col(c), df.schema[c].dataType), shares, ACCURACY).alias(f"q{i}")
                     for i, c in enumerate(cols)]).first()
    return {c: sorted(set(found[i] or [])) for i, c in enumerate(cols)}


def rank(value: str, bounds: list[float]) -> Column:
    """The number of bounds up to the value of an SQL expression, found by halving; 0 for null."""
    def search(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"CASE WHEN {value} < double('{bounds[middle]!r}') THEN {search(low, middle)} ELSE {search(middle + 1, high)} END"

    return F.expr(f"CASE WHEN {value} IS NULL THEN 0 ELSE {search(0, len(bounds))} END")


def curve(ranks: Sequence[Column], bits: int = BITS) -> Column:
    """The ranks' digits in turn, highest first: a place on the Z-order curve, as a long."""
    digits = [F.shiftleft(F.shiftright(r, k).bitwiseAND(F.lit(1)).cast("long"), k * len(ranks) + len(ranks) - 1 - i)
              for k in range(bits) for i, r in enumerate(ranks)]
    return reduce(Column.bitwiseOR, digits)


def write_curve(df: DataFrame, path: str, cols: Sequence[str], files: int | None = None, bits: int = BITS) -> None:
    """Write ``df`` along the curve over ``cols``, into about ``files`` files (else as many as the shuffle gives).

    Rows of one cell of the grid are sorted by the columns and may spread over several files. Nulls lie
    before all values. An empty table is written with its schema."""
    if not 1 <= bits * len(cols) <= 62:
        raise ValueError(f"{len(cols)} columns of {bits} bits do not fit in a long")
    bounds, names = quantiles(df, cols, bits), {c: f"_{uuid.uuid4().hex}" for c in cols}
    numbered = df.withColumns({names[c]: ordered_number(F.col(c), df.schema[c].dataType) for c in cols})
    keys = [curve([rank(names[c], bounds[c]) for c in cols], bits), *[F.col(c) for c in cols]]
    dealt = numbered.repartitionByRange(files, *keys) if files else numbered.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).drop(*names.values()).write.mode("overwrite").parquet(path)
