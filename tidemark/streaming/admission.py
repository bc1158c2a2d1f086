"""Rate-limit admission with keyed state."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import admission
from tidemark.functions.admission import admit

# The stream's driver-side worker does not see added files, so the processor travels by value.
cloudpickle.register_pickle_by_value(admission)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


KEY = "admission_key"  # the pandas path renames columns that begin with a line
BUCKETS = 2048  # of keys; a part of the checkpoint, whose state lies under them


class SlidingWindows(StatefulProcessor):
    """State of a bucket of keys: per key the admitted times inside the window (at most ``limit`` longs). The rows of a
    bucket are sorted together and a key reads and writes its own times only, so a key costs two calls of the state
    store and no frame of its own."""

    def __init__(self, columns: list[str], ts: str, tie: list[str], limit: int,
                 window: int) -> None:
        self.columns, self.order, self.limit, self.window = columns, [ts, *tie], limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "name string", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame],
                        timerValues) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows))
        lost = whole[self.order[0]].isna()
        if lost.any():  # without a time there is no decision
            yield whole.loc[lost, self.columns].assign(
                admitted=pd.array([None] * int(lost.sum()), "boolean"),
                retry_after_s=pd.array([None] * int(lost.sum()), "Int64"))
        batch = whole[~lost].sort_values([KEY, *self.order], kind="stable")
        names = batch[KEY].to_numpy(object)
        times = batch[self.order[0]].to_numpy("datetime64[us]").astype(np.int64)
        edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else [0]
        admitted, retry = np.zeros(len(names), dtype=bool), np.zeros(len(names), dtype=np.int64)
        for low, high in zip(edges[:-1], edges[1:]):
            before = self.held.getValue((names[low],))
            admitted[low:high], retry[low:high], held = admit(
                times[low:high], list(before[0]) if before is not None else [], self.limit, self.window)
            self.held.updateValue((names[low],), (held,))
        yield batch[self.columns].assign(admitted=admitted, retry_after_s=retry)

    def close(self) -> None:
        pass


def _key_text(requests: DataFrame, key: Sequence[str]) -> Column:
    """One text per key: parts with their lengths, so that no two keys share one; null is a key."""
    def part(name: str) -> Column:
        kind, value = requests.schema[name].dataType, F.col(name)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            value = value + F.lit(0.0).cast(kind)  # -0.0 is 0.0, as in a grouping
        text = F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string")
        return F.when(F.col(name).isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))

    return F.concat(*[part(name) for name in key])


def stream_rate_limit(requests: DataFrame, key: Sequence[str], ts: str, tie: Sequence[str],
                      limit: int = 12, seconds: int = 60) -> DataFrame:
    """Adds ``admitted`` and ``retry_after_s`` to every row, late ones included. Rows of a key are
    decided in time order within a micro-batch; a late row meets the admitted times that are held by
    then. The size of a micro-batch (files or offsets per trigger) bounds what one key, or one of the
    BUCKETS the keys are dealt to, brings at a time, so set it on the source. State is at most ``limit`` times per key and has no timer: one in
    event time would drop late rows, one in clock time keeps an available-now run from ending. Rows without a time get null in both columns. Needs the RocksDB state store."""
    columns = requests.columns
    schema = T.StructType(list(requests.schema) + [
        T.StructField("admitted", T.BooleanType()), T.StructField("retry_after_s", T.LongType())])
    named = requests.withColumn(KEY, _key_text(requests, key))
    dealt = named.withColumn("admission_bucket", F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("admission_bucket").transformWithStateInPandas(
        SlidingWindows(columns, ts, list(tie), limit, seconds * 1_000_000),
        schema, "append", "None")
