"""Fill-in-middle transformation by displacement scatter.

Texts are cut at line ends drawn from a hash of their doc_id. All bytes of a batch lie in one array:
a difference array holds how much farther every segment moves than the one before it, its running sum
is each byte's shift, and one scatter puts all bytes at their places between the sentinels. The way
back finds the sentinels in the output, and the same running sum gathers the bytes again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, released, settle

# The sentinels, the seed of the hash, and the shares in percent.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 7
RATE = 100  # of all documents
SPM = 50  # of the transformed ones
FORMS = ("plain", "psm", "spm")
PLAIN_FORM, PSM_FORM, SPM_FORM = range(3)

MARK = 3  # bytes of a sentinel
BLOCK = 1 << 20  # bytes that move at once
CHUNK = 1 << 22  # bytes of the texts held in one array; a longer text has one of its own


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """The first four 32-bit numbers of the digest of seed and doc_id (null: nothing behind the colon)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def shifts(at: np.ndarray, change: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(low, high, place) for runs of positions below ``size``: each position plus the running sum of
    ``change``, which happens at the ascending positions ``at``."""
    moved = 0
    for low in range(0, size, BLOCK):
        high = min(low + BLOCK, size)
        first, last = np.searchsorted(at, [low, high])
        step = np.ones(high - low, np.int64)
        step[0] = low + moved
        np.add.at(step, at[first:last] - low, change[first:last])
        moved += int(change[first:last].sum())
        yield low, high, np.cumsum(step)


def marks(raw: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Where a sentinel begins that lies in one of the texts from ``base[i]`` to ``base[i + 1]``."""
    if len(raw) < MARK:
        return np.zeros(0, np.int64)
    likely = np.flatnonzero((raw[:-2] == PREFIX[0]) & (raw[2:] == PREFIX[2]))
    likely = likely[np.isin(raw[likely + 1], [PREFIX[1], SUFFIX[1], MIDDLE[1]])]
    return likely[likely + MARK <= base[np.searchsorted(base, likely, side="right")]]


def _differences(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    return np.diff((target - source).ravel(), prepend=0)


def cut(raw: np.ndarray, base: np.ndarray, drawn: np.ndarray, rate: int = RATE, spm: int = SPM
        ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, form, ends) of each text from ``base[i]`` to ``base[i + 1]``; ``ends`` are the positions behind
    prefix and middle."""
    low, high = base[:-1], base[1:]
    breaks = np.flatnonzero(raw == 10)
    first, last = np.searchsorted(breaks, low), np.searchsorted(breaks, high)
    full = last - first  # lines that end with a line feed
    tail = (high > low) & (np.concatenate([raw, [10]])[np.maximum(high - 1, 0)] != 10)
    lines = full + tail
    units = np.sort(drawn[:, :2] % (lines[:, None] + 1), axis=1)
    behind = np.concatenate([[0], breaks + 1])  # behind the k-th line feed, k from 1
    ends = np.where(units == 0, low[:, None], np.where(
        units <= full[:, None], behind[(first[:, None] + units).clip(max=len(breaks))], high[:, None]))
    found = marks(raw, base)
    marked = np.searchsorted(found, high) > np.searchsorted(found, low)
    plain = (high == low) | marked | (drawn[:, 2] % 100 >= rate)
    form = np.where(plain, PLAIN_FORM, np.where(drawn[:, 3] % 100 < spm, SPM_FORM, PSM_FORM))
    return lines, form, np.where(plain[:, None], low[:, None], ends)


def scattered(raw: np.ndarray, base: np.ndarray, form: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(output bytes, offsets of the outputs)."""
    changed = form != PLAIN_FORM
    source = np.column_stack([base[:-1], ends])  # first bytes of prefix, middle, suffix
    size = np.diff(np.column_stack([source, base[1:]]), axis=1)
    offsets = np.concatenate([[0], np.cumsum(np.diff(base) + 3 * MARK * changed)])
    start = offsets[:-1]
    prefix = start + np.where(changed, MARK, 0) + np.where(form == SPM_FORM, size[:, 2] + MARK, 0)
    suffix = start + np.where(changed, MARK, 0) + np.where(form == PSM_FORM, size[:, 0] + MARK, 0)
    middle = start + np.where(changed, 3 * MARK, 0) + size[:, 0] + size[:, 2]
    suffix = np.where(changed, suffix, start)  # a plain text is all suffix
    out = np.empty(int(offsets[-1]), np.uint8)
    for low, high, place in shifts(source.ravel(), _differences(source, np.column_stack([prefix, middle, suffix])), len(raw)):
        out[place] = raw[low:high]
    for name, place in ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)):
        for k in range(MARK):
            out[place[changed] - MARK + k] = name[k]
    return out, offsets


def gathered(out: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(restored bytes, offsets of the texts), from outputs and forms alone."""
    changed = form != PLAIN_FORM
    low, high = offsets[:-1], offsets[1:]
    found = marks(out, offsets)
    found = found[changed[np.searchsorted(offsets, found, side="right") - 1]]
    found = found.reshape(-1, 3)  # a transformed output holds each sentinel once
    if len(found) != changed.sum():
        raise ValueError("an output does not have its three sentinels")
    place = np.repeat(low[:, None], 3, axis=1)
    place[changed] = found + MARK
    spm = form == SPM_FORM
    # First bytes of prefix, middle and suffix in the output, and the bytes of prefix and suffix.
    prefix = np.where(spm, place[:, 1], place[:, 0])
    suffix = np.where(spm, place[:, 0], place[:, 1])
    n_first = np.where(changed, place[:, 1] - MARK - place[:, 0], high - low)
    n_second = np.where(changed, place[:, 2] - MARK - place[:, 1], 0)
    n_prefix, n_middle = np.where(spm, n_second, n_first), np.where(changed, high - place[:, 2], 0)
    base = np.concatenate([[0], np.cumsum(high - low - 3 * MARK * changed)])
    start = base[:-1]
    target = np.column_stack([start, start + n_prefix, start + n_prefix + n_middle])
    source = np.column_stack([prefix, place[:, 2], suffix])
    text = np.empty(int(base[-1]), np.uint8)
    for a, b, at in shifts(target.ravel(), _differences(target, source), len(text)):
        text[a:b] = out[at]
    return text, base


def _bytes_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about CHUNK bytes, straight from the Arrow buffers."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        own = offsets[row:end + 1]
        yield row, raw[own[0]:own[-1]], own - own[0]
        row = end


def _column(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    if offsets[-1] >= 1 << 31:
        raise ValueError("one text and its sentinels must be below 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


def transform(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n (lines), form, prefix_chars, middle_chars, output.

    Prefix, middle and suffix are whole lines of the whole text; the output is prefix, suffix and middle
    ("psm") or suffix, prefix and middle ("spm"), each behind its sentinel. Of 100 documents about ``rate``
    are transformed and ``spm`` of those in the second order. An empty or null text, and one that holds a
    sentinel, stays as it is ("plain", no counts of characters). A null doc_id draws from the seed alone.
    Rows are transformed one by one, so repeated ones agree; an empty table gives no rows."""
    prepare(docs.sparkSession)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, base in _bytes_of(batch["text"]):
                ids = batch["doc_id"].slice(first, len(base) - 1)
                drawn = np.array([draws(i, seed) for i in ids.to_pylist()], np.int64)
                lines, form, ends = cut(raw, base, drawn, rate, spm)
                out, offsets = scattered(raw, base, form, ends)
                # Bytes that do not continue a character count the code points.
                chars = [[None if f == PLAIN_FORM else int(np.count_nonzero(raw[a:b] & 0xC0 != 0x80)) for f, a, b in zip(
                    form.tolist(), low.tolist(), high.tolist())] for low, high in ((base[:-1], ends[:, 0]), (ends[:, 0], ends[:, 1]))]
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(lines.astype(np.int64)), pa.array([FORMS[f] for f in form.tolist()], pa.string()),
                    *(pa.array(c, pa.int64()) for c in chars), _column(out, offsets)], names)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(
        released(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return rows.withColumn("output", F.col("output").cast("string"))


def restore(rows: DataFrame) -> DataFrame:
    """Adds ``restored``: the text of each ``output`` and ``form``. Other columns stay."""
    prepare(rows.sparkSession)
    names = rows.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "restored binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets in _bytes_of(batch["output"]):
                own = batch.slice(first, len(offsets) - 1)
                form = np.array([FORMS.index(f) for f in own["form"].to_pylist()])
                yield pa.RecordBatch.from_arrays([*own.columns, _column(*gathered(raw, offsets, form))], [*names, "restored"])

    return rows.mapInArrow(released(run), schema).withColumn("restored", F.col("restored").cast("string"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return settle(restore(transform(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")), "digests")
