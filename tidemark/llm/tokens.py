"""Token ids of documents in bit-packed files, and separators in flat token files.

The packed writer brings the documents into ascending doc_id order by a range partitioning; the flat
one takes them as they lie. Both encode partition by partition and write binary files through Spark's text sink (one record per file, its
line end being the last byte of the format), so Spark's commit protocol covers them and any file
system that Spark knows will do. Readers get the files from Spark as bytes.

Packed file: PACK, uint8 width, uint32 number of documents, then per document int64 doc_id (the
lowest int64 for null) and uint32 ids, then uint32 number of blocks and the uint64 byte offset of each
block, then the blocks: BLOCK ids (the last may have fewer) of ``width`` bits, lowest bit first, each
block filled to a whole byte; uint64 order (partition << 32 | file), and the line end.

Flat file: ids as little-endian uint16 (uint32 beyond 2**16), uint64 order, the line end; no index. It
is gzipped at rest.
"""

from __future__ import annotations

import gzip
import os
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWEST, prepare, released, settle, small_batches
from tidemark.session import run_folder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
PACK = b"TPK1"
BLOCK = 4096  # ids of a block
FILE_IDS = 2_000_000  # a file is closed by the document that reaches so many ids
PARTITION_BYTES = 16 << 20  # text bytes of a partition, about
CACHED_BYTES = 40 << 20  # of words and ids that a task remembers, with ENTRY_BYTES for each; then it starts anew
ENTRY_BYTES = 64
JOINED_WORDS = 100  # that are encoded as one text
ENCODED_TEXTS = 16  # that the tokenizer gets at once
RUN_CHARS = 1 << 20  # texts of so many characters are learned at once; longer ones are cut where that changes no id
TEXT_CHARS = 64  # that a text counts beside its own, so that runs of empty texts end too


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


# Texts of these characters only are cut into the pre-tokenizer's words; all others are encoded whole.
_LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
_PLAIN = re.compile(rf"[\x00-\x1b\x20-\x7e{_LETTER}]*")
_STOP = b"\xff"  # follows each text of a run; no byte of a text is it
# Kinds of the bytes of such texts: a byte of another letter than A to z is 0x80 or more.
_OTHER, _ALPHA, _DIGIT, _SPACE, _END = range(5)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 255)]] = _ALPHA
_KINDS[48:58], _KINDS[[9, 10, 11, 12, 13, 32]], _KINDS[255] = _DIGIT, _SPACE, _END


def word_starts(raw: np.ndarray) -> np.ndarray:
    """Where the words of ``'s|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?others|\\s+(?!\\S)|\\s+`` begin in the bytes of
    plain texts, each followed by _STOP, which is a word of its own."""
    kind = _KINDS[raw]
    start = np.ones(len(raw), bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == _END
    # The last space character before a word is not of the run before it; a blank is the word's own.
    heads = np.flatnonzero(start & (kind < _SPACE))
    last = heads[(heads > 0) & (kind[heads - 1] == _SPACE)] - 1
    start[last] = True
    start[last[raw[last] == 32] + 1] = False
    # An apostrophe by itself takes the letters of a contraction; a blank before it has made it another's.
    quotes = np.flatnonzero(start & (raw == 39))
    quotes = quotes[kind[quotes + 1] == _ALPHA]
    one, two = raw[quotes + 1], raw[quotes + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[quotes[short | long] + 1] = False
    start[quotes[short] + 2] = True
    start[quotes[long] + 3] = True
    return np.flatnonzero(start)


# Between these the pre-tokenizer's words end in any context, so a text can be cut there.
_CUT = re.compile(r"(?<=[0-9A-Za-z.,]\n)(?=[0-9A-Za-z])")


def pieces(text: str) -> list[str]:
    """``text`` in pieces of at least RUN_CHARS that give its ids one behind the other."""
    cuts = [0]
    while len(text) - cuts[-1] > RUN_CHARS and (found := _CUT.search(text, cuts[-1] + RUN_CHARS)):
        cuts.append(found.start())
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


_NO_IDS = np.array([], "<u4")


def binaries(raw: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The runs of ``raw`` that end before each of ``ends``, counted in items of ``raw``."""
    offsets = np.zeros(len(ends) + 1, np.int64)
    np.multiply(ends, raw.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def items(array: pa.LargeBinaryArray, kind: str = "u1") -> tuple[np.ndarray, np.ndarray]:
    """All items of ``array``, one value behind the other, and where each value ends."""
    _, offsets, raw = array.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(array) + 1, 8 * array.offset)
    size = np.dtype(kind).itemsize
    found = np.frombuffer(raw or b"", kind, (offsets[-1] - offsets[0]) // size, offsets[0])
    return found, (offsets[1:] - offsets[0]) // size


class Encoder:
    """Ids of whole texts, equal to those of the tokenizer's own ``encode``.

    Byte-level BPE merges within the words of its pre-tokenizer only, so the distinct words of many texts
    are given to the tokenizer at once and remembered, as Arrow columns ``word`` and ``ids`` (little-endian uint32), which
    are searched for all words of many texts at once. ``special`` tells whether the names of special tokens
    in a text count as these tokens, which is the tokenizer's default."""

    def __init__(self, path: str, special: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.opens = np.zeros(self.size(), bool)  # tokens that begin with a space, as the vocabulary writes it
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token[0] == "Ġ"]] = True
        # For joined words, which are cut already: no rule, as merges alone tell the ids, else that a blank begins a word.
        model = self.tokenizer.model
        whole = not (getattr(model, "ignore_merges", True) or model.continuing_subword_prefix or model.end_of_word_suffix)
        self.blanks = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next")] * (not whole) + [
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.forget()

    def size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def forget(self) -> None:
        self.known = pa.record_batch([pa.array([_STOP], pa.large_binary()), pa.array([b""], pa.large_binary())], ["word", "ids"])
        self.older = self.known.slice(0, 0)
        self.held = 0

    def _encoded(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text by the tokenizer, ENCODED_TEXTS at a time: what it returns is many times their size."""
        texts = iter(texts)
        while some := [text.decode() for text in islice(texts, ENCODED_TEXTS)]:
            for found in self.tokenizer.encode_batch_fast(some, add_special_tokens=False):
                yield np.array(found.ids, "<u4")

    def _joined(self, words: pa.LargeBinaryArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The ids of words that begin with a space, encoded as texts of many such words. Where as many tokens begin with a
        space as there are words, no merge went over a space, so merges were those within the words and each begins at such
        a token. False for the words of other texts."""
        raw, ends = items(words)
        cuts = [0, *ends[JOINED_WORDS - 1::JOINED_WORDS].tolist()]
        if len(words) % JOINED_WORDS:
            cuts.append(len(raw))
        held, sizes, parts = np.ones(len(words), bool), [], []
        rules, self.tokenizer.pre_tokenizer = self.tokenizer.pre_tokenizer, self.blanks
        for i, ids in enumerate(self._encoded(raw[a:b].tobytes() for a, b in zip(cuts, cuts[1:]))):
            group = held[i * JOINED_WORDS:(i + 1) * JOINED_WORDS]
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(group):
                sizes.append(np.diff(starts, append=len(ids)))
                parts.append(ids)
            else:
                group[:] = False
        self.tokenizer.pre_tokenizer = rules
        return binaries(np.concatenate([*parts, _NO_IDS]), np.cumsum(np.concatenate([*sizes, _NO_IDS], dtype=np.int64))), held

    def _learn(self, words: pa.LargeBinaryArray) -> None:
        """Adds ``words`` behind what is known. Where that has grown to half of CACHED_BYTES it becomes the older half, from
        which words come back when they are met again, and the older half before it is forgotten."""
        at = pc.index_in(words, value_set=self.older["word"])
        there = at.is_valid().to_numpy(zero_copy_only=False)
        raw, ends = items(words)
        starts = np.append(0, ends)[:-1]
        spaced = ~there & (raw[starts] == 32) & (ends - starts > 1)
        spaced[spaced] = _KINDS[raw[starts[spaced] + 1]] != _SPACE
        joined, held = self._joined(words.filter(pa.array(spaced)))
        spaced[spaced] = held
        rest = ~there & ~spaced
        alone = [*self._encoded(words.filter(pa.array(rest)).to_pylist())]
        ids = pa.concat_arrays([self.older["ids"].take(at.drop_null()), joined, binaries(
            np.concatenate([*alone, _NO_IDS]), np.cumsum([len(x) for x in alone], dtype=np.int64))])
        back = np.empty(len(words), np.int64)  # where a word's ids are among these
        back[np.concatenate([np.flatnonzero(x) for x in (there, spaced, rest)])] = np.arange(len(words))
        self.known = pa.record_batch([pa.concat_arrays([self.known["word"], words]),
                                      pa.concat_arrays([self.known["ids"], ids.take(pa.array(back))])], ["word", "ids"])
        self.held += len(raw) + ENTRY_BYTES * len(words)

    def _ids(self, words: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The ids of each of the distinct ``words``."""
        if self.held > CACHED_BYTES // 2:
            older = self.known
            self.forget()
            self.older = older
        before, at = len(self.known), pc.index_in(words, value_set=self.known["word"])
        if at.null_count:
            new = at.is_null()
            self._learn(words.filter(new))
            at = pc.replace_with_mask(at, new, pa.array(np.arange(before, len(self.known), dtype=np.int32)))
        return self.known["ids"].take(at)

    def _run(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        plain = [_PLAIN.fullmatch(t) is not None and not any(n in t for n in self.names) for t in texts]
        raw = np.frombuffer(b"".join([t.encode() + _STOP if p else _STOP for t, p in zip(texts, plain)]), np.uint8)
        starts = word_starts(raw)
        stops = np.flatnonzero(raw[starts] == _STOP[0])
        words = binaries(raw, np.append(starts[1:], len(raw))).dictionary_encode()
        del raw, starts
        ids, ends = items(self._ids(words.dictionary).take(words.indices), "<u4")
        return [part if p else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
                for text, p, part in zip(texts, plain, np.split(ids, ends[stops]))]

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in runs of about RUN_CHARS."""
        run, held = [], 0
        for text in texts:
            if len(text) > RUN_CHARS:
                yield from self._run(run)
                run, held = [], 0
                yield np.concatenate([self._run([piece])[0] for piece in pieces(text)])
                continue
            run.append(text)
            held += len(text) + TEXT_CHARS
            if held >= RUN_CHARS:
                yield from self._run(run)
                run, held = [], 0
        yield from self._run(run)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))


@lru_cache(maxsize=1)
def encoder(path: str, special: bool = True) -> Encoder:
    """One per worker process, for its vocabulary; tasks forget the words they learned."""
    return Encoder(path, special)


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids of ``width`` bits each, lowest bit first, filled to a whole byte."""
    if width in (8, 16, 32):  # whole bytes are these bits already
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype("<u4")[:, None] >> np.arange(width, dtype="<u4")) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes | memoryview, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a block, gathered from the bytes that each id touches."""
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", n).astype("<u4")
    padded = np.frombuffer(bytes(raw) + b"\0" * 8, np.uint8)
    at = np.arange(n, dtype=np.int64) * width
    value = np.zeros(n, np.uint64)
    for k in range((width + 7) // 8 + 1):
        value |= padded[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype("<u4")


def packed_file(ids: list[np.ndarray], doc_ids: list[int], width: int, order: int) -> bytes:
    """A file's bytes but for the line end, which the sink adds."""
    stream = np.concatenate(ids)
    blocks = [pack_bits(stream[i:i + BLOCK], width) for i in range(0, len(stream), BLOCK)]
    index = np.zeros(len(ids), np.dtype([("doc_id", "<i8"), ("n", "<u4")]))
    index["doc_id"], index["n"] = doc_ids, [len(x) for x in ids]
    head = PACK + struct.pack("<BI", width, len(ids)) + index.tobytes() + struct.pack("<I", len(blocks))
    first = len(head) + 8 * len(blocks)
    offsets = first + np.cumsum([0, *map(len, blocks)])[:-1].astype("<u8") if blocks else np.array([], "<u8")
    return head + offsets.astype("<u8").tobytes() + b"".join(blocks) + struct.pack("<Q", order)


class PackedFile:
    """Random access to a packed file's documents and ids."""

    def __init__(self, raw: bytes) -> None:
        assert raw[:4] == PACK and raw[-1:] == b"\n", "not a whole packed file"
        self.raw = memoryview(raw)
        self.width, n = struct.unpack_from("<BI", raw, 4)
        self.index = np.frombuffer(raw, np.dtype([("doc_id", "<i8"), ("n", "<u4")]), n, 9)
        at = 9 + 12 * n
        (blocks,) = struct.unpack_from("<I", raw, at)
        self.offsets = np.frombuffer(raw, "<u8", blocks, at + 4).astype(np.int64)
        (self.order,) = struct.unpack_from("<Q", raw, len(raw) - 9)
        self.starts = np.concatenate([[0], np.cumsum(self.index["n"], dtype=np.int64)])

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids low..high of the file's stream; only the blocks that hold them are unpacked."""
        if low >= high:
            return np.array([], "<u4")
        total, parts = int(self.starts[-1]), []
        for b in range(low // BLOCK, (high - 1) // BLOCK + 1):
            at = int(self.offsets[b])
            n = min(BLOCK, total - b * BLOCK)
            block = unpack_bits(self.raw[at:at + (n * self.width + 7) // 8], self.width, n)
            parts.append(block[max(0, low - b * BLOCK):high - b * BLOCK])
        return np.concatenate(parts)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def flat_file(ids: list[np.ndarray], doc_ids: list[int], width: int, order: int) -> bytes:
    kind = "<u2" if width <= 16 else "<u4"
    return np.concatenate(ids).astype(kind).tobytes() + struct.pack("<Q", order)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, make=packed_file,
                 special: bool = True, ordered: bool = True, compression: str = "none") -> int:
    """Encode whole texts (null: empty), each followed by ``end_id``, into files below ``path``; returns
    the width in bits. ``ordered`` brings them into ascending doc_id order (nulls first, ties by a hash of the
    text), in partitions of about PARTITION_BYTES; else they stay in the order of the partitions given, unshuffled.

    A file holds about FILE_IDS ids, whatever the input's size."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    width = max(1, int(max(encoder(vocabulary, special).size() - 1, end_id)).bit_length())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(vocabulary, special), np.array([end_id], "<u4")
        partition, made = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        ids: list[np.ndarray] = []
        names: list[int] = []
        held = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([make(ids, names, width, partition << 32 | made)],
                                                        pa.binary())], ["value"])

        waiting: deque[int | None] = deque()

        def texts() -> Iterator[str]:
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                    waiting.append(doc_id)
                    yield text.as_py()

        for found in code.encode_all(texts()):
            doc_id = waiting.popleft()
            ids.append(np.concatenate([found, end]))
            names.append(LOWEST if doc_id is None else doc_id)
            held += len(ids[-1])
            if held >= FILE_IDS:
                yield full()
                made, held = made + 1, 0
                ids.clear(), names.clear()
        code.forget()
        if ids:
            yield full()
            ids.clear()

    if ordered:
        n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        rows = (rows.withColumn("tie", F.xxhash64("text"))
                .repartitionByRange(max(1, -(-n_bytes // PARTITION_BYTES)), F.col("doc_id").asc_nulls_first(), "tie")
                .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text").drop("tie"))
    files = rows.mapInArrow(released(encode), "value binary").select(F.col("value").cast("string").alias("value"))
    with small_batches(docs.sparkSession):
        files.write.option("lineSep", "\n").option("maxRecordsPerFile", 1).option("compression", compression).text(path)
    return width


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the written files, none if there are no documents."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .filter("length > 1").select("content"))


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(order, doc_id, local_start, n_tokens, ids_crc32) from the packed files at ``path``."""
    names = ["order", "doc_id", "local_start", "n_tokens", "ids_crc32"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["content"]:
                file = PackedFile(raw.as_py())
                rows = range(len(file.index))
                crc = [zlib.crc32(file.document(i).astype("<u4").tobytes()) for i in rows]
                doc_ids = [None if d == LOWEST else d for d in file.index["doc_id"].tolist()]
                columns = [[file.order] * len(rows), doc_ids, file.starts[:-1].tolist(), file.index["n"].tolist(), crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return token_files(spark, path).mapInArrow(released(read), ", ".join(f"`{n}` long" for n in names))


def before_each(rows: DataFrame, key: str, sums: dict[str, Column], coarse: int = 1 << 10) -> DataFrame:
    """Adds, for each of ``sums``, its total over all rows of lower ``key`` (unique, from 0). Rows are numbered by runs of
    ``coarse`` keys, runs by runs of runs, and so on until one run is left: no window is longer than ``coarse``."""
    most = rows.agg(F.max(key)).first()[0] or 0
    table = rows.select(F.col(key).alias("_key"), *[v.cast("long").alias(n) for n, v in sums.items()])
    levels = [table]
    while most >= coarse:
        most //= coarse
        table = table.groupBy(F.expr(f"_key div {coarse}").alias("_key")).agg(*[F.sum(n).alias(n) for n in sums])
        levels.append(table)
    found = None
    for table in reversed(levels):
        run = F.expr(f"_key div {coarse}")
        order = Window.partitionBy("_run").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
        inside = table.withColumn("_run", run).withColumns({n: F.coalesce(F.sum(n).over(order), F.lit(0)) for n in sums})
        if found is not None:
            above = found.select(F.col("_key").alias("_run"), *[F.col(n).alias(f"_{n}") for n in sums])
            inside = inside.join(above, "_run").withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums})
        found = inside.select("_key", *sums)
    return rows.join(found.withColumnRenamed("_key", key), key)


def with_file_starts(rows: DataFrame, size: str) -> DataFrame:
    """Adds ``before``: the sum of ``size`` over all files of lower order. Files are numbered within their partition
    and partitions from 0, so two prefix sums give it."""
    files = rows.groupBy("order").agg(F.sum(size).alias("n")).select(
        F.shiftright("order", 32).alias("part"), F.col("order").bitwiseAND(F.lit(0xFFFFFFFF)).alias("file"), "order", "n")
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    parts = before_each(files.groupBy("part").agg(F.sum("n").alias("n")), "part", {"part_before": F.col("n")})
    before = (files.withColumn("file_before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts.drop("n"), "part")
              .select("order", (F.col("part_before") + F.col("file_before")).alias("before")))
    return rows.join(before, "order")


def packed(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per document, read back from packed files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it in ascending doc_id order; a null doc_id comes
    first, equal ones follow a hash of their texts, so equal rows can stand for each other. A null or
    empty text has the end id alone. An empty table gives no rows."""
    spark, path = docs.sparkSession, run_folder(docs.sparkSession, "packed")
    write_tokens(docs, path, vocabulary or vocabulary_path(), end_id)
    rows = with_file_starts(settle(read_packed(spark, path), "read"), "n_tokens")
    return rows.select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def scan_separators(files: DataFrame, end_id: int, wide: bool = False, block: int = 1 << 18,
                    zipped: bool = False) -> DataFrame:
    """(doc_no, start, n_tokens) from flat token files: a document ends with each ``end_id``.

    Files are cut into blocks; numpy finds the separators of a block. A prefix scan over one row per
    block gives each block the number of documents that ended before it and where the open one began,
    which stitches documents that cross blocks and files. Ids after the last separator make a last document."""
    kind, names = ("<u4" if wide else "<u2"), ["order", "block", "size", "n_ends", "first_end", "last_end"]

    def ids_of(raw: bytes) -> tuple[int, np.ndarray]:
        raw = gzip.decompress(raw) if zipped else raw
        if not raw:  # the file that the sink writes for no rows
            return 0, np.array([], kind)
        return struct.unpack("<Q", raw[-9:-1])[0], np.frombuffer(raw, kind, (len(raw) - 9) // np.dtype(kind).itemsize)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["content"]:
                order, ids = ids_of(raw.as_py())
                rows = []
                for b in range(0, len(ids), block):
                    ends = np.flatnonzero(ids[b:b + block] == end_id)
                    rows.append((order, b // block, min(block, len(ids) - b), len(ends),
                                 int(ends[0]) if len(ends) else None, int(ends[-1]) if len(ends) else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that begin and end in one block: all ends of a block but its first."""
        for batch in batches:
            for raw in batch["content"]:
                order, ids = ids_of(raw.as_py())
                for b in range(0, len(ids), block):
                    ends = np.flatnonzero(ids[b:b + block] == end_id)
                    if len(ends) > 1:
                        k = len(ends) - 1
                        columns = [np.full(k, order), np.full(k, b // block), np.arange(1, k + 1), ends[:-1] + 1, np.diff(ends)]
                        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns],
                                                         ["order", "block", "nth", "at", "n_tokens"])

    table = files.mapInArrow(released(blocks), ", ".join(f"`{n}` long" for n in names))
    # The scan runs over one row per block of a quarter million ids.
    before = Window.orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = (table.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
               .withColumn("docs_before", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
               .withColumn("open", F.coalesce(F.max(F.col("base") + F.col("last_end") + 1).over(before), F.lit(0))))
    crossing = scanned.filter("n_ends > 0").select(
        F.col("docs_before").alias("doc_no"), F.col("open").alias("start"),
        (F.col("base") + F.col("first_end") + 1 - F.col("open")).alias("n_tokens"))
    within = (files.mapInArrow(released(inner), "`order` long, block long, nth long, at long, n_tokens long")
              .join(scanned.select("order", "block", "base", "docs_before"), ["order", "block"])
              .select((F.col("docs_before") + F.col("nth")).alias("doc_no"), (F.col("base") + F.col("at")).alias("start"),
                      "n_tokens"))
    ends = scanned.agg(F.sum("size").alias("all"), F.sum("n_ends").alias("doc_no"),
                       F.coalesce(F.max(F.col("base") + F.col("last_end") + 1), F.lit(0)).alias("start"))
    rest = ends.filter("`all` > start").select("doc_no", "start", (F.col("all") - F.col("start")).alias("n_tokens"))
    return crossing.unionByName(within).unionByName(rest)


FLAT_END = 50256  # the vocabulary's own end of text


def counted_tokens(docs: DataFrame, vocabulary: str | None = None, end_id: int = FLAT_END) -> DataFrame:
    """(doc_no, start, n_tokens): the documents of a flat token stream, found by their separators alone;
    ``n_tokens`` includes the separator, and documents count from 0 in the order of the stream.

    The stream follows the input's partitions, so no text is shuffled. Special tokens named in a text
    stay ordinary text, so it holds no other separators. A null text has the separator alone; repeated
    rows count each; an empty table gives no rows."""
    spark, path = docs.sparkSession, run_folder(docs.sparkSession, "flat")
    width = write_tokens(docs, path, vocabulary or vocabulary_path(), end_id, flat_file, special=False, ordered=False,
                         compression="gzip")
    return scan_separators(token_files(spark, path), end_id, wide=width > 16, zipped=True)
