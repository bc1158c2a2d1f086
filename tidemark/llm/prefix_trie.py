"""Prefix trie of conversations, with subtree totals by time-forward processing.

Turns become digests; a prefix is known by running sums of the digests hashed with their depth, so a
node needs no other row than its own. Nodes are cut into shards: every subtree whose conversations have
at most SHARD_ROWS rows lies in one, by its topmost node. In a shard the nodes are sorted by reverse
level order, and each passes its totals to its parent through a priority queue that spills: what is
popped at a node are its children's totals, all of them, as these came before. The totals of shard
roots are summed per parent, and the nodes above form larger shards, FACTOR times larger each round.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWEST, prepare, released, settle

GROUP = 5  # conversations in a row share the first turns of the first of them
MOST = 9  # a conversation takes fewer turns from it
CHUNK = 1024  # turns of a conversation that are numbered or summed in one window
SHARD_ROWS = 1 << 16  # rows of the conversations below the root of a first shard
FACTOR = 64  # nodes of a later shard: at most so many of each depth
QUEUE_ROWS = 1 << 20  # messages of a queue held in memory
IDS = 12  # bits: ends of a node are joined in runs of 2**IDS ids
HEAVY_BYTES = 32 << 20  # of 24 bytes a row; more nodes above the first shards are joined by a shuffle

NODE = ["conv_id", "depth", "a", "b", "pa", "pb", "n_convs", "bytes"]
TOTALS = ["n_children", "n_leaves", "saved_tokens"]


def _running(rows: DataFrame, chunk: str, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Adds running sums over each conversation in ``order``; ``chunk`` ascends with it. Windows hold one chunk,
    and a window over the chunks' sums adds what came before."""
    own = Window.partitionBy("conv_id", chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", chunk).agg(*[F.sum(v).alias(f"{n}_sum") for n, v in values.items()])
    # Only conversations of several chunks need the second sums.
    sums = sums.withColumn("chunks", F.count(F.lit(1)).over(Window.partitionBy("conv_id"))).filter("chunks > 1")
    sums = sums.select("conv_id", chunk, *[F.sum(f"{n}_sum").over(before).alias(f"{n}_before") for n in values])
    local = rows.withColumns({n: F.sum(v).over(own) for n, v in values.items()})
    return (local.join(sums, ["conv_id", chunk], "left")
            .withColumns({n: F.col(n) + F.coalesce(f"{n}_before", F.lit(0)) for n in values})
            .drop(*[f"{n}_before" for n in values]))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, bytes): turns counted from 1 in order of turn, null first, ties by the digest of
    role and text. Rows without a conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = rows.withColumn("chunk", F.coalesce(F.expr(f"turn div {CHUNK}"), F.lit(LOWEST)))
    return (_running(rows, "chunk", [F.col("turn").asc_nulls_first(), F.col("digest")], {"pos": F.lit(1)})
            .select("conv_id", "pos", "digest", "bytes"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): (conv_id, depth, digest, bytes) of the rebuilt turns, and (conv_id, n) with their
    number. A conversation has the first h turns of the first one of its group, then its own behind its first
    h; h is a checksum of its id below MOST."""
    turns = settle(numbered(conversations), "turns")
    first = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(GROUP))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST))
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own")).withColumn("first", first).withColumn("h", taken)
    convs = (own.join(own.filter("conv_id = first").select(F.col("conv_id").alias("first"), F.col("n_own").alias("n_first")),
                      "first", "left")
             .withColumn("shared", F.least("h", F.coalesce("n_first", F.lit(0))))
             .withColumn("n", F.col("shared") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))))
    convs = settle(convs.select("conv_id", "first", "h", "shared", "n"), "conversations")
    kept = (turns.join(convs, "conv_id").filter("pos > h")
            .select("conv_id", (F.col("shared") + F.col("pos") - F.col("h")).alias("depth"), "digest", "bytes"))
    heads = turns.filter((F.col("pos") < MOST) & (F.pmod("conv_id", F.lit(GROUP)) == 0))
    given = (heads.withColumnRenamed("conv_id", "first").join(convs, "first").filter("pos <= h")
             .select("conv_id", F.col("pos").alias("depth"), "digest", "bytes"))
    return kept.unionByName(given), convs.select("conv_id", "n")


def _key(depth: Column, sums: list[Column]) -> dict[str, Column]:
    """Two hashes of a prefix."""
    return {"a": F.xxhash64(F.lit(1), depth, *sums[:2]), "b": F.xxhash64(F.lit(2), depth, *sums[2:])}


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, bytes, n): the node of each prefix of each conversation, the root included,
    and its parent. A prefix is known by four sums of 32-bit hashes of digest and depth."""
    parts = {}
    for k in range(2):
        whole = F.xxhash64(F.lit(k), "digest", "depth")
        parts |= {f"s{2 * k}": whole.bitwiseAND(F.lit(0xFFFFFFFF)), f"s{2 * k + 1}": F.shiftrightunsigned(whole, 32)}
    rows = turns.withColumn("depth", F.col("depth").cast("long")).withColumns({f"{n}_own": v for n, v in parts.items()})
    rows = rows.withColumn("chunk", F.expr(f"(depth - 1) div {CHUNK}"))
    rows = _running(rows, "chunk", [F.col("depth")], {n: F.col(f"{n}_own") for n in parts}).join(convs, "conv_id")
    own = _key(F.col("depth"), [F.col(n) for n in parts])
    above = _key(F.col("depth") - 1, [F.col(n) - F.col(f"{n}_own") for n in parts])
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = _key(zero, [zero] * 4)
    nodes = rows.select("conv_id", "depth", own["a"].alias("a"), own["b"].alias("b"), above["a"].alias("pa"),
                        above["b"].alias("pb"), "bytes", "n")
    return nodes.unionByName(convs.select("conv_id", zero.alias("depth"), root["a"].alias("a"), root["b"].alias("b"),
                                          none.alias("pa"), none.alias("pb"), zero.alias("bytes"), "n"))


def nodes_of(path: DataFrame) -> DataFrame:
    """NODE columns and ``weight``: the rows at and below the node of all conversations that pass it, which are
    at least as many as its subtree has nodes."""
    return path.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
        F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
        F.sum(F.col("n") - F.col("depth") + 1).alias("weight")).select(*NODE, "weight")


def sharded(path: DataFrame, nodes: DataFrame) -> tuple[DataFrame, int]:
    """(nodes with ``round`` and ``shard``, the number of rounds). The weight gives the round; weights fall
    along a path, so the shard's root is the first node of a path that has this round or an earlier one."""
    most = nodes.agg(F.max("weight")).first()[0] or 0
    limits = [SHARD_ROWS]
    while limits[-1] < most:
        limits.append(limits[-1] * FACTOR)
    place = sum((F.when(F.col("weight") > limit, 1).otherwise(0) for limit in limits[:-1]), F.lit(0)).cast("int")
    rows = nodes.withColumn("round", place).drop("weight")
    if len(limits) == 1:
        return rows.withColumn("shard", F.lit(0).cast("long")), 1
    heavy = settle(rows.filter("round > 0").select("a", "b", "round"), "heavy")
    if heavy.limit(HEAVY_BYTES // 24 + 1).count() <= HEAVY_BYTES // 24:
        heavy = F.broadcast(heavy)
    marked = path.select("conv_id", "depth", "a", "b").join(heavy, ["a", "b"], "left").withColumn("round", F.coalesce("round", F.lit(0)))
    roots = marked.groupBy("conv_id").agg(F.array(*[
        F.expr(f"min_by(a, depth) FILTER (WHERE round <= {k})") for k in range(len(limits))]).alias("roots"))
    # A node's first conversation passes it, so the roots on that path are the node's.
    return rows.join(roots, "conv_id").withColumn("shard", F.element_at("roots", F.col("round") + 1)).drop("roots"), len(limits)


class SpillingQueue:
    """A priority queue of equal-length tuples of integers: a heap of at most ``held`` of them and sorted
    runs in a file that the task owns and that vanishes with it."""

    def __init__(self, width: int, held: int | None = None) -> None:
        self.width, self.held = width, held or QUEUE_ROWS
        self.heap: list[tuple[int, ...]] = []
        self.runs: list[tuple[tuple[int, ...], int, Iterator[tuple[int, ...]]]] = []

    def push(self, entry: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.held:
            rows = self._run(np.array(sorted(self.heap), np.int64))
            heapq.heappush(self.runs, (next(rows), len(self.runs), rows))
            self.heap.clear()

    def _run(self, entries: np.ndarray) -> Iterator[tuple[int, ...]]:
        with tempfile.TemporaryFile() as file:
            file.write(entries.tobytes())
            del entries
            file.seek(0)
            while raw := file.read(8 * self.width * 4096):
                yield from map(tuple, np.frombuffer(raw, np.int64).reshape(-1, self.width).tolist())

    def least(self) -> tuple[int, ...] | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple[int, ...]:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            entry, k, rows = self.runs[0]
            following = next(rows, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, k, rows))
            return entry
        return heapq.heappop(self.heap)


def forwarded(rows: DataFrame) -> DataFrame:
    """NODE columns, ``root`` (the node is its shard's root) and TOTALS of subtrees. ``rows`` have ``shard`` and
    the sums that came from other shards."""
    names = [*NODE, "root", *TOTALS]
    given = [f"{t}_given" for t in TOTALS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard = SpillingQueue(5), None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("shard", "depth", "a", "b", "pa", "pb", "n_convs", "bytes", "root", *given)]
            found = []
            for own, depth, a, b, up_a, up_b, n, size, root, children, leaves, saved in zip(*columns):
                if own != shard:
                    if queue.least() is not None:
                        raise ValueError("totals were left without a parent in their shard")
                    shard = own
                while (entry := queue.least()) is not None and entry[:3] == (-depth, a, b):
                    queue.pop()
                    children, leaves, saved = children + 1, leaves + entry[3], saved + entry[4]
                leaves = leaves if children else 1
                saved += (n - 1) * size
                found.append((children, leaves, saved))
                if not root:
                    queue.push((1 - depth, up_a, up_b, leaves, saved))
            kept = [batch[c] for c in (*NODE, "root")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in zip(*found))] if found else
                                             [*kept, *[pa.array([], pa.int64())] * 3], names)

    dealt = rows.repartition("shard").sortWithinPartitions("shard", F.col("depth").desc(), "a", "b")
    fields = ", ".join(f"{c} boolean" if c == "root" else f"{c} long" for c in names)
    return dealt.select("shard", *NODE, "root", *given).mapInArrow(released(run), fields)


def totals(path: DataFrame, nodes: DataFrame) -> DataFrame:
    """NODE columns and TOTALS, round by round from the smallest shards to the one with the trie's root."""
    rows, rounds = sharded(path, nodes)
    rows, done = settle(rows, "sharded"), []
    for k in range(rounds):
        root = (F.col("depth") == 0) | (F.col("a") == F.col("shard"))
        some = rows.filter(F.col("round") == k).withColumn("root", root)
        sums = [F.coalesce(f"{t}_given", F.lit(0)).cast("long").alias(f"{t}_given") for t in TOTALS]
        if done:
            roots = done[0]
            for more in done[1:]:
                roots = roots.unionByName(more)
            came = (roots.filter("root AND depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b"))
                    .agg(F.count(F.lit(1)).alias("n_children_given"), F.sum("n_leaves").alias("n_leaves_given"),
                         F.sum("saved_tokens").alias("saved_tokens_given")))
            some = some.join(came, ["a", "b"], "left")
        else:
            some = some.withColumns({f"{t}_given": F.lit(0) for t in TOTALS})
        done.append(settle(forwarded(some.select("shard", *NODE, "root", *sums)), "totals"))
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.drop("root")


def ends(path: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): the digest of the ids of the conversations that end at a node. Ids are joined in
    runs of at most 2**IDS; a node's runs pass through one hash in order, one at a time."""
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    runs = (path.filter("depth = n").groupBy("a", "b", F.shiftright("conv_id", IDS).alias("run"))
            .agg(F.array_join(ids, ",").alias("ids")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, found = None, None, []
        for batch in batches:
            for a, b, text in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["ids"].to_pylist()):
                if (a, b) != key:
                    if key is not None:
                        found.append((*key, state.hexdigest()))
                    key, state = (a, b), sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if found:
                yield made(found)
                found = []
        if key is not None:
            yield made([(*key, state.hexdigest())])

    def made(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["a", "b", "ends_sha256"])

    dealt = runs.repartition("a", "b").sortWithinPartitions("a", "b", "run").select("a", "b", "ids")
    return dealt.mapInArrow(released(hashed), "a long, b long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Null roles and texts count as empty; turns that are repeated or equal in turn are all there, in order of
    their digests; a row without a conv_id belongs to no conversation. ``conv_id`` and ``depth`` name a node.
    Of a negative id the group's first is the next multiple of five below. An empty table gives no rows."""
    prepare(conversations.sparkSession)
    turns, convs = rebuilt(conversations)
    path = settle(paths(turns, convs), "paths")
    nodes = settle(nodes_of(path), "nodes")
    found = totals(path, nodes)
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(sha256(b"").hexdigest())
    return (found.join(above, ["pa", "pb"], "left").join(settle(ends(path), "ends"), ["a", "b"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", *TOTALS, F.coalesce("ends_sha256", none).alias("ends_sha256")))
