"""Near-duplicate documents by a chosen-path set similarity join over minhash signatures.

Equal shingle sets fall together first. In each of several independent trees the remaining documents
branch by the value of a chosen minhash coordinate; nodes that stay large branch again, by two
coordinates drawn from the node's path, level by level as Spark jobs; nodes with few documents are
compared exhaustively on signatures, whose agreement estimates similarity. What lies clearly below
the threshold is left behind; the rest forms clusters, within which links are confirmed on full
shingle sets. Only links that join two parts are kept, as components need no others: a group of
thousands of copies gives a forest, not all its pairs.

A large node first compares all its documents with one of them, the pivot. What agrees is linked with it
and goes on only as a partner of documents that did not ("open" ones); a node without open documents
ends. So a hot group of near copies ends at its first node, in rows in proportion to its size. Large
clusters are confirmed alike: along the links found first, and only what these leave apart from the
cluster's largest part is compared with all of it, in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import packed_rows, prepare, released, settle, unpacked

SHINGLE = 5  # words
PERCENT = 85  # least similarity of a link
COORDINATES = 128  # of a signature
# A pair at the threshold agrees in 109 coordinates on average, with a deviation of 4; under 87 come
# two in a million such pairs.
AGREE = 87
TREES = 10  # a pair at the threshold shares a first node with 0.85 each: 6 in 1e9 pairs share none
BRANCHES = 2  # coordinates by which a node branches; on average 1.7 children keep such a pair together
NODE = 2048  # documents that are compared exhaustively
BLOCK = 1024  # documents of a block of a larger group
DEPTH = 6  # levels below the first; larger nodes then are compared in blocks, all against all
SET_LIMIT = 1_000_000  # shingles compared in one task
CHUNK = 1 << 20  # text bytes hashed at once
BROADCAST_ROWS = 200_000  # of 20 bytes: more clustered documents than these are joined with the texts by a shuffle
BROADCAST_BYTES = 16 << 20  # of the sets that the documents of large clusters are compared with first, and of pivots' signatures
LAST_EDGES = 10_000  # as few, left over by contraction, are joined at once and not round by round
ROUNDS = 4  # likely links of a document of a large cluster that are tried before blocks

_RANDOM = np.random.default_rng(20240607)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_FACTORS = _RANDOM.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that every digit of the result depends on all of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; empty for a text without words.

    Words are hashed by differences of a running polynomial over all bytes of the list at once."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)  # behind the space that follows a text
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    low, high = edge[::2], edge[1::2]
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * _powers(_BASE, len(raw)), dtype=np.uint64)])
    word = mixed((running[high] - running[low]) * _powers(_INVERSE, len(raw) + 1)[low] + (high - low).astype(np.uint64))
    first = np.searchsorted(low, np.concatenate([[0], ends[:-1]]))
    last = np.searchsorted(low, ends)
    size = max(len(word) - SHINGLE + 1, 0)
    whole = np.full(size, SHINGLE, np.uint64)
    for k in range(SHINGLE):
        whole = mixed(whole * _BASE + word[k:k + size])
    sets = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= SHINGLE:
            sets.append(np.unique(whole[a:b - SHINGLE + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for k in range(a, b):
                short = mixed(short * _BASE + word[k:k + 1])
            sets.append(short)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each of COORDINATES hash functions over the set."""
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 1024):
        part = (shingles[i:i + 1024, None] * _FACTORS) >> np.uint64(32)
        least = np.minimum(least, part.min(axis=0).astype(np.uint32))
    return least


def _in_chunks(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first text, sets) for runs of texts of about CHUNK bytes."""
    start, held = 0, 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        held += size
        if held >= CHUNK or i + 1 == len(texts):
            yield start, shingle_sets(texts.slice(start, i + 1 - start).to_pylist())
            start, held = i + 1, 0


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, signature); digest and signature are null for an empty set."""
    names = ["doc_id", "text_hash", "n_shingles", "digest", "signature"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch["doc_id"], batch["text_hash"]
            for start, sets in _in_chunks(batch["text"]):
                yield pa.RecordBatch.from_arrays([
                    ids.slice(start, len(sets)), hashes.slice(start, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())], names)

    return _texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        released(sign), "doc_id long, text_hash long, n_shingles long, digest binary, signature binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def first_nodes(documents: DataFrame, trees: int = TREES) -> DataFrame:
    """(node, v) of the first level: a document's value at one coordinate per tree."""
    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _matrix(batch["signature"])[:, :trees].astype(np.uint64)
                node = mixed(mixed(np.arange(1, trees + 1, dtype=np.uint64)) + found)
                v = np.repeat(batch["v"].to_numpy(), trees)
                yield pa.RecordBatch.from_arrays([pa.array(node.ravel().view(np.int64)), pa.array(v)], ["node", "v"])

    return documents.select("v", "signature").mapInArrow(released(branch), "node long, v long")


def next_nodes(rows: DataFrame) -> DataFrame:
    """(kind, a, b, open): links ("link", v, pivot) of documents that agree with their node's pivot, and
    memberships ("node", node, v) one level down, where each node draws BRANCHES coordinates by its own path.
    The pivot has met the whole node and goes no further."""
    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path, v, pivot = (batch[c].to_numpy() for c in ("node", "v", "pivot"))
            path, found, open_ = path.view(np.uint64), _matrix(batch["signature"]), batch["open"].to_numpy(zero_copy_only=False)
            agrees = (found == _matrix(batch["pivot_signature"])).sum(axis=1) >= AGREE
            linked, on = agrees & (v != pivot), v != pivot
            yield _rows("link", v[linked], pivot[linked], open_[linked])
            for k in range(1, BRANCHES + 1):
                chosen = mixed(path + np.uint64(k * int(_BASE) % (1 << 64)))
                value = found[np.arange(len(v)), (chosen % np.uint64(COORDINATES)).astype(np.int64)]
                yield _rows("node", mixed(chosen + value).view(np.int64)[on], v[on], (open_ & ~agrees)[on])

    return rows.select("node", "v", "open", "pivot", "signature", "pivot_signature").mapInArrow(
        released(branch), "kind string, a long, b long, open boolean")


def _rows(kind: str, a: np.ndarray, b: np.ndarray, open_: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(open_)],
                                      ["kind", "a", "b", "open"])


def leaves(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, part, other, v), (a, b)): nodes of all trees that are compared exhaustively, and the links of
    pivots.

    Nodes of one document and such without an open one are dropped. A node above NODE documents after all
    levels is cut into blocks, and (part, other) names a pair of blocks with an open document."""
    found, links = [], []
    signed = documents.select("v", "signature")
    rows = first_nodes(documents).withColumn("open", F.lit(True))
    for level in range(DEPTH + 1):
        rows = settle(rows, "nodes")
        some = F.col("open").cast("long")
        pivot = F.min_by("v", F.when(F.col("open"), F.xxhash64("v", "node")))
        sizes = (rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum(some).alias("n_open"), pivot.alias("pivot"))
                 .filter("size > 1 AND n_open > 0"))
        kept = settle(rows.join(sizes, "node"), "sized")
        found.append(kept.filter(F.col("size") <= NODE).select("node", F.lit(0).alias("part"), F.lit(0).alias("other"), "v"))
        large = kept.filter(F.col("size") > NODE)
        if large.isEmpty():
            break
        if level == DEPTH:
            found.append(block_pairs(large, "node", "v", F.ceil(F.col("n_open") / BLOCK),
                                     F.ceil((F.col("size") - F.col("n_open")) / BLOCK)).select("node", "part", "other", "v"))
        else:
            pivots = settle(large.select("node", "pivot").distinct().join(
                signed.withColumnsRenamed({"v": "pivot", "signature": "pivot_signature"}), "pivot").drop("pivot"), "pivots")
            if pivots.count() * 4 * COORDINATES <= BROADCAST_BYTES:
                pivots = F.broadcast(pivots)  # then the rows of a hot node stay where they are
            below = settle(next_nodes(large.join(signed, "v").join(pivots, "node")), "below")
            links.append(below.filter("kind = 'link'").select("a", "b"))
            rows = below.filter("kind = 'node'").select(F.col("a").alias("node"), F.col("b").alias("v"), "open")
    result, linked = found[0], documents.filter("false").select(F.col("v").alias("a"), F.col("v").alias("b"))
    for more in found[1:]:
        result = result.unionByName(more)
    for more in links:
        linked = linked.unionByName(more)
    return result, linked


def block_pairs(rows: DataFrame, group: str, member: str, n_open: Column, n_closed: Column) -> DataFrame:
    """Adds (part, other): each pair of blocks of a group that has an open block. A member's block is drawn by a
    hash among the ``n_open`` blocks of open members or the ``n_closed`` others behind them."""
    drawn = F.xxhash64(member, F.lit(11))
    rows = rows.withColumn("_opens", n_open.cast("int")).withColumn("_all", n_open.cast("int") + n_closed.cast("int"))
    own = F.when(F.col("open"), F.pmod(drawn, F.col("_opens"))).otherwise(
        F.col("_opens") + F.pmod(drawn, F.col("_all") - F.col("_opens"))).cast("int")
    with_ = F.sequence(F.lit(0), F.when(F.col("open"), F.col("_all")).otherwise(F.col("_opens")) - 1)
    return (rows.withColumn("_own", own).withColumn("_with", F.explode(with_))
            .withColumn("part", F.least("_own", "_with")).withColumn("other", F.greatest("_own", "_with"))
            .drop("_own", "_with", "_opens", "_all"))


def agreement(found: np.ndarray) -> np.ndarray:
    """The number of equal coordinates of each pair of signatures."""
    out = np.empty((len(found), len(found)), np.uint8)
    step = max(1, 4_000_000 // (len(found) * COORDINATES))
    for i in range(0, len(found), step):
        out[i:i + step] = (found[i:i + step, None, :] == found[None, :, :]).sum(axis=2, dtype=np.uint8)
    return out


def _labels(near: np.ndarray) -> np.ndarray:
    """The component of each row of a symmetric boolean matrix, named by its first row."""
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(axis=1)
        new = np.minimum(new, label)[new.clip(max=len(near) - 1)]
        if (new == label).all():
            return label
        label = new


def by_group(rows: DataFrame, keys: list[str], handle: Callable[[list[dict]], list[tuple[int, int]]],
             out: str = "a long, b long") -> DataFrame:
    """``handle`` gets the rows of each group, whose size the caller has bounded, one group at a time."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        made: list[tuple[int, int]] = []

        def done() -> None:
            if sum(b.num_rows for b in held) > 1:
                made.extend(handle(pa.Table.from_batches(held)))
            held.clear()

        for batch in batches:
            columns = [batch[k].to_numpy() for k in keys]
            changed = np.zeros(batch.num_rows, bool)
            changed[:1] = True
            for c in columns:
                changed[1:] |= c[1:] != c[:-1]
            cuts = np.flatnonzero(changed).tolist() + [batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(c[a] for c in columns)
                if key != now:
                    done()
                    now = key
                held.append(batch.slice(a, b - a))
            if made:
                yield _pairs(made)
                made.clear()
        done()
        if made:
            yield _pairs(made)

    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*names).mapInArrow(released(run), out)


def _pairs(made: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], ["a", "b"])


def likely_links(documents: DataFrame) -> DataFrame:
    """(a, b): a forest per node over the pairs whose signatures agree well enough, and the pivots' links."""
    def compare(table: pa.Table) -> list[tuple[int, int]]:
        v = table["v"].to_numpy()
        label = _labels(agreement(_matrix(table["signature"])) >= AGREE)
        return [(int(v[i]), int(v[l])) for i, l in enumerate(label) if i != l and v[i] != v[l]]

    nodes, linked = leaves(documents)
    rows = nodes.join(documents.select("v", "signature"), "v")
    return by_group(rows.select("node", "part", "other", "v", "signature"), ["node", "part", "other"], compare).unionByName(linked)


def _joins(v: np.ndarray, found: list[np.ndarray], part: np.ndarray) -> list[tuple[int, int]]:
    """Links of full sets that join two of the parts ``part`` names. Pairs are tried in descending order of
    agreement, and only while they would join two parts."""
    agree = agreement(np.stack([signature(s) for s in found]))
    size, part, links = np.array([len(s) for s in found]), part.copy(), []
    i, j = np.nonzero(np.triu(agree >= AGREE, 1))
    fits = (part[i] != part[j]) & (100 * np.minimum(size[i], size[j]) >= PERCENT * np.maximum(size[i], size[j]))
    i, j = i[fits], j[fits]
    order = np.argsort(-agree[i, j].astype(np.int16), kind="stable")
    for low in range(0, len(order), 4096):
        some = order[low:low + 4096]
        some = some[part[i[some]] != part[j[some]]]
        for a, b in zip(i[some].tolist(), j[some].tolist()):
            if part[a] != part[b] and similar(found[a], found[b]):
                links.append((int(v[a]), int(v[b])))
                part[part == part[b]] = part[a]
    return links


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _sets(rows: DataFrame) -> DataFrame:
    """``shingles`` (bytes of the sorted hashes) in place of ``text``."""
    names = [c for c in rows.columns if c != "text"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select(names)
            for start, found in _in_chunks(batch["text"]):
                yield pa.RecordBatch.from_arrays([*rest.slice(start, len(found)).columns, pa.array(
                    [s.tobytes() for s in found], pa.binary())], [*names, "shingles"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(released(sets), f"{fields}, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are linked. The sets of ``b``, which many share, are sent around
    if they are small, else joined by a shuffle, whose skewed partitions AQE splits. A few pairs are sent around
    too, and the sets of ``a`` stay where they are."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(
                batch["x"].to_pylist(), batch["y"].to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    own = sets.select(F.col("v").alias("a"), F.col("shingles").alias("x"))
    pairs = settle(pairs, "pairs")
    shared = pairs.select("b").distinct().join(sets.select(F.col("v").alias("b"), F.col("shingles").alias("y")), "b")
    shared = settle(shared, "pivots")
    if (shared.agg(F.sum(F.octet_length("y"))).first()[0] or 0) <= BROADCAST_BYTES:
        shared = F.broadcast(shared)
    if pairs.count() <= BROADCAST_ROWS:
        pairs = F.broadcast(pairs)
    return settle(own.join(pairs, "a").join(shared, "b").select("a", "b", "x", "y").mapInArrow(released(check), "a long, b long"), "verified")


def confirmed_links(docs: DataFrame, clusters: DataFrame, likely: DataFrame) -> DataFrame:
    """(a, b): links of full shingle sets that join all parts of each cluster that are linked.

    Small clusters are compared by themselves. In large ones each document first tries up to ROUNDS of its
    likely links; what stays outside the largest part found so is open and is compared in blocks with the
    whole cluster."""
    def confirm(table: pa.Table) -> list[tuple[int, int]]:
        return _joins(table["v"].to_numpy(), [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()],
                      np.unique(table["g"].to_numpy(), return_inverse=True)[1])

    weight = clusters.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"))
    large = (F.col("n") > SET_LIMIT) | (F.col("m") > BLOCK)
    members = settle(clusters.select("v", "c", "n").join(weight.select("c", large.alias("large")), "c"), "members")
    near = members.select("v", "c", "large")
    if members.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        near = F.broadcast(near)  # then the texts of all others stay where they are
    held = _sets(_texts(docs).join(near, F.col("doc_id") == F.col("v")).select("v", "c", "large", "text"))
    if members.filter("large").isEmpty():
        return by_group(held.select("c", "v", F.col("v").alias("g"), "shingles"), ["c"], confirm)
    held = settle(held, "held")
    links = by_group(held.filter("NOT large").select("c", "v", F.col("v").alias("g"), "shingles"), ["c"], confirm)

    wide = members.filter("large").select("v", "c", "n")
    sets = settle(held.filter("large").select("v", "shingles").dropDuplicates(["v"]), "large-sets")
    ranked = Window.partitionBy("a").orderBy(F.xxhash64("b"), "b")
    tries = settle(likely.distinct().join(wide.select(F.col("v").alias("a")), "a")
                   .withColumn("nth", F.row_number().over(ranked)).filter(F.col("nth") <= ROUNDS), "tries")
    joined = None
    for k in range(1, ROUNDS + 1):
        some = tries.filter(F.col("nth") == k).select("a", "b")
        if joined is not None:
            some = some.join(joined.select("a"), "a", "left_anti")
        good = verified(some, sets)
        joined = good if joined is None else joined.unionByName(good)
    parts = components(joined)
    placed = wide.join(parts.select("v", F.col("c").alias("g")), "v", "left").withColumn("g", F.coalesce("g", "v"))
    most = (placed.groupBy("c", "g").agg(F.count(F.lit(1)).alias("k")).groupBy("c")
            .agg(F.max_by("g", F.struct("k", "g")).alias("most")))
    placed = settle(placed.join(most, "c").withColumn("open", F.col("g") != F.col("most")), "placed")

    def blocks(of: Column) -> Column:
        return F.greatest(F.ceil(F.sum(F.when(of, F.col("n"))) / SET_LIMIT), F.ceil(F.count(F.when(of, 1)) / BLOCK))

    counts = placed.groupBy("c").agg(blocks(F.col("open")).alias("opens"), blocks(~F.col("open")).alias("rest")).filter("opens > 0")
    pairs = block_pairs(placed.join(counts, "c"), "c", "v", F.col("opens"), F.col("rest"))
    rows = pairs.select("v", "c", "g", "part", "other").join(sets, "v").select("c", "part", "other", "v", "g", "shingles")
    return links.unionByName(joined).unionByName(by_group(rows, ["c", "part", "other"], confirm))


def joined_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, p): the least vertex ``p`` of the component of each vertex ``v`` of the (a, b) of one task."""
    least: dict[int, int] = {}

    def top(x: int) -> int:
        while least[x] != x:
            least[x] = x = least[least[x]]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            least.setdefault(a, a)
            least.setdefault(b, b)
            x, y = top(a), top(b)
            least[max(x, y)] = min(x, y)
    if least:
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int64()), pa.array([top(v) for v in list(least)], pa.int64())], ["v", "p"])


def components(edges: DataFrame) -> DataFrame:
    """(v, c): ``c`` is the least vertex reachable from ``v``, for all vertices of (a, b).

    Rounds of contraction: each vertex moves to the least of its neighbours and itself, by number in
    even rounds and by a hash in odd ones (numbers fold stars at once, hashes fold long paths). Every
    round is written as a table; at last the moves are put one behind the other. The last LAST_EDGES edges,
    which would take most rounds for the fewest rows, are one move."""
    moves, k = [], 0
    edges = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .filter("a <> b").distinct(), "edges")
    if edges.isEmpty():
        return edges.selectExpr("a AS v", "b AS c")
    while left := edges.count():
        if left <= LAST_EDGES:
            moves.append(settle(edges.coalesce(1).mapInArrow(released(joined_at_once), "v long, p long"), "moves"))
            break
        rank = (lambda x, k=k: F.col(x)) if k % 2 == 0 else (lambda x, k=k: F.xxhash64(x, F.lit(k)))
        near = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        best = near.groupBy("a").agg(F.min_by("b", rank("b")).alias("p"))
        move = settle(best.select(F.col("a").alias("v"), F.when(rank("p") < rank("a"), F.col("p"))
                                  .otherwise(F.col("a")).alias("p")), "moves")
        edges = settle(edges.join(move.selectExpr("v AS a", "p AS pa"), "a").join(move.selectExpr("v AS b", "p AS pb"), "b")
                       .filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
                       .distinct(), "edges")
        moves.append(move)
        k += 1
    label = moves[-1]
    for move in reversed(moves[:-1]):
        label = (move.join(label.selectExpr("v AS p", "p AS q"), "p", "left")
                 .select("v", F.coalesce("q", "p").alias("p")))
    label = settle(label, "labels")
    return label.join(label.groupBy("p").agg(F.min("v").alias("c")), "p").select("v", "c")


def judged(docs: DataFrame) -> DataFrame:
    """What ``duplicates`` returns, and ``text_hash``."""
    prepare(docs.sparkSession)
    signed = settle(signatures(docs), "signatures")
    groups = settle(signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("v"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")), "sets")
    # A doc_id with several texts joins their sets: each set's least document links with the others'.
    several = (signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "digest").distinct()
               .groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("doc_id"))
    same_id = (signed.join(several, "doc_id").select("doc_id", "digest").distinct().join(groups.select("digest", "v"), "digest")
               .select(F.col("doc_id").alias("a"), F.col("v").alias("b")))
    likely = settle(likely_links(groups), "likely")
    clusters = components(likely).join(groups.select("v", "n"), "v")
    links = confirmed_links(docs, settle(clusters, "clusters"), likely).unionByName(same_id)
    reached = components(links)
    own = (signed.select("doc_id", "text_hash", "n_shingles", "digest").join(groups.select("digest", "v"), "digest", "left")
           .join(reached, "v", "left"))
    component = F.coalesce("c", "v", "doc_id")
    return own.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Sets are the distinct 5-word shingles of the text with A-Z in lower case, compared by 64-bit hashes;
    a text of fewer words is one shingle, a null or wordless one has none and links with nothing. Links
    have 100 * intersection >= 85 * union. ``component_id`` is the least doc_id reachable, ``kept`` says
    that it is the row's own. Rows that share a doc_id are one vertex and share a component. A row with a
    null doc_id is no vertex: it takes the component of the equal sets, none if there are none, and is kept
    then. An empty table gives no rows."""
    return judged(docs).drop("text_hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns.

    Rows are named by doc_id and text: unlike texts of a kept doc_id all stay, of equal ones the first by a
    hash of the row. A row with a null doc_id stays if no document has its set of shingles, again once per
    text; null and wordless texts link with nothing. An empty table gives no rows."""
    kept = judged(docs).filter("kept").select("doc_id", "text_hash").distinct()
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = packed_rows(docs, doc_id=F.col("doc_id").cast("long"), text_hash=F.xxhash64(text))
    named = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.xxhash64("row")))
    return unpacked(named.withColumn("nth", first).filter("nth = 1"))
