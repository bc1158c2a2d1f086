import collections
import hashlib
import random
import zlib

import duckdb
import pytest

from tests.llm.cases import DATA
from tidemark.llm import oracle, prefix_trie
from tools.compare import rows_of

CONV_SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def odd_turns():
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é\n", "1:x"]))
            for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(70, None, "user", "x"), (70, None, "user", "x"), (70, None, None, None), (70, 0, "user", "x"), (71, 3, "a", "b"), (71, 3, "ab", "")]
    rows += [(None, 0, "user", "x"), (None, None, None, None), (-3, 0, "user", "neg"), (500, 1, "user", "word " * 20000)]
    # A long conversation, another that follows it and leaves, and many equal ones.
    rows += [(100, t, "user", f"t{t % 3}") for t in range(40)] + [(103, t, "user", f"t{t % 3}" if t < 30 else "z") for t in range(40)]
    return rows + [(c, t, "user", "same") for c in range(200, 260) for t in range(3)]


def key(row):
    role, text = row[2] or "", row[3] or ""
    return row[1] is not None, row[1] or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = collections.defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=key):
        own[row[0]].append((row[2] or "", row[3] or ""))
    members, end = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        turns = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        end[turns].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = (len(members[node]) - 1) * len(node[-1][1].encode() if node else b"") + sum(saved[x] for x in below)
        digest = hashlib.sha256(",".join(map(str, end[node])).encode()).hexdigest()
        out.append((members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(below),
                    leaves[node], saved[node], digest))
    return sorted(out, key=str)


def result(spark, rows):
    got = prefix_trie.trie(spark.createDataFrame(rows, CONV_SCHEMA))
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("rows, factor, chunk", [(1 << 16, 64, 1024), (16, 2, 4), (1, 3, 1)])
def test_equals_brute_force(spark, monkeypatch, rows, factor, chunk):
    for name, value in (("SHARD_ROWS", rows), ("FACTOR", factor), ("CHUNK", chunk), ("IDS", 3 if chunk < 9 else 12)):
        monkeypatch.setattr(prefix_trie, name, value)
    want = brute(odd_turns())
    assert result(spark, odd_turns()) == want and max(w[1] for w in want) >= 38


def test_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", 20)
    monkeypatch.setattr(prefix_trie, "HEAVY_BYTES", 0)
    assert result(spark, odd_turns()) == brute(odd_turns())


def test_given_and_empty(spark):
    given = spark.read.parquet(f"{DATA}/conversations.parquet")
    got = sorted(map(tuple, prefix_trie.trie(given).collect()), key=str)
    assert got == brute([(r.conv_id, r.turn, r.role, r.text) for r in given.collect()])
    assert result(spark, []) == []


@pytest.mark.parametrize("held", [1, 7, 1000])
def test_queue_spills_in_order(held):
    rng = random.Random(held)
    queue, kept, out = prefix_trie.SpillingQueue(3, held), [], []
    for _ in range(3000):
        if kept and rng.random() < 0.4:
            assert queue.least() == min(kept)
            out.append(queue.pop())
            kept.remove(out[-1])
        else:
            kept.append((rng.randint(-9, 9), rng.randint(-(1 << 63), (1 << 63) - 1), rng.randint(0, 5)))
            queue.push(kept[-1])
    while queue.least() is not None:
        out.append(queue.pop())
    assert sorted(kept) == out[len(out) - len(kept):] and (held == 1000 or len(queue.runs) == 0)


@pytest.mark.parametrize("rows", [odd_turns(), []], ids=["odd", "empty"])
def test_sql_equals_query(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    rows = [r for r in rows if r[0] is None or r[0] >= 0]  # the remainder of a negative number differs there
    for row in rows:
        con.execute("INSERT INTO conversations VALUES (?, ?, ?, ?)", list(row))
    want = con.execute(oracle.TRIE)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(COLUMNS)
    assert rows_of(COLUMNS, result(spark, rows)) == rows_of(columns, want.fetchall())
