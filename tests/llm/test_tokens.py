import collections
import json
import re
import struct
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.cases import empty, frame, odd, odd_rows, real
from tidemark.llm import tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.vocabulary_path())


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 20, 31, 32])
def test_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 9001).astype("<u4")
    raw = tokens.pack_bits(ids, width)
    assert len(raw) == (len(ids) * width + 7) // 8
    assert (tokens.unpack_bits(raw, width, len(ids)) == ids).all()


def test_random_access_across_blocks(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 16)
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 50257, n).astype("<u4") for n in (1, 40, 16, 7, 1)]
    file = tokens.PackedFile(tokens.packed_file(parts, [3, 1, -5, 9, 9], 16, 77) + b"\n")
    whole = np.concatenate(parts)
    assert file.order == 77 and file.index["doc_id"].tolist() == [3, 1, -5, 9, 9]
    assert all((file.document(i) == p).all() for i, p in enumerate(parts))
    for low in range(0, len(whole), 5):
        for high in range(low, len(whole) + 1, 7):
            assert (file.ids(low, high) == whole[low:high]).all()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abc 'sdtT0129.,!\n\t\r\x0b\x1c\x85\xa0éß½²中😀ª<|endoftext|>"), max_size=60))
def test_words_encode_as_whole_texts(text):
    code = tokens.encoder(tokens.vocabulary_path())
    want = Tokenizer.from_file(tokens.vocabulary_path()) if not hasattr(code, "plain") else code.plain
    code.plain = want
    for body in (text, text.replace("é", "e").replace("<", "").replace("中", " "), f"x <|endoftext|>{text}"):
        assert code.encode(body).tolist() == want.encode(body, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("a lsrevtmd'' 09.\n\t\x0b\x00\x1béſ"), max_size=30), min_size=1, max_size=4))
def test_words_of_plain_texts_are_cut_as_by_the_rule(texts):
    letter = tokens._LETTER
    rule = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[0-9]+| ?[^\s{letter}0-9]+|\s+(?!\S)|\s+")
    raw = b"".join(t.encode() + b"\xff" for t in texts)
    starts = tokens.word_starts(np.frombuffer(raw, np.uint8)).tolist()
    words = [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)])]
    assert words == [w for t in texts for w in [*map(str.encode, rule.findall(t)), b"\xff"]]


class Counting:
    """A tokenizer that counts the words it is given in batches."""

    def __init__(self, inner):
        self.__dict__ |= {"inner": inner, "seen": collections.Counter(), "most": 0}

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def __setattr__(self, name, value):
        setattr(self.inner, name, value)

    def encode_batch_fast(self, texts, **more):
        self.seen.update(" ".join(texts).split())
        self.__dict__["most"] = max(self.most, sum(map(len, texts)))
        return self.inner.encode_batch_fast(texts, **more)


def test_words_met_again_stay_known_and_batches_are_small(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_BYTES", 400 * tokens.ENTRY_BYTES)
    monkeypatch.setattr(tokens, "RUN_CHARS", 1)
    code = tokens.Encoder(tokens.vocabulary_path())
    code.tokenizer = Counting(code.tokenizer)
    often = "".join(f" often{chr(97 + i)}" for i in range(20))
    texts = [often + "".join(f" r{chr(97 + i)}{chr(97 + k % 26)}{'x' * (k // 26)}y" for i in range(26)) for k in range(80)]
    texts.append("".join(f" {a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd" * 4))
    for text, got in zip(texts, code.encode_all(texts)):
        assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert code.tokenizer.seen["oftena"] == 1 and code.tokenizer.seen["raay"] == 1
    assert len(code.known) + len(code.older) < 2000 and code.tokenizer.most < 16 * tokens.JOINED_WORDS * 10
    assert code.encode("it's it 's 中 <|endoftext|>").tolist() == tokenizer.encode("it's it 's 中 <|endoftext|>", add_special_tokens=False).ids


def test_no_step_is_taken_for_each_word(tokenizer):
    words = [f"{a}{b}{c}{d}" for a in "bcdfghjkln" for b in "aeiou" for c in "bcdfghjkln" for d in ["", *"aeioubcdfghjklmnpqr"]]
    text, code, calls = " ".join(words), tokens.Encoder(tokens.vocabulary_path()), collections.Counter()
    sys.setprofile(lambda _, event, __: calls.update([event]))
    try:
        got = code.encode(text)
    finally:
        sys.setprofile(None)
    assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(set(words)) == 10_000 and calls["call"] + calls["c_call"] < len(words)


@pytest.mark.parametrize("ignore", [False, True])
def test_merges_over_a_space_do_not_join_words(tokenizer, tmp_path, ignore):
    kept = json.loads(tokenizer.to_str())
    vocab = kept["model"]["vocab"]
    for new in ("dĠ", "Ġwhat-is-this"):
        vocab[new] = max(vocab.values()) + 1
    kept["model"] |= {"merges": [["d", "Ġ"], *kept["model"]["merges"]], "ignore_merges": ignore}
    (path := tmp_path / "over.json").write_text(json.dumps(kept))
    text = "and and  red food, bad. what what-is-this what's and\nend 12d d d 'd" + "".join(f" x{i}d" for i in range(300))
    want = Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
    assert tokens.Encoder(str(path)).encode(text).tolist() == want


def test_runs_of_empty_texts_end():
    code, taken = tokens.Encoder(tokens.vocabulary_path()), []
    found = code.encode_all(taken.append(i) or "" for i in range(1 << 20))
    assert len(next(found)) == 0 and len(taken) <= tokens.RUN_CHARS // tokens.TEXT_CHARS


def _expected(rows, tokenizer, end):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start, out = 0, []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_packed_documents(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "PARTITION_BYTES", 100_000)
    rows = [(r.doc_id, r.text) for r in real(spark).collect()]
    got = sorted(map(tuple, tokens.packed(real(spark).repartition(3)).collect()))
    assert got == sorted(_expected(rows, tokenizer, 2))


def test_documents_of_a_run_come_in_several_batches(spark, tokenizer):
    rows = [(r.doc_id, r.text) for r in real(spark).limit(100).collect()]
    rows += [(10**6 + i, t) for i, t in enumerate([None, "", "x \u4e2d", "a\nb " * 300_000, "y" * 10, None, "\u4e2d", "end"])]
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in rows]).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted(map(tuple, tokens.packed(docs).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(_expected(rows, tokenizer, 2))


def test_odd_rows(spark, tokenizer):
    rows = [r for r in odd_rows() if r[0] is not None and list(x[0] for x in odd_rows()).count(r[0]) == 1]
    got = {r.doc_id: tuple(r)[2:] for r in tokens.packed(odd(spark)).collect()}
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert got[doc_id] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    every = sorted((r.start, r.n_tokens) for r in tokens.packed(odd(spark)).collect())
    assert len(every) == len(odd_rows()) and [r.start for r in tokens.packed(odd(spark)).filter("doc_id IS NULL").collect()].count(0) == 1
    assert all(a + n == b for (a, n), (b, _) in zip(every, every[1:]))
    assert tokens.packed(empty(spark)).count() == 0 and tokens.counted_tokens(empty(spark)).count() == 0


def test_separators_of_written_files(spark, tokenizer):
    rows = [(r.doc_id, r.text) for r in real(spark).collect()] + [(10**6, "a <|endoftext|> b"), (10**6 + 1, None)]
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in rows]).coalesce(1)
    tokenizer.encode_special_tokens = True
    want = _expected(rows, tokenizer, tokens.FLAT_END)
    tokenizer.encode_special_tokens = False
    got = sorted(map(tuple, tokens.counted_tokens(docs).collect()))
    assert got == [(i, start, n) for i, (_, start, n, _) in enumerate(want)]
    spread = sorted(map(tuple, tokens.counted_tokens(docs.repartition(5)).collect()))
    assert [r[0] for r in spread] == list(range(len(want))) and sorted(r[2] for r in spread) == sorted(w[2] for w in want)
    assert all(start + n == after for (_, start, n), (_, after, _) in zip(spread, spread[1:]))


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_separators_across_blocks_and_files(spark, block):
    rng = np.random.default_rng(block)
    files = [rng.integers(0, 4, n).astype("<u2") for n in (30, 1, 0, 17, 5)] + [np.array([1, 2, 3], "<u2")]
    rows = [(bytearray(x.tobytes() + struct.pack("<Q", i) + b"\n"),) for i, x in enumerate(files)]
    got = sorted(map(tuple, tokens.scan_separators(spark.createDataFrame(rows, "content binary"), 0, block=block).collect()))
    want, start = [], 0
    stream = np.concatenate(files).tolist()
    for i, x in enumerate(stream):
        if x == 0:
            want.append((len(want), start, i + 1 - start))
            start = i + 1
    if start < len(stream):
        want.append((len(want), start, len(stream) - start))
    assert got == want


def test_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(tokens, "FILE_IDS", 5000)
    path = tokens.run_folder(spark, "bounded")
    tokens.write_tokens(real(spark), path, tokens.vocabulary_path(), 2)
    sizes = [len(r.content) for r in tokens.token_files(spark, path).collect()]
    longest = tokens.packed(real(spark)).agg(F.max("n_tokens")).first()[0]
    assert len(sizes) > 5 and max(sizes) < 2 * (5000 + longest) + 20_000
