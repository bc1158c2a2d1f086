import hashlib
import random
import re

import pytest

from tests.llm.cases import empty, frame, odd, odd_rows, prose, real
from tidemark.llm import fill_middle

MARKS = ("<P>", "<S>", "<M>")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_way(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted(x % (len(lines) + 1) for x in h[:2])
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 100:
        return doc_id, len(lines), "plain", None, None, sha(text), sha(text)
    prefix, middle, suffix = ("".join(p) for p in (lines[:low], lines[low:high], lines[high:]))
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(lines), form, len(prefix), len(middle), sha(out), sha(text)


def texts():
    rng = random.Random(4)
    parts = ["\n", "\n\n", "é", "<", ">", "<P", "S>", "<M", "𝔘", "word ", "\r", "<<S", "P>", "\0"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    rows += ["<P>", "a<S>b", "<M>\n", "\n", "a", "a\nb", "a\nb\n", "<", "P>", ">\n<", "<", "S><P>", "<", "P><M>x", None, "", "中\n文\n" * 3000, prose(rng, 9)]
    return [(i, t, "en", "a", 0) for i, t in enumerate(rows)]


@pytest.mark.parametrize("chunk, block", [(1 << 22, 1 << 20), (64, 16), (1, 7)])
def test_equals_plain_strings(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(fill_middle, "CHUNK", chunk)
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    rows = texts() if chunk > 64 else texts()[:150]
    got = local(rows)
    assert got == [plain_way(r[0], r[1]) for r in rows]
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def local(rows):
    """The functions of a task over one batch, without Spark, so that block sizes can be set."""
    import numpy as np
    import pyarrow as pa
    column, out = pa.array([(r[1] or "").encode() for r in rows], pa.binary()), []
    for first, raw, base in fill_middle._bytes_of(column):
        ids = [r[0] for r in rows[first:first + len(base) - 1]]
        drawn = np.array([fill_middle.draws(i) for i in ids], np.int64)
        lines, form, ends = fill_middle.cut(raw, base, drawn)
        made, offsets = fill_middle.scattered(raw, base, form, ends)
        back, again = fill_middle.gathered(made, offsets, form)
        for k, i in enumerate(ids):
            name = fill_middle.FORMS[form[k]]
            part = lambda a, b: None if name == "plain" else len(bytes(raw[a:b]).decode())
            out.append((i, int(lines[k]), name, part(base[k], ends[k, 0]), part(ends[k, 0], ends[k, 1]),
                        hashlib.sha256(made[offsets[k]:offsets[k + 1]]).hexdigest(),
                        hashlib.sha256(back[again[k]:again[k + 1]]).hexdigest()))
    return out


def test_query_on_odd_and_given_rows(spark):
    for docs, rows in ((frame(spark, texts()), texts()), (odd(spark), odd_rows()), (real(spark), real(spark).collect())):
        got = sorted(map(tuple, fill_middle.report(docs).collect()), key=str)
        assert got == sorted([plain_way(r[0], r[1]) for r in rows], key=str)
    assert fill_middle.report(empty(spark)).count() == 0


def test_shares_and_restoring_beside_other_columns(spark):
    rows = [(i, f"line {i}\nnext\nlast", "en", "a", 0) for i in range(400)]
    made = fill_middle.transform(frame(spark, rows), rate=50, spm=0, seed=1)
    found = fill_middle.restore(made.withColumnRenamed("n", "restored_lines")).collect()
    forms = [r.form for r in found]
    assert 120 < forms.count("plain") < 280 and "spm" not in forms
    assert {r.doc_id: r.restored for r in found} == {r[0]: r[1] for r in rows}
    assert all(r.output == r.restored if r.form == "plain" else r.output.startswith("<P>") for r in found)
