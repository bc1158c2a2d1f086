import random

from tests.llm.cases import empty, frame, odd, odd_rows, prose, real
from tidemark.llm import line_dedup
from tidemark.llm.workload import QUERIES


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(rows):
    """doc_id -> (n_lines, n_long, n_kept, kept_sum), by comparing all lines with all; unique ids."""
    rows = sorted(rows)
    first = {}
    for doc_id, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            if len(line) >= line_dedup.MIN_CHARS:
                first.setdefault(line, (doc_id, i))
    dropped = {b for b in first for a in first if first[a] < first[b] and within_one(a, b)}
    out = {}
    for doc_id, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [i + 1 for i, x in enumerate(lines) if first.get(x) == (doc_id, i) and x not in dropped]
        out[doc_id] = (len(lines), sum(len(x) >= line_dedup.MIN_CHARS for x in lines), len(kept), sum(kept))
    return out


def edited(rng):
    base = [prose(rng, 5) for _ in range(6)] + ["a" * 25, "ab" * 12 + "é", "中文" * 11]
    rows = []
    for doc_id in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(base)
            for _ in range(rng.randint(0, 2)):
                i, c = rng.randrange(len(line)), rng.choice("abé中 ")
                line = rng.choice([line[:i] + line[i + 1:], line[:i] + c + line[i:], line[:i] + c + line[i + 1:]])
            lines.append(line)
        rows.append((doc_id, "\n".join(lines) if lines else None))
    return rows


def report(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def test_edited_lines_equal_brute_force(spark, monkeypatch):
    rows = edited(random.Random(3))
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in rows])
    want = brute(rows)
    assert report(line_dedup.line_report(docs)) == want
    assert sum(w[2] for w in want.values()) < sum(w[1] for w in want.values())
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert report(line_dedup.line_report(docs)) == want


def test_given_documents_keep_one_of_each_line(spark):
    rows = [(r.doc_id, r.text) for r in real(spark).limit(60).collect()]
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in rows])
    assert report(line_dedup.line_report(docs)) == brute(rows)


def test_cleaned_texts(spark):
    a, b = "the first line of the text", "the first line of the texts"
    docs = frame(spark, [(1, f"{a}\nshort\n{a}\nshort", "en", "x", 0), (2, f"{b}\n\nanother line that is long", "en", "x", 0),
                         (3, None, "en", "x", 0)])
    got = {r.doc_id: r.text for r in line_dedup.cleaned(docs).collect()}
    assert got == {1: f"{a}\nshort\nshort", 2: "\nanother line that is long", 3: None}


def test_odd_rows(spark):
    rows = line_dedup.line_report(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    assert {(r.n_lines, r.n_kept) for r in rows if r.doc_id == 1} == {(0, 0)}
    assert {(r.n_lines, r.n_kept) for r in rows if r.doc_id == 2} == {(1, 0)}
    assert {r.n_kept for r in rows if r.doc_id in (5, 6)} == {0, 1} and {r.n_kept for r in rows if r.doc_id == 6} == {0}
    cleaned = line_dedup.cleaned(odd(spark))
    assert cleaned.columns == odd(spark).columns and cleaned.count() == len(odd_rows())
    assert line_dedup.line_report(empty(spark)).count() == 0


def test_runs_no_python(spark):
    plan = line_dedup.line_report(odd(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def brute_every(rows):
    """doc_id -> (n_lines, n_long, n_kept, kept_sum, n_compared) when all lines that are not blank take part."""
    rows, least = sorted(rows), 20
    takes_part = lambda x: len(x) >= least or bool(x.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for doc_id, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            if takes_part(line):
                first.setdefault(line, (doc_id, i))
    long = [x for x in first if len(x) >= least]
    dropped = {b for b in long for a in long if first[a] < first[b] and within_one(a, b)}
    out = {}
    for doc_id, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [i + 1 for i, x in enumerate(lines) if first.get(x) == (doc_id, i) and x not in dropped]
        out[doc_id] = (len(lines), sum(len(x) >= least for x in lines), len(kept), sum(kept), sum(map(takes_part, lines)))
    return out


def test_query_drops_repeats_of_short_lines(spark, tmp_path):
    short = ["Menu", "Log in", "menu", "x" * 19, "x" * 20, "", " \t", " " * 25, "\u00a0", "é中😀"]
    rng = random.Random(8)
    rows = [(i, None if t is None else "\n".join([t, *rng.choices(short, k=rng.randint(0, 5))])) for i, t in edited(rng)]
    frame(spark, [(i, t, "en", "a", 0) for i, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_every(rows)
    assert report(QUERIES["op7_line_neighbours"](spark, str(tmp_path))) == want
    assert sum(w[2] for w in want.values()) < sum(w[4] for w in want.values())


def test_cleaned_texts_of_every_line(spark):
    a, b = "the first line of the text", "the first line of the texts"
    docs = frame(spark, [(1, f"{a}\nshort\n{a}\n\nshort\n", "en", "x", 0), (2, f"{b}\n\nshort\nshorts", "en", "x", 0), (3, None, "en", "x", 0)])
    got = {r.doc_id: r.text for r in line_dedup.cleaned(docs, every=True).collect()}
    assert got == {1: f"{a}\nshort\n\n", 2: "\nshorts", 3: None}
