import collections
import math
import re

from tests.llm.cases import empty, frame, odd, odd_rows, prose, real
from tidemark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    found = collections.Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if found[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated))


def test_base_columns_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in real(spark).collect()]
    got = {r.doc_id: r for r in quality.judge(real(spark)).collect()}
    for doc_id, text in rows:
        r, want = got[doc_id], counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_fences_are_quartiles_of_the_sketches(spark):
    """Brute force over exact values cut to six binary digits, for sources above and below the least size."""
    def cut(v):
        shift = max(len(bin(v)) - 2 - 6, 0)
        return v >> shift << shift

    judged = {r.doc_id: r for r in quality.judge(real(spark)).collect()}
    docs = {r.doc_id: (r.lang, r.source) for r in real(spark).collect()}

    def fence(name, members):
        least, lower = quality.MEASURES[name]
        values = sorted(cut(judged[i][name]) for i in members)
        q1, q3 = values[math.ceil(len(values) / 4) - 1], values[math.ceil(len(values) * 3 / 4) - 1]
        width = max(q3 - q1, least) * quality.FENCE
        return (math.trunc(q1 - width / 2) if lower else None), q3 + width

    good = [i for i, r in judged.items() if not r.base_failed]
    for doc_id, r in judged.items():
        if r.base_failed:
            continue
        lang, source = docs[doc_id]
        group = [i for i in good if docs[i] == (lang, source)]
        group = group if len(group) >= quality.MIN_DOCUMENTS else [i for i in good if docs[i][0] == lang]
        group = group if len(group) >= quality.MIN_DOCUMENTS else good
        want = all((low is None or r[m] >= low) and r[m] <= high for m in quality.MEASURES
                   for low, high in [fence(m, group)])
        assert r.kept == want, doc_id


def test_adapts_to_each_source_and_keeps_clean_documents(spark):
    import random
    rng = random.Random(1)
    once = [f"{w}{i}" for i, w in enumerate(prose(rng, 80).split())]  # no word twice

    def row(doc_id, source, text):
        return doc_id, text, "en", source, 0

    tables = [row(i, "tables", " | ".join(rng.sample(once, 70))) for i in range(80)]
    plain = [row(100 + i, "plain", " ".join(rng.sample(once, 70))) for i in range(80)]
    junk = [row(999, "plain", " ".join(w + "$$$%%" for w in once))]
    kept = {r.doc_id for r in quality.judge(frame(spark, tables + plain + junk)).filter("kept").collect()}
    assert kept == {r[0] for r in tables + plain}


def test_odd_rows_and_filter_agree(spark):
    rows = quality.judge(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    assert all(r.base_failed and r.n_words == 0 for r in rows if r.doc_id in (1, 2, 3))
    kept = quality.keep_good(odd(spark))
    assert kept.columns == odd(spark).columns
    assert kept.count() == sum(r.kept for r in rows) > 0
    assert quality.judge(empty(spark)).count() == 0 and quality.keep_good(empty(spark)).count() == 0
