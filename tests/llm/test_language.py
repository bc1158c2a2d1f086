import zlib

import numpy as np

from tests.llm.cases import empty, odd, odd_rows, real
from tidemark.llm import language


def brute_bits(counts: dict, text: bytes) -> float:
    """Code length of a text, byte by byte, from counts of whole grams of one language."""
    raw, bits = language.START + text, 0.0
    for i in range(language.ORDER, len(raw)):
        for order in range(language.ORDER, -1, -1):
            context, byte = raw[i - order:i], raw[i]
            follow: dict[int, int] = {}
            for gram, n in counts.items():
                if gram[language.ORDER - order:language.ORDER] == context:
                    follow[gram[-1]] = follow.get(gram[-1], 0) + n
            total = sum(follow.values()) + len(follow)
            if byte in follow:
                bits -= np.log2(follow[byte] / total)
                break
            if follow:
                bits -= np.log2(len(follow) / total)
        else:
            bits += 8
    return bits


def test_code_lengths_equal_brute_force():
    training = {"aa": [b"the cat sat on the mat", b"then"], "bb": [b"der Hut", b"das ist gut"]}
    rows, counts = [], {}
    for lang, texts in training.items():
        number, n = np.unique(language.grams(texts)[0], return_counts=True)
        rows += [(lang, int(g), int(c)) for g, c in zip(number, n)]
        counts[lang] = {int(g).to_bytes(language.ORDER + 1, "big"): int(c) for g, c in zip(number, n)}
    trees = language.Trees(rows)
    texts = [b"the hat", b"gut ist das", b"\xff\x00", b"q"]
    got = trees.lengths(texts)
    for i, text in enumerate(texts):
        for k, lang in enumerate(trees.languages):
            assert abs(got[i, k] - brute_bits(counts[lang], text)) < 1e-3


def test_held_out_accuracy_and_fold(spark):
    rows = language.identify(real(spark)).join(real(spark).select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_prediction_uses_the_text_alone(spark):
    from pyspark.sql import functions as F
    trees_from = real(spark)
    plain = {r.doc_id: r.lang_pred for r in language.identify(trees_from).collect()}
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2
    blind = trees_from.withColumn("lang", F.when(~held, F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert {r.doc_id: r.lang_pred for r in language.identify(blind).collect()} == plain


def test_odd_rows(spark):
    both = real(spark).unionByName(odd(spark).select(*real(spark).columns))
    rows = language.identify(both).filter("doc_id IS NULL OR doc_id < 0 OR doc_id < 11").collect()
    assert [r.lang_pred for r in rows if r.doc_id is None].count("und") == 1
    only = language.identify(odd(spark)).collect()
    assert len(only) == len(odd_rows())
    assert all(r.lang_pred == "und" and r.score == 0 for r in only if r.doc_id in (1, 2, 3))
    assert not any(r.held_out for r in only if r.doc_id is None)
    assert language.identify(empty(spark)).count() == 0
    assert language.has_letter("12 中") and not language.has_letter("12 ²½ _ !?") and language.has_letter("½ é")
