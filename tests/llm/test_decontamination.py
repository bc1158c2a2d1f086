import collections
import hashlib
import random
import re

import pytest

from tests.llm.cases import DATA, empty, frame, odd, odd_rows, prose, real
from tidemark.llm import decontamination
from tidemark.llm.workload import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items):
    windows = {}
    for item_id, text in items:
        words = split(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[i:i + 10]), set()).add(item_id)
    out = []
    for doc_id, text in rows:
        words, hit, ids = split(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                found = windows.get(tuple(words[i:i + size]))
                if found is not None:
                    hit |= set(range(i, i + size))
                    ids |= {str(x) for x in found if x is not None}
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=str)


def result(docs, items):
    found = decontamination.contamination(docs, items).drop("n_near", "n_near_items")
    return sorted(map(tuple, found.collect()), key=str)


def planted(rng):
    few = ["a", "b", "c"]
    items = [(i, prose(rng, rng.choice([1, 2, 5, 9, 10, 11, 30]))) for i in range(12)]
    items += [(20, prose(rng, 14, few)), (21, " ".join(["same"] * 12)), (22, "ÉCOLE École ecole ÇA"), (23, "!!"), (24, None), (None, prose(rng, 15)),
              (2, prose(rng, 12)), (2, items[3][1])]
    rows = []
    for doc_id in range(50):
        parts = [prose(rng, rng.randint(0, 30), few if doc_id % 5 == 0 else None)]
        for _ in range(rng.randint(0, 3)):
            words = split(rng.choice(items)[1])
            low = rng.randint(0, 2)
            parts += [" , ".join(words[low:len(words) - rng.randint(0, 1)]).upper().replace("É", "é"), prose(rng, rng.randint(0, 4))]
        rows.append((doc_id, ". ".join(parts)))
    rows += [(60, " ".join(["same"] * 700)), (61, (prose(rng, 250) + " " + items[5][1] + " ") * 3), (62, "ÉCOLE École ecole ÇA"), (None, items[11][1])]
    return rows, items


@pytest.mark.parametrize("segment", [8, 256])
def test_planted_windows_equal_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(decontamination, "SEGMENT", segment)
    rows, items = planted(random.Random(segment))
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in rows])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert result(docs, bench) == want and sum(w[5] for w in want) > 20


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    rows, items = planted(random.Random(1))
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in rows])
    assert result(docs, spark.createDataFrame(items, "item_id long, text string")) == brute(rows, items)


def test_given_documents(spark):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in real(spark).collect()]
    assert result(real(spark), bench) == brute(rows, [(r.item_id, r.text) for r in bench.collect()])


def test_proximity(spark):
    item = "zeta one two three four five omega six seven eight"
    texts = ["zeta one two three four five omega", "zeta one two x three four five omega", "zeta one two three four five x x x x x x x x x omega",
             "omega zeta", "zeta"]
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    iid = decontamination.item_words(spark.createDataFrame([(1, item)], "item_id long, text string")).first().iid
    anchor = spark.createDataFrame([(iid, "zeta", 0), (iid, "omega", 6)], "iid long, word string, place int")
    words = anchor.select("word").distinct()
    near = decontamination.proximity_matches(decontamination.postings(decontamination.keyed(docs), words), anchor, slop=3)
    assert {r._id for r in near.collect()} == {1}


def test_odd_rows_and_filter(spark):
    items = [(1, odd_rows()[4][1]), (2, "one two three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert result(odd(spark), bench) == brute([r[:2] for r in odd_rows()], items)
    kept = decontamination.clean(odd(spark), bench)
    hit = [r for r in brute([r[:2] for r in odd_rows()], items) if r[5]]
    assert kept.columns == odd(spark).columns and kept.count() == len(odd_rows()) - len(hit) and len(hit) == 6
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(empty(spark), bench).count() == 0
    assert decontamination.contamination(odd(spark), none).filter("contaminated").count() == 0
    assert decontamination.clean(odd(spark), none).count() == len(odd_rows())


def test_runs_no_python(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    plan = decontamination.contamination(odd(spark), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def brute_proximity(rows, items, slop=5):
    counts, out = collections.Counter(w for _, text in rows for w in split(text)), []
    anchors = []
    for _, text in items:
        places = [(counts[w], i, w) for i, w in enumerate(split(text))]
        anchors.append({(w, i) for k in range(max(1, len(places) - 9)) for _, i, w in sorted(places[k:k + 10])[:2]})
    for doc_id, text in rows:
        at, near = collections.defaultdict(list), []
        for i, w in enumerate(split(text)):
            at[w].append(i)
        for some in anchors:
            have = [(i - place, place) for w, place in some for i in at[w]]
            near.append(sum(any(1 <= s - t <= slop and p != q for t, q in have) for s, p in have))
        out.append((doc_id, sum(near), sum(n > 0 for n in near)))
    return sorted(out, key=str)


def test_proximity_query_equals_brute_force(spark, tmp_path):
    rows, items = planted(random.Random(2))
    rows = [r for r in rows if r[0] != 60] + [(70, " ".join(["same"] * 40)), (71, None), rows[3], rows[3]]
    frame(spark, [(i, t, "en", "a", 0) for i, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["op8_positional_index"](spark, str(tmp_path)).select("doc_id", "n_near", "n_near_items")
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == brute_proximity(rows, items) and sum(r[1] > 0 for r in got) > 5


def test_proximity_past_a_nearer_posting(spark):
    """A at shifts 0 and 3, B at shift 3: the pair of the first A and B is within reach, past the second A."""
    docs = frame(spark, [(1, "aa x x aa x x x bb", "en", "a", 0)])
    anchor = spark.createDataFrame([(0, "aa", 0), (0, "bb", 4)], "iid long, word string, place int")
    index = decontamination.postings(decontamination.keyed(docs), anchor.select("word"))
    assert [r.near for r in decontamination.proximity_matches(index, anchor).collect()] == [1]
