import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.cases import DATA, empty, odd, real
from tests.llm import test_decontamination, test_nearduplicates
from tidemark.llm import quality, tokens


def test_every_stage_follows_from_its_input(spark):
    """Each stage of the whole run against brute force on what the stage before it kept."""
    docs, kept = real(spark), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(
            stage(spark, docs, DATA).collect(), docs.schema)
        kept[name] = docs.collect()
        assert docs.columns == real(spark).columns
    good = {r.doc_id for r in quality.judge(real(spark)).filter("kept").collect()}
    assert {r.doc_id for r in kept["quality"]} == good
    component = test_nearduplicates.brute([(r.doc_id, r.text) for r in kept["quality"]])
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted(i for i, (_, c) in component.items() if i == c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hit = {r[0] for r in test_decontamination.brute([(r.doc_id, r.text) for r in kept["near_duplicates"]], items) if r[5]}
    assert hit and {r.doc_id for r in kept["decontamination"]} == {r.doc_id for r in kept["near_duplicates"]} - hit
    assert {r.doc_id for r in kept["mixing"]} <= {r.doc_id for r in kept["decontamination"]}
    last = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in kept["mixing"])
    every = sorted((r.start, r.n_tokens) for r in last)
    assert every[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(every, every[1:]))
    code = tokens.encoder(tokens.vocabulary_path())
    text = {r.doc_id: r.text for r in kept["mixing"]}
    assert all(r.n_tokens == len(code.encode(text[r.doc_id])) + 1 for r in last)


def test_stages_take_odd_and_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd(spark), DATA)
        assert out.count() > 0
        if name != "tokens":
            assert out.columns == odd(spark).columns
            given = {tuple(r) for r in odd(spark).collect()}
            assert all(tuple(r) in given for r in out.collect())
        assert stage(spark, empty(spark), DATA).count() == 0


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
