import corpus_pipeline
from docloom.llm.base import stored
from docloom.llm.decontaminate import contaminated
from docloom.llm.minhash import near_duplicates
from docloom.llm.pii import base_spans

from .conftest import sentence


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, sf), "test")
        out.append({r.doc_id: r for r in docs.collect()})
        assert i == 4 or docs.columns == columns
    start = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(out[0]) == start.count()
    classes = {r.class_id for r in near_duplicates(start).collect()}
    assert set(out[1]) == classes and len(classes) < len(out[0])
    bad = {r.doc_id for r in contaminated(start, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert set(out[2]) == classes - bad and bad & classes
    assert set(out[3]) == set(out[2])
    for key, row in out[3].items():
        assert not base_spans(row.text) and row.n_chars == len(row.text)
        if not base_spans(out[2][key].text):
            assert row.text == out[2][key].text or "<" in row.text
    assert set(out[4]) == set(out[3]) and all(r.round_trip for r in out[4].values())
    assert corpus_pipeline.run(spark, sf).count() == len(out[4])


def test_odd_rows(spark, odd_docs, sf):
    docs = odd_docs.withColumnsRenamed({"media": "_rows", "file": "_kept"})
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stored(stage(spark, docs, sf), "test")
        assert name == "sentencepiece" or docs.columns == columns
        kept[name] = sorted((r.doc_id is not None, r.doc_id or 0) for r in docs.collect())
    assert kept["near_duplicates"] == [(True, 1), (True, 6), (True, 7), (True, 9), (True, 10)]
    assert kept["sentencepiece"] == kept["near_duplicates"]
    empty = odd_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, sf), "test")
    assert empty.count() == 0


def test_rows_without_or_with_the_same_doc_id(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    near = sentence(61, 100)
    rows = [
        (None, near), (None, near + " more"), (None, sentence(62, 80)), (None, sentence(63, 90)), (5, sentence(63, 90) + " more"),
        (7, sentence(64, 70)), (7, sentence(64, 70) + " more"), (7, sentence(65, 70)), (3, sentence(65, 70) + " more"), (7, sentence(66, 70)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, sf).collect()}
    assert len(left & set(rows[:2])) == 1 and len(left & set(rows[5:7])) == 1
    assert left - set(rows[:2]) - set(rows[5:7]) == {rows[2], rows[4], rows[8], rows[9]}
    rows = [(None, item), (None, sentence(62, 80)), (7, item + " end"), (7, sentence(66, 70))]
    clean = corpus_pipeline.decontaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert {(r.doc_id, r.text) for r in clean.collect()} == {rows[1], rows[3]}
