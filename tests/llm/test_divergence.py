from collections import Counter

import duckdb
import numpy as np
from docloom.llm import divergence
from docloom.llm.divergence import divergences, joint_tables, kept_terms, share
from docloom.llm.registry import oracle_sql, queries
from pyspark.sql import functions as F


def by_sql(con):
    return sorted(con.sql(oracle_sql()["op11_divergence"]).fetchall())


def test_result_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, queries()["op11_divergence"](spark, sf).collect())) == by_sql(con)


def test_odd_documents_against_sql(spark, odd_docs):
    rows = [(i, t, lang, s) for i, t, lang, s in odd_docs.select("doc_id", "text", "lang", F.when(F.col("node") % 3 > 0, F.col("node").cast("string"))).collect()]
    rows += [(20 + i, "Ab ab aB é-é é x1x " * (i % 4), "q", f"s{i % 6}") for i in range(30)] + [(90, "only here", "lone", None), (91, None, None, None)]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    docs = spark.createDataFrame([(*r, "t", 1, "p") for r in rows], "doc_id long, text string, lang string, source string, term string, n int, whole string")
    assert sorted(map(tuple, divergences(docs).collect())) == by_sql(con)
    assert divergences(docs.limit(0)).collect() == []


def test_joint_tables_by_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_COLUMNS", 7)  # many column blocks, also within one term
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 50)
    terms = kept_terms(spark.read.parquet(f"{sf}/documents.parquet"))
    want, got = Counter(), Counter()
    for r in terms.collect():
        for x in r.sources:
            for y in r.sources:
                if x.source < y.source:
                    want[r.lang, x.source, y.source, x.n, y.n] += 1
    batches = terms.orderBy("lang", "n").toArrow().to_batches(max_chunksize=300)
    for batch in divergence._multiplied(iter(batches)):
        for r in batch.to_pylist():
            for i, j, n in zip(r["levels_a"], r["levels_b"], r["terms"], strict=True):
                got[r["lang"], r["a"], r["b"], i, j] += n
    assert got == want
    monkeypatch.undo()
    total = joint_tables(terms).select(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0]
    assert total == sum(want.values())


def test_shares_are_exact_for_any_count(spark):
    counts = [0, 1, 8_999_999_999, 9_000_000_000, 3 * 10**15]
    rows = spark.createDataFrame([(c, 7 * 10**15 + 3) for c in counts], "n long, whole long")
    want = [1 + 10**9 * (c + 1) // (7 * 10**15 + 3) for c in counts]
    assert [r[0] for r in rows.select(share("n", "whole")).collect()] == want
    assert divergence._share(np.array(counts), np.full(5, 7 * 10**15 + 3)).tolist() == want


def test_a_long_run_and_a_long_text_are_split_at_blanks():
    data = b"a " * 700_000 + b"b" * 3_000_000 + b" c"
    parts = list(divergence.split(data))
    assert [w for p in parts for w in p] == data.split() and len(parts) > 2
