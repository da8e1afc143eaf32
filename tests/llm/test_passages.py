import textwrap
from collections import defaultdict

from docloom.llm import paragraphs, passages

from .conftest import sentence
from .test_near_duplicates import words


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {(d, t) for d, t in rows}
    got = passages.repeated_passages(docs).collect()
    return {(r.doc_id, " ".join(words(t[r.start : r.end])), r.n_words, r.keep_doc_id) for r in got if r.removed for d, t in texts if d == r.doc_id}


def test_planted_passages_of_51_words(spark):
    """In mid-line, across lines and in wrapped lines, none of which is a repeated line."""
    passage = sentence(1, 51)
    upper = passage.split()
    rows = [
        (1, sentence(2, 200) + " " + passage + " " + sentence(3, 200)),
        (2, sentence(4, 150) + " " + passage + " " + sentence(5, 170)),
        (3, sentence(6, 30) + " " + " ".join(upper[:25]) + "\n" + " ".join(upper[25:]) + " " + sentence(7, 30)),
        (4, sentence(8, 90) + "\n" + textwrap.fill(passage, 40) + "\n" + sentence(9, 80)),
        (5, sentence(10, 90) + " " + " ".join(upper[:49]) + " " + sentence(11, 80)),
        (None, sentence(12, 70) + " " + passage.upper() + "."),
    ]
    want = {(d, passage, 51, 1) for d in (2, 3, 4, None)}
    assert found(spark, rows) == want
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = paragraphs.repeated_paragraphs(docs)
    assert blocks.where("paragraph IS NOT NULL").count() == 0
    assert {(r.doc_id, r.removed, r.keep_doc_id) for r in blocks.collect()} == {(1, False, 1), *((d, True, 1) for d in (2, 3, 4, None)), (5, True, 1)}
    assert [(r.start, r.end, r.keep_start) for r in passages.repeated_passages(docs).where("NOT removed").collect()] == [(x := rows[0][1].index(passage), x + len(passage), x)]


def test_passages_by_brute_force(spark, sf):
    docs = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    where = defaultdict(list)
    for d, text in docs:
        w = words(text)
        for i in range(len(w) - passages.PASSAGE_WORDS + 1):
            where[tuple(w[i : i + passages.PASSAGE_WORDS])].append((d, i))
    want = set()
    for places in where.values():
        d0, i0 = places[0]
        want |= {(d, k) for d, i in places if d != d0 or i >= i0 + passages.PASSAGE_WORDS for k in range(i, i + passages.PASSAGE_WORDS)}
    texts, got = dict(docs), set()
    for r in passages.repeated_passages(spark.read.parquet(f"{sf}/documents.parquet")).where("removed").collect():
        text = texts[r.doc_id]
        before, n = len(words(text[: r.start])), len(words(text[r.start : r.end]))
        assert n == r.n_words
        other = texts[r.keep_doc_id][r.keep_start :]
        assert words(text[r.start : r.end])[: passages.PASSAGE_WORDS] == words(other)[: passages.PASSAGE_WORDS]
        got |= {(r.doc_id, k) for k in range(before, before + n)}
    assert got == want and want


def test_odd_rows(spark, odd_docs):
    got = {(r.doc_id, r.n_words, r.keep_doc_id) for r in passages.repeated_passages(odd_docs).where("removed").collect()}
    assert {(2, 60, 1), (10, 60, 1), (None, 60, 9)} <= got
    assert passages.repeated_passages(odd_docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a " * 51), (2, ("b " * 120))], "doc_id long, text string")
    assert {(r.doc_id, r.n_words) for r in passages.repeated_passages(same).where("removed").collect()} == {(2, 70)}
