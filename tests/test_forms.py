"""Whole documents read in batches: the same as joins of tables of words and characters, with one shuffle and nothing written."""

import random

import pyarrow as pa
import pytest
from docloom.operators import forms
from docloom.operators.pages import in_order
from docloom.plans import queries_quotations as QQ
from docloom.plans import quotations as Q
from docloom.sources import layouts
from pyspark.sql import Window
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = "doc_id long, page int, ord int, text string, x0 double, x1 double, top double, size double"
CHARS = "doc_id long, page int, ord int, code int, x0 double, top double, size double"
MAPS = "doc_id long, page int, font_id int, code int, glyph string"


def same(a, b):
    b = b.select(*a.columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_forms_are_laid_out_as_sql_has_them(spark):
    lines = QQ._lines(spark, SF)
    _, chars, maps = QQ._forms(spark, SF)
    for k, (want, schema) in enumerate(((QQ.rendered(spark, SF, QQ._MARKED), WORDS), (chars, CHARS), (maps, MAPS))):
        same(in_order(lines, "doc_id", lambda batch, k=k: layouts.forms(batch)[k], schema), want)
    same(in_order(lines, "doc_id", layouts.words, WORDS), QQ.rendered(spark, SF))


@pytest.mark.parametrize("name", ["quotation_errors", "fai_cells", "quotation_rows", "quotation_tsv", "rfq_dates"])
def test_documents_are_read_where_they_are_laid_out(spark, monkeypatch, name):
    def kept(df, name):
        raise AssertionError(f"{name} was written")

    for module in (Q, QQ):
        monkeypatch.setattr(module, "kept", kept)
    plan = QQ.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "collect_list" not in plan


def odd_tables(seed):
    """Pages with words, characters and fonts of all kinds that are read, and of some that aren't."""
    pick = random.Random(seed)
    texts = {740.0: ["P12345", "Q1234", "ABCDE", "R99999\n"], 505.0: ["Each", "each"], 265.0: ["1.50", "12.125", "3.1234"], 362.0: ["7", "12", "2147483648", "x"], 30.0: ["FAI-", "FAI", "F"], 36.0: ["1", "3", "9", "x"], 135.0: ["123456", "654321", "12345"], 100.0: ["a@example.com", "b@x.org"]}
    words, chars, maps = [], [], []
    for doc in range(1, 61):
        clean = doc % 2 == 0  # most of these have no error
        for page in range(doc % 3 + (doc % 7 != 0)):
            ord_ = 0
            rows = [150.0 + 40 * k for k in range(pick.randint(0, 4))]
            places = [(x, t + pick.choice([0, 0, 1, 5])) for t in rows for x in (740.0, 505.0, 265.0, 362.0, 30.0) if clean or pick.random() < (0.5 if x == 30.0 else 0.9)]
            places += [(36.0, t + 8) for t in rows if clean or pick.random() < 0.6] + [(135.0, 55.0)] * (clean or pick.randint(0, 2)) + [(100.0, pick.choice([95.0, 99.0, 104.0]))] * (clean or pick.randint(0, 2))
            for x, top in places:
                ord_ += 1
                words.append((doc, page, ord_, pick.choice(texts[x][:1] * 4 + texts[x] * (not clean)), x, x + 15, float(top), pick.choice([8.0, 8.0, 8.0, 8.0, 0.0 if not clean else 8.0])))
            words.append((doc, page, 500, "é", 1.0, 2.0, 3.0, 8.0))
            if page == 0 and (clean or pick.random() < 0.9):
                for text, x, step, top in ((pick.choice(["nhoj eod", "nhoj", "x", "bob"]), 100.0, 5.0, 80.0), (pick.choice(["01/02/2024", "30/02/2024", "x29/02/202429/02/2023", "11/11/20241"]), 285.0, 2.0, 180.0)):
                    for i, c in enumerate(text):
                        if c != " ":
                            chars.append((doc, page, len(chars) % 1000, ord(c), x + i * step + (7 if i > 3 and top < 100 else 0), top + pick.choice([0, 0, 0, 30]) * (pick.random() < 0.02), pick.choice([0.0, 0.0, None])))
            for t in rows:
                for k, text in enumerate(("ton", "deriuqer")):
                    if pick.random() < 0.9:
                        for i, c in enumerate(text):
                            chars.append((doc, page, len(chars) % 1000, ord(c) if pick.random() < 0.995 else None, 29.0 + 2 * i, t + 2 + 9 * k + pick.choice([0, 0.5, 1.5]), pick.choice([0.0, 0.0, 0.0, None, 8.0]) if pick.random() < 0.05 else 0.0))
            letters = sorted({c[3] for c in chars if c[:2] == (doc, page) and c[3] is not None})
            for font in range(clean or pick.randint(0, 3)):
                for code in letters:
                    if pick.random() < (0.995, 0.9, 1.0)[font]:
                        glyph = "z" if font == 2 and chr(code) == "b" else chr(code)
                        maps.append((doc, page, font, code, glyph if pick.random() < 0.995 else pick.choice([None, "zz", " "])))
                        if pick.random() < 0.002:
                            maps.append((doc, page, font, code, "q"))
    maps.append((999, 0, 0, 65, "A"))
    return words, chars, maps


@pytest.mark.parametrize("seed", [1, 2])
def test_documents_say_what_joins_find(spark, seed):
    words, chars, maps = tables = odd_tables(seed)
    frames = [spark.createDataFrame(t, s) for t, s in zip(tables, (WORDS, CHARS, MAPS), strict=True)]
    schemas = [pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[k]) for n, k in (c.split() for c in s.split(", "))]) for s in (WORDS, CHARS, MAPS)]

    def render(batch):
        docs = set(batch.column("doc_id").to_pylist())
        return tuple(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(s), s, strict=True)], schema=s) for rows, s in (([r for r in t if r[0] in docs], s) for t, s in zip(tables, schemas, strict=True)))

    items = frames[0].select("doc_id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id")))
    read = Q.documents(items, render)
    rows, errors = Q.quotations(*frames)
    same(Q.document_rows(read), rows)
    same(read.where("error IS NOT NULL").select("doc_id", "error"), errors)
    same(Q.document_bodies(read), Q.export(rows))
    same(Q.document_dates(items, render), Q.submission_dates(*frames))
    found = Q.deliveries(frames[0], chars=frames[1], maps=frames[2]).select("doc_id", "part_ord", "qty_ord", "has_marker", "choice")
    same(Q.document_choices(items, render), found)
    assert {r.choice for r in found.collect()} >= {None, "FAI 1", "not required"} and rows.count() >= 1
    assert len({r.error.split(" for ")[0] for r in errors.collect()}) >= 4

    def first(batch):
        docs, parts = Q.first_part_numbers(render(batch)[0])
        return pa.RecordBatch.from_arrays([pa.array(docs), parts], ["doc_id", "part_no"])

    same(in_order(items, "doc_id", first, "doc_id long, part_no string").where("part_no IS NOT NULL"), Q.first_parts(Q.flattened(Q.parts(Q.deliveries(frames[0])))))


def test_groups_of_many_batches_are_whole(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        items = spark.range(40).select((F.col("id") * F.col("id") / 100).cast("long").alias("doc_id"), "id")
        items = items.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("id")))

        def count(batch):
            docs = batch.column("doc_id").value_counts()
            return pa.RecordBatch.from_arrays([docs.field(0), docs.field(1)], ["doc_id", "n"])

        same(in_order(items, "doc_id", count, "doc_id long, n long"), items.groupBy("doc_id").agg(F.count("*").alias("n")))
        with pytest.raises(Exception, match="aren't in the order of doc_id"):
            in_order(spark.range(10).select((-F.col("id")).alias("doc_id")).coalesce(1), "doc_id", count, "doc_id long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_days_of_the_calendar():
    assert [forms.is_date(t) for t in ("29/02/2024", "29/02/2023", "29/02/1900", "31/04/2024", "00/01/2024", "31/12/0001", "01/13/2024")] == [True, False, False, False, False, True, False]
    assert forms.in_logical_order("  ab  cd\n") == "dc ba" and forms.in_logical_order("") == ""
