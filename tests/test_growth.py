"""Steps whose cost must grow no faster than their input."""

import io
import re
import zipfile
import zlib

import pyarrow as pa
import pytest
from docloom.functions import drawing as D
from docloom.functions.text import digit_choice, strip
from docloom.operators import bands as B
from docloom.operators import formpages
from docloom.operators import glyphs as G
from docloom.operators import spans as S
from docloom.plans import part_lists as P
from docloom.plans import queries_drawings as QD
from docloom.plans import queries_files as QF
from docloom.plans import queries_part_lists as QP
from docloom.plans import queries_quotations as QQ
from docloom.sources import archive as A
from docloom.sources.derived import LINES_SQL, relation
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_decoded_broadcasts_nothing(spark):
    chars = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("ord"), F.lit(1.0).alias("x0"), F.lit(65).alias("code"))
    maps = chars.select("doc_id", "page", F.lit(1).alias("font_id"), "code", F.lit("A").alias("glyph"))
    words = G.decoded(chars, maps)
    assert "BroadcastExchange" not in plan_of(words)
    assert {tuple(r) for r in words.collect()} == {(i, 0, 1, "A") for i in range(100)}


def test_words_in_one_pass(spark):
    columns = ["doc_id", "page", "ord", "text"] + [f"CAST({c} AS DOUBLE) AS {c}" for c in ("x0", "x1", "top", "size")]
    for sql, marked in ((QQ.WORDS_SQL, "true"), (QQ.FORMS_SQL, QQ._MARKED)):
        got, want = QQ.rendered(spark, SF, marked), relation(spark, SF, sql).selectExpr(*columns)
        assert got.columns == want.columns
        assert plan_of(got).count(" Window ") == 1
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_lines_are_numbered_once(spark):
    plan = plan_of(relation(spark, SF, QQ.GLYPHS_SQL))
    assert " Window " not in plan and "lineitem" not in plan


def test_pages_are_read_without_columns_of_roles(spark):
    """Eight columns of roles before the aggregates made one generated method that the JVM runs uncompiled."""
    pages = B.read_pages(B.clean_words(QQ.rendered(spark, SF)), "example.com")
    assert "partial_collect_list(CASE WHEN" in plan_of(pages)
    nothing = spark.createDataFrame([(1, 0, 1, "x", 1.0, 2.0, 5.0, 8.0)], "doc_id long, page int, ord int, text string, x0 double, x1 double, top double, size double")
    assert B.read_pages(nothing, "example.com").isEmpty()


def test_what_a_page_says_is_found_without_nested_arrays(spark):
    """Functions of arrays inside others are interpreted for each pair of words; batches of pages are bisected instead, with the same results."""
    texts = {735: ("P12345", "ABCDE", "P12345\n"), 500: ("Each", "each"), 260: ("1.50", "3.1234", "9" * 320 + ".5"), 360: ("7", "2147483648", "0" * 20 + "12", "x"), 30: ("FAI-", "F"), 35: ("1", "22"), 130: ("123456", "1234567"), 100: ("a@example.com", "b@x.org")}
    tops = (55.0, 95.3, 102.7, 150.0, 154.0, 154.1, 158.0, 146.1, 162.0, float("nan"), None)
    pick = lambda options, *key: options[zlib.crc32(repr(key).encode()) % len(options)]
    rows = []
    for page in range(200):
        for i in range((0, 1, 20, 60)[page % 4]):
            x = pick(sorted(texts), page, i)
            rows.append((page // 3, page % 3, i, pick(texts[x], i, page), float(x), x + 20.0, pick(tops, x, page, i), 8.0))
    words = spark.createDataFrame(rows, "doc_id long, page int, ord int, text string, x0 double, x1 double, top double, size double")
    pages = B.read_pages(words, "example.com")
    assert "lambdafunction" not in plan_of(pages) and "MapInArrow" in plan_of(pages)
    flat = pages.select("doc_id", "page", F.explode("parts").alias("p")).select("doc_id", "page", "p.*").select("doc_id", "page", "part_ord", "part_no", F.explode("deliveries").alias("d"))
    columns = ["qty_ord", "quantity", "weeks", "has_marker"]
    got = flat.select("doc_id", "page", "part_ord", "part_no", *[f"d.{c}" for c in columns], digit_choice(F.col("d.digit")).alias("choice"))
    plain = B.marked_choice(words, B.first_weeks(words, B.quantities(words, B.part_intervals(B.part_words(words))))).select(*got.columns)
    assert plain.count() > 50 and got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
    anchors = pages.where("mail IS NOT NULL").select("doc_id", "page", "mail.text", "mail.x0", "mail.x1", "mail.top")
    assert sorted(map(tuple, anchors.collect())) == sorted(map(tuple, B.mail_anchor(words, "example.com").collect())) != []


def test_cells_are_put_in_lines_once_for_all_fonts(spark):
    rows = spark.createDataFrame([(d, 0, 1, 1, 10.0, False, None) for d in range(1, 6)], "doc_id long, page int, qty_ord int, part_ord int, qty_top double, has_marker boolean, choice string")
    texts = {1: [("b", 12.0), ("a", 12.0), ("d", 20.0), ("c", 20.0)], 2: [("b", 12.0), ("a", 12.0), ("x", 20.0)], 3: [("c", 20.0), ("b a", 12.0), ("d", 20.0)], 4: [("dc", 20.0), ("b", 12.0), ("a", 13.0)], 5: [("b", 12.0), (" a", 12.0), ("d", 20.0), ("c", 20.0)]}
    chars = [(d, 0, i, ord(t[0]) if t != "x" else None, 30.0 + i, top, 0.0) for d, found in texts.items() for i, (t, top) in enumerate(found)]
    maps = [(d, 0, font, ord(t[0]), t if font == 0 else t.upper()) for d, found in texts.items() for t, _ in found if t != "x" for font in (0, 1)]
    maps.append((1, 0, 2, ord("a"), "abcd"))
    maps += [(2, 0, 3, ord("a"), "cd"), (2, 0, 3, ord("b"), "ab")]
    chars = spark.createDataFrame(chars, "doc_id long, page int, ord int, code int, x0 double, top double, size double")
    maps = spark.createDataFrame(maps, "doc_id long, page int, font_id int, code int, glyph string")
    got = B.cell_choice(chars, maps, rows, "a bcd")
    plan = plan_of(got)
    # Without the font among its keys, the step of lines sees each character once.
    assert "font_id" not in next(x for x in plan.splitlines() if "MapInPandas" in x)
    assert {r.doc_id: r.choice for r in got.collect()} == {1: "a bcd", 2: None, 3: None, 4: "a bcd", 5: "a bcd"}


def test_many_words_are_read_a_part_at_a_time():
    word = pa.struct([("ord", pa.int32()), ("text", pa.string()), *[(c, pa.float64()) for c in ("x0", "x1", "top")]])
    lists = pa.array([[], [{"ord": 2, "text": "123456", "x0": 130.0, "x1": 160.0, "top": 55.0}] * 3, None, [{"ord": 1, "text": "654321", "x0": 130.0, "x1": 160.0, "top": 55.0}]], pa.list_(word))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array([0] * 4), lists], ["doc_id", "page", "words"])
    for at_once in (1, 2, 100):
        found = [r for b in formpages.read_all([batch], "x", B.FORM, at_once) for r in b.to_pylist()]
        assert [(r["doc_id"], r["parts"], r["number"]["text"], r["mail"]) for r in found] == [(1, [], "123456", None), (3, [], "654321", None)]


def test_lines_stay_with_their_document(spark):
    lines = relation(spark, SF, LINES_SQL)
    assert plan_of(lines.groupBy("doc_id", "ord").count()).count("Exchange hashpartitioning") == 1
    plain = spark.sql(LINES_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{SF}/lineitem.parquet"))
    assert lines.schema.simpleString() == plain.schema.simpleString() and lines.exceptAll(plain).isEmpty() and plain.exceptAll(lines).isEmpty()


def test_patterns_run_on_cells_that_may_match(spark):
    grid = [(1, 0, 0, ["x", "Part\n List  FOR : p7, b", None]), (1, 0, 1, ["qty 2", "a", "b"]), (1, 0, 2, [None, " QTY\t", "Component\r\nItem", "operation  sequence "]), (2, 0, 0, None), (3, 0, 0, ["part list for q"])]
    found = P.scanned(spark.createDataFrame(grid, "doc_id long, file_ord int, row_idx int, cells array<string>"))
    assert {(r.doc_id, r.part_no, r.pn_row, r.header_row, tuple(r["at"] or ())) for r in found.collect()} == {(1, "p7", 0, 2, (4, 3, 2)), (2, None, None, None, ()), (3, None, None, None, ())}
    assert "contains(" in plan_of(found).lower()


def test_clusters_of_small_and_large_pages_are_the_same(spark, monkeypatch):
    items = spark.range(900).select(F.lit(1).alias("doc_id"), (F.col("id") % 50).cast("int").alias("page"), F.col("id").cast("int").alias("ord"), *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000))).cast("double").alias(c) for k, c in enumerate(("x0", "y0"))])
    items = items.withColumn("x1", F.col("x0") + 5).withColumn("y1", F.col("y0") + 7)
    small = {tuple(r) for r in S.clustered(items, 180.0).collect()}
    monkeypatch.setattr(S, "FEW", 0)
    large = S.clustered(items, 180.0)
    assert small == {tuple(r) for r in large.collect()} and 50 < len({(r[1], r[-1]) for r in small}) < 900


def longest_method(df, capsys):
    capsys.readouterr()
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no code yet
    df.explain("codegen")
    df.sparkSession.conf.unset("spark.sql.adaptive.enabled")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))


def test_rules_of_dimensions_are_compiled(spark, capsys):
    """The JVM doesn't compile methods of more than 8,000 bytes."""
    assert longest_method(QD.dim_grammar(spark, SF), capsys) < 8_000
    spans = QD._spans(spark, SF)
    assert longest_method(S.dimensions(spans), capsys) < 8_000
    texts = spark.createDataFrame([("x",)], "text string")
    assert longest_method(texts.where(D.tolerance_header(F.col("text")) | D.notes_header(F.col("text"))), capsys) < 8_000


def test_strip_takes_all_white_space(spark):
    signs = [chr(i) for i in range(1, 0x3100)] + ["a\n", "  b  ", "", None]
    texts = spark.createDataFrame([(t,) for x in signs for t in ([x, f"{x}a b{x}{x}"] if x is not None else [None])], "t string")
    assert texts.where(~strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).isEmpty()
    parts = texts.select(*[c.alias(n) for n, c in zip("nt", D.split_tolerance(F.col("t")), strict=True)])
    assert [tuple(r) for r in parts.where("n IS NULL").collect()] == [(None, "")]


def test_plain_archives_are_read_as_zipfile_does():
    members = [("a.xls", b"1"), ("data/files/b.ZIP", b"\0" * 300), ("empty", b"")]
    plain = A.stored_zip(members)
    with zipfile.ZipFile(io.BytesIO(plain)) as archive:
        assert archive.testzip() is None and [(x.filename, archive.read(x)) for x in archive.infolist()] == members
    walk = A._Walk(A.Budget())
    archive, found = walk.open(plain)
    assert archive is plain and [(x.filename, walk.read(archive, x)) for x in found] == members
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("é.txt", b"x" * 50)
    for raw in (other.getvalue(), b"junk" + plain, plain + b"x", plain[:-1], b"", plain.replace(b"a.xls", b"b.xls", 1)):
        assert A._plain_members(raw) is None
    changed = plain.replace(b"1", b"2", 1)
    with pytest.raises(zipfile.BadZipFile):
        walk.read(*[(changed, m[0]) for m in [walk.open(changed)[1]]][0])


def test_uploads_gather_no_lines(spark):
    assert "collect_list" not in plan_of(QP._uploads(spark, SF)) + plan_of(QF._uploads(spark, SF))
