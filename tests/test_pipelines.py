import io
import io
import zipfile

import pytest
from docloom.operators import bands as B
from docloom.operators import glyphs as Y
from docloom.operators import spans as S
from docloom.plans import orders as O
from docloom.plans import part_lists as P
from docloom.plans import quotations as Q
from docloom.sources.archive import Budget, archive_sheets, bounded_files, sheets_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

ORDER = "77 order no\nJane Roe buyer name\n{n} declared lines\n1 line no\nA-1 supplier item\n1,495.00 required quantity\nR1:revision\n2 line no\nA-1 supplier item\n5 required quantity\n"


def test_orders(spark):
    texts = spark.createDataFrame([(1, ORDER.format(n=2)), (2, ORDER.format(n=3)), (3, "nothing"), (4, None)], "doc_id long, text string")
    rows, rest = O.orders(texts)
    assert [tuple(r) for r in rows.collect()] == [(1, 1, "A-1", 1500.0, "R1", "77", "", "Jane Roe")]
    assert sorted(r.doc_id for r in rest.collect()) == [2, 3, 4]

    def fallback(missing):
        return missing.selectExpr("doc_id", "'0' AS number", "'x' AS buyer", "'c' AS customer"), missing.selectExpr("doc_id", "1 AS line_ord", "'s' AS sku", "1D AS qty", "CAST(NULL AS STRING) AS revision")

    assert sorted(r.doc_id for r in O.orders(texts, fallback=fallback)[0].collect()) == [1, 2, 3, 4]


def zipped(files):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as archive:
        for name, content in files.items():
            archive.writestr(name, content)
    return raw.getvalue()


def damaged(files):
    """An archive whose first member's deflate stream is broken."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in files.items():
            archive.writestr(name, content)
    out = bytearray(raw.getvalue())
    start = 30 + len(next(iter(files)))
    out[start : start + 4] = b"\xff\xff\xff\xff"
    return bytes(out)


def test_a_damaged_archive_is_an_error_row(spark):
    good = zipped({"data/files/PLReport_1.zip": zipped({"a.xls": b"1"})})
    bad = damaged({"data/files/PLReport_1.zip": zipped({"a.xls": b"1" * 500})})
    rows = archive_sheets(spark.createDataFrame([(1, good), (2, bad)], "doc_id long, content binary")).collect()
    assert [(r.doc_id, r.sheet, r.error) for r in sorted(rows, key=lambda r: r.doc_id)] == [(1, "a.xls", None), (2, None, "not a ZIP")]


def test_archives(spark):
    report = zipped({"a.xls": b"1", "b.xlsx": b"2", "c.XLS": b"3"})
    product = zipped({"data/files/PLReport_1.zip": report, "./data/files/plreport2.ZIP": report, "data/files/other.zip": b"x"})
    assert [(r, s, p) for r, s, p in sheets_of(product)] == [("data/files/PLReport_1.zip", "a.xls", b"1"), ("data/files/PLReport_1.zip", "c.XLS", b"3"), ("data/files/plreport2.ZIP", "a.xls", b"1"), ("data/files/plreport2.ZIP", "c.XLS", b"3")]
    assert sheets_of(zipped({"5_1_PRODUCT.ZIP": product})) == sheets_of(product)
    for raw in (b"", b"junk", zipped({}), zipped({"data/files/PLReport.zip": b"junk"}), zipped({"data/files/PLReport.zip": zipped({"a.txt": b""})})):
        with pytest.raises(ValueError):
            sheets_of(raw)
    for budget in (Budget(members=2), Budget(all_members=5), Budget(bytes=100)):
        with pytest.raises(ValueError):
            sheets_of(product, budget)
    rows = archive_sheets(spark.createDataFrame([(1, product), (2, None), (3, b"junk")], "doc_id long, content binary")).collect()
    assert [(r.doc_id, r.error) for r in rows if r.error] == [(2, "not a ZIP"), (3, "not a ZIP")] and len(rows) == 6


def test_bounded_files(spark, tmp_path):
    for name, n in (("a.zip", 5), ("b.zip", 0), ("c.zip", 11), ("d.pdf", 5)):
        (tmp_path / name).write_bytes(b"x" * n)
    good, bad = bounded_files(spark, str(tmp_path), "*.zip", 10)
    assert [r.path[-5:] for r in good.collect()] == ["a.zip"]
    assert sorted((r.path[-5:], r.error) for r in bad.collect()) == [("c.zip", "too large")]


def test_part_lists(spark):
    title, head = ["Part List for: P1, x", "Operation  Sequence", "component item", "QTY"], ["z", "QTY", "Component\nItem", "operation sequence", "qty"]
    grids = {(1, 0): [["x"], ["part list FOR : p1 rev"], head, ["", "2", "=c", "10"], ["", "3", "", "20"]], (1, 1): [["Part List for: q"], ["a"], head, ["", "1"], ["", "1", "d", "9"]], (2, 0): [title, ["", "5", "e", "6"]], (3, 0): [head], (3, 1): grids_ok(head), (4, 0): [["Part List for: x"]], (5, 0): [["Part List for: x"], head]}
    cells = spark.createDataFrame([(*k, i, row) for k, rows in grids.items() for i, row in enumerate(rows)], "doc_id long, file_ord int, row_idx int, cells array<string>")
    parents = spark.createDataFrame([(1, "Q"), (2, "")], "doc_id long, parent string")
    rows, counts, bad = P.part_list(cells, parents)
    assert [(r.doc_id, r.row_no, r.part_no, r.operation_sequence, r.component_item, r.qty) for r in rows.orderBy("doc_id", "row_no").collect()] == [(1, 1, "q", "9", "d", "1"), (1, 2, "p1", "10", "=c", "2"), (2, 1, "P1", "5", "e", "6")]
    assert sorted(tuple(r) for r in counts.collect()) == [(1, 2, 1), (2, 1, 0)]
    assert sorted((r.doc_id, r.file_ord, r.error) for r in bad.collect()) == [(3, 0, "no part number"), (4, 0, "no header"), (5, 0, "no rows")]


def grids_ok(head):
    return [["Part List for: k"], head, ["", "1", "c", "2"]]


def word(text, x0, x1, top, ord_, page=0):
    return (1, page, ord_, text, float(x0), float(x1), float(top), 8.0)


def test_quotation(spark):
    words = [word("P12345", 735, 775, 200, 1), word("Each", 500, 520, 203, 2), word("10.00", 260, 280, 200, 3), word("7", 360, 370, 203, 4), word("8", 360, 370, 199, 5), word("FAI-", 30, 40, 199, 6), word("2", 35, 40, 208, 7), word("Q12345", 735, 775, 300, 8), word("Each", 500, 520, 300, 9), word("1.5", 260, 280, 296, 10), word("3", 360, 370, 296, 11), word("FAI-", 30, 40, 296, 12), word("3", 35, 40, 300, 13)]
    kind = "doc_id long, page int, ord int, text string, x0 double, x1 double, top double, size double"
    flat = Q.flattened(Q.parts(Q.deliveries(spark.createDataFrame(words, kind)))).orderBy("row_no").collect()
    assert [(r.part_no, r.quantity, r.weeks_aro, r.fai) for r in flat] == [("P12345", 10.0, 7, "FAI 2"), ("P12345", 1.5, 3, "FAI 3"), ("Q12345", 1.5, 3, "FAI 3")]
    errors = Q.deliveries(spark.createDataFrame(words[:3] + words[5:6], kind)).collect()
    assert [r.error for r in errors] == ["no weeks for P12345"]
    chars = spark.createDataFrame([(1, 0, i, x, t, s) for i, (x, t, s) in enumerate([(90.0, 80.0, 0.0), (84.9, 80.0, 0.0), (90.0, 87.0, None), (90.0, 87.1, 0.0), (90.0, 80.0, 8.0)])], "doc_id long, page int, ord int, x0 double, top double, size double")
    anchor = B.mail_anchor(spark.createDataFrame([word("a@x.org", 100, 180, 100, 1), word("b@x.org", 100, 180, 98, 2), word("c@x.org", 100, 310, 99, 3)], kind), "x.org")
    assert anchor.first().text == "a@x.org" and sorted(r.ord for r in B.chars_in(chars, B.buyer_box(anchor)).collect()) == [0, 2]


def test_glyphs(spark):
    chars = spark.createDataFrame([(1, 0, i, i * 5.0 + (3.0 if i > 2 else 0.0), c) for i, c in enumerate([65, 66, 67, 68])], "doc_id long, page int, ord int, x0 double, code int")
    maps = spark.createDataFrame([(1, 0, 0, c, chr(c + 32)) for c in (65, 66, 67, 68)] + [(1, 0, 1, 65, "x")], "doc_id long, page int, font_id int, code int, glyph string")
    got = {r.font_id: r.word for r in Y.decoded(chars, maps).collect()}
    assert got == {0: "abc d", 1: None}
    texts = spark.createDataFrame([("(cid:12)",), ("A",), ("é",), ("中",), ("fi",), ("bullet",)], "t string")
    assert [r[0] for r in texts.select(Y.char_code(texts["t"], {"bullet": 183})).collect()] == [12, 65, 233, None, None, 183]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 30), st.integers(1, 8)), min_size=1, max_size=12))
def test_merged_spans_by_a_plain_fold(spark, boxes):
    rows = [(1, 0, i, f"t{i}", float(x), float(y), float(x + w), float(y + 2)) for i, (y, x, w) in enumerate(boxes)]
    want = []
    for _, _, i, t, x0, y0, x1, y1 in sorted(rows, key=lambda r: ((r[5] + r[7]) / 2, r[4], r[2])):
        last = want[-1] if want else None
        if last and abs((y0 + y1) / 2 - (last[3] + last[5]) / 2) <= 1.5 and 0 <= x0 - last[4] <= 6:
            want[-1] = (last[0], last[1] + " " + t, min(last[2], x0), min(last[3], y0), max(last[4], x1), max(last[5], y1))
        else:
            want.append((i, t, x0, y0, x1, y1))
    got = S.merged_spans(spark.createDataFrame(rows, "doc_id long, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")).collect()
    assert [(r.ord, r.text, r.x0, r.y0, r.x1, r.y1) for r in got] == want


def test_placement(spark):
    items = [(1, 0, i + 1, kind, x, y, x + 30.0, y + 10.0, 600.0, 400.0) for i, (kind, x, y) in enumerate([("Linear", 100.0, 100.0), ("Linear", 100.0, 100.0), ("Note", 50.0, 300.0), ("Note", 50.0, 300.0)])]
    df = spark.createDataFrame(items, "doc_id long, page int, balloon long, kind string, x0 double, y0 double, x1 double, y1 double, w double, h double")
    got = S.placed_balloons(df).orderBy("balloon").collect()
    assert (got[2].bx, got[2].by) == (30.0, 305.0) and (got[3].bx, got[3].by) == (30.0, 283.0)
    assert abs(got[0].bx - got[1].bx) >= 20 or abs(got[0].by - got[1].by) >= 20
    assert S.leader_lines(S.placed_balloons(df), df).count() <= 4
