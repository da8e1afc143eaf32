"""Listings, decoders, archives to part lists, one file per document, fonts from streams."""

import hashlib
import io
import zipfile

import pytest
from docloom.operators import glyphs as G
from docloom.plans import orders as O
from docloom.plans import part_lists as P
from docloom.sinks import csv_body, write_documents
from docloom.sources import adapters as X
from docloom.sources.archive import Budget, archive_sheets, listed_files


def zipped(files):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as archive:
        for name, content in files.items():
            archive.writestr(name, content)
    return raw.getvalue()


def test_every_file_of_a_listing_is_a_row(spark, tmp_path):
    (tmp_path / "in a").mkdir()
    for name, n in (("in a/a b%.zip", 5), ("in a/b.zip", 0), ("c.zip", 11), ("d.pdf", 0), ("e.zip", 10)):
        (tmp_path / name).write_bytes(b"x" * n)
    files, errors = listed_files(spark, [f"{tmp_path}/in a", f"{tmp_path}/c.zip", f"{tmp_path}/e.zip"], "*.zip", 10)
    assert sorted((r.path.rpartition("/")[2], bytes(r.content)) for r in files.collect()) == [("a b%.zip", b"xxxxx"), ("e.zip", b"x" * 10)]
    assert sorted((r.path.rpartition("/")[2], r.error) for r in errors.collect()) == [("b.zip", "empty"), ("c.zip", "too large")]
    files, errors = listed_files(spark, f"{tmp_path}/in a/b.zip")
    assert files.count() == 0 and [r.error for r in errors.collect()] == ["empty"]


def test_decoders_by_lateral_join(spark):
    files = spark.createDataFrame([(1, b"one\ftwo\n"), (2, b"\xff"), (3, None), (4, b"")], "doc_id long, content binary")
    pages = X.decoded(files, X.form_feed_pages(), X.PAGES)
    assert pages.columns == ["doc_id", "page", "text", "decode_error"]
    assert sorted(map(tuple, pages.collect()), key=str) == [(1, 0, "one", None), (1, 1, "two\n", None), (2, None, None, "unreadable text"), (3, None, None, None), (4, 0, "", None)]
    texts = {r.doc_id: r.text for r in X.page_text(pages.where("page IS NOT NULL")).collect()}
    assert texts == {1: "--- Page 1 ---\none\n\n--- Page 2 ---\ntwo\n", 4: "--- Page 1 ---\n"}
    chars = X.decoded(files.where("doc_id = 1"), X.grid_chars(), X.CHARS).collect()
    assert [(r.page, r.ord, r.text, r.x0, r.top) for r in chars] == [(0, 0, "o", 0.0, 0.0), (0, 1, "n", 5.0, 0.0), (0, 2, "e", 10.0, 0.0), (1, 0, "t", 0.0, 0.0), (1, 1, "w", 5.0, 0.0), (1, 2, "o", 10.0, 0.0)]

    def half(raw):
        yield (0, ["a"])
        raise KeyError("broken")

    cells = X.decoded(files.where("doc_id = 1"), half, X.CELLS).collect()
    assert [(r.row_idx, r.cells, r.decode_error) for r in cells] == [(None, None, "'broken'")]


TITLE, HEAD = "Part List for: P1", "Operation Sequence\tComponent Item\tQTY"


def sheet(*rows, title=TITLE):
    return "\n".join([title, HEAD, *rows]).encode()


def test_archives_to_part_lists(spark):
    good = {"data/files/PLReport_1.zip": zipped({"x/a.xls": sheet("1\tc\t2"), "b.XLS": sheet("3\td\t4", title="part list for: q")}), "data/files/PLReport_2.zip": zipped({"a.xls": sheet("5\te\t6", "7\t\t8")}), "other.txt": b""}
    bad_reports = {"data/files/PLReport_1.zip": b"junk", "data/files/PLReport_2.zip": zipped({"a.txt": b""}), "data/files/PLReport_3.zip": zipped({"a.xls": b"\xff"})}
    bad_sheets = {"data/files/PLReport_1.zip": zipped({"a.xls": b"\xff", "b.xls": b"", "c.xls": TITLE.encode(), "d.xls": sheet("1\tc\t2"), "e.xls": sheet("1\t\t2")})}
    uploads = [(1, zipped(good)), (2, zipped({"7_1_PRODUCT.ZIP": zipped(good)})), (3, zipped(bad_reports)), (4, zipped(bad_sheets)), (5, b"junk"), (6, None), (7, zipped({"x": b""})), (8, zipped(good))]
    parents = spark.createDataFrame([(1, "Q"), (2, "p1"), (3, "P1"), (8, None)], "doc_id long, parent string")
    rows, counts, errors = P.archive_part_lists(spark.createDataFrame(uploads, "doc_id long, content binary"), parents, X.separated_cells())
    found = {}
    for r in rows.orderBy("doc_id", "row_no").collect():
        found.setdefault(r.doc_id, []).append((r.row_no, r.part_no, r.component_item, r.qty, r.matched))
    plain = [(1, "P1", "c", "2", False), (2, "q", "d", "4", False), (3, "P1", "e", "6", False)]
    assert found == {1: [(1, "q", "d", "4", True), (2, "P1", "c", "2", False), (3, "P1", "e", "6", False)], 2: [(1, "P1", "c", "2", True), (2, "P1", "e", "6", True), (3, "q", "d", "4", False)], 8: plain}
    assert sorted(map(tuple, counts.collect())) == [(1, 2, 3, 1), (2, 2, 3, 2), (8, 2, 3, 0)]
    assert sorted(map(tuple, errors.collect()), key=str) == sorted(
        [
            (3, None, "not a ZIP: data/files/PLReport_1.zip"), (3, None, "no sheet in data/files/PLReport_2.zip"), (4, "PLReport_1.zip/a.xls", "unreadable sheet"), (4, "PLReport_1.zip/b.xls", "no part number"),
            (4, "PLReport_1.zip/c.xls", "no header"), (4, "PLReport_1.zip/e.xls", "no rows"), (5, None, "not a ZIP"), (6, None, "not a ZIP"), (7, None, "no report"),
        ],
        key=str,
    )


def test_budget_errors_end_an_upload_at_once(spark):
    report = zipped({"a.xls": sheet("1\tc\t2")})
    upload = zipped({"data/files/PLReport_1.zip": b"junk", "data/files/PLReport_2.zip": report})
    rows = archive_sheets(spark.createDataFrame([(1, upload)], "doc_id long, content binary"), Budget(bytes=len(report) + 10)).collect()
    assert [(r.payload, r.error) for r in rows] == [(None, "too many bytes")]


@pytest.mark.parametrize(("charset", "mark"), [("utf-8", True), ("windows-1255", False)])
def test_one_file_per_document(spark, tmp_path, charset, mark):
    heads = spark.createDataFrame([(1, "77", "Zoë", None), (2, "78", "x", "y"), (3, "79", "none", "z")], "doc_id long, number string, customer string, buyer string")
    items = spark.createDataFrame([(1, 2, "b", 1495.25, " - "), (1, 1, "a", 36.0, "R1"), (2, 1, "א\"€中", 1.0, None)], "doc_id long, line_ord int, sku string, qty double, revision string")
    write_documents(O.export_lines(heads, items), f"{tmp_path}/out", "doc_id", ["line_no"], charset=charset, mark=mark)
    files = {p.parent.name: p.read_bytes() for p in tmp_path.glob("out/*/part-*")}
    columns = "supplier item\trequired quantity\trevision\r\n"
    want = {
        "doc_id=1": f"order no: 77\ncustomer: Zoë\nto: \n\n{columns}a\t36.0\tR1\r\nb\t1495.25\t\r\n",
        "doc_id=2": f'order no: 78\ncustomer: x\nto: y\n\n{columns}א"€中\t1.0\t\r\n',
    }
    assert files == {k: (("\ufeff" if mark else "") + v).encode(charset, "replace") for k, v in want.items()}


def test_inspection_body(spark):
    rows = spark.createDataFrame([(1, 2, 'a "b"', None), (1, 1, "x,y", "±1")], "doc_id long, balloon long, text string, tolerance string")
    body = csv_body(rows, "doc_id", "balloon", {"balloon": "no", "text": 'the "text"', "tolerance": "tolerance", "found": "found"}).first().body
    assert body == '"no","the ""text""","tolerance","found"\r\n"1","x,y","±1",""\r\n"2","a ""b""","",""\r\n'


def test_fonts_from_streams(spark):
    known = hashlib.sha256(b"outline").hexdigest()
    nothing = hashlib.sha256(b"").hexdigest()
    dictionary = spark.createDataFrame([(known, "k"), (nothing, "n")], "hash string, glyph string")
    fonts = [(1, 0, 0, "Type3", [(65, b"outline"), (66, b"other"), (67, None)]), (1, 0, 1, "TrueType", [(65, b"outline")]), (1, 0, 2, "Type3", [(65, b"other")]), (1, 0, 3, "Type3", None)]
    rows = spark.createDataFrame(fonts, "doc_id long, page int, font_id int, subtype string, glyphs array<struct<code int, stream binary>>")
    assert sorted(map(tuple, G.stream_maps(rows, dictionary).collect())) == [(1, 0, 0, 65, "k"), (1, 0, 0, 67, "n")]
    texts = spark.createDataFrame([(x,) for x in ("(cid:300)", "A", "ÿ", "’", "ƒ", "”", "Œ", "œ", "א", "ab", "", None)], "text string")
    assert [r.code for r in G.with_codes(texts, G.named_codes(spark)).collect()] == [300, 65, 255, 144, 134, 186, 234, 156, None, None, None, None]
