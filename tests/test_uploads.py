"""Uploads read whole: the same as scans of tables of cells, without a row for each sheet or cell."""

import random

import pytest
from docloom.plans import part_lists as P
from docloom.plans import queries_files as QF
from docloom.sources import adapters as X
from docloom.sources import archive as A
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CELLS = ["x", "", None, "Part List for: P1, rev", "part\n List  FOR : p2 x", "Part List for:", "Part List for: ,part list for: p3", "part list for q", "a: b", "Part List for:: r", " Part List for:\tp4\x0b", "a part list for:p5:6"]
HEADS = ["QTY", " qty\t", "qty 2", "Component\r\nItem", "component item", "operation  sequence ", "Operation Sequence", None, "=c", "1", ""]


@pytest.mark.parametrize("name", ["archive_part_list", "archive_part_errors", "archive_part_counts"])
def test_uploads_are_read_in_one_place(spark, monkeypatch, name):
    def kept(df, name):
        raise AssertionError(f"{name} was written")

    monkeypatch.setattr(P, "kept", kept)
    plan = QF.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "UDTF" not in plan


def odd_grids(n):
    pick = random.Random(5)
    for i in range(n):
        rows = [[pick.choice(CELLS if pick.random() < 0.5 else HEADS) for _ in range(pick.randint(0, 4))] for _ in range(pick.randint(0, 3))]
        if pick.random() < 0.8:
            rows.append(["Part List for: P9"])
        if pick.random() < 0.8:
            rows.append(pick.sample([HEADS[pick.randint(0, 1)], HEADS[pick.randint(3, 4)], HEADS[pick.randint(5, 6)], pick.choice(HEADS)], 4))
        rows += [[pick.choice(["1", "=c", "", None, "qty"]) for _ in range(pick.randint(0, 5))] for _ in range(pick.randint(0, 4))]
        grid = list(enumerate(rows))
        if pick.random() < 0.2:
            pick.shuffle(grid)
        yield i, grid


def test_a_sheet_is_read_as_tables_of_cells_are(spark):
    grids = dict(odd_grids(600))
    cells = spark.createDataFrame([(i, 0, n, row) for i, grid in grids.items() for n, row in grid], "doc_id long, file_ord int, row_idx int, cells array<string>")
    found = P.scanned(cells).persist()
    errors = {r.doc_id: r.error for r in P.errors(found).collect()}
    rows = {}
    for r in P.components(found).orderBy("doc_id", "row_idx").collect():
        rows.setdefault(r.doc_id, []).append((r.operation_sequence, r.component_item, r.qty))
    parts = {r.doc_id: r.part_no for r in found.select("doc_id", "part_no").distinct().collect()}
    for i, grid in grids.items():
        if grid:
            sheet = P.read_sheet(grid)
            assert (sheet.part_no, sheet.rows, sheet.error) == (parts[i], rows.get(i, []), errors.get(i)), grid
    assert set(errors.values()) == {"no part number", "no header", "no rows"} and len(rows) > 100
    assert P.read_sheet([]).error == "no part number"


def test_sheets_of_lines_with_nulls_have_no_rows():
    assert [P.read_sheet([(i, line.split("\t")) for i, line in enumerate(QF._grid_text(*line).decode().split("\n"))]).error for line in ((None, 1), (5, None), (41, None), (5, 1))] == ["no rows", "no rows", "no part number", None]


def test_many_rows_of_uploads_go_on_in_parts(spark):
    sheet = "\n".join(["Part List for: p", "qty\tcomponent item\toperation sequence", *[f"1\tc{i}\t{i}" for i in range(30)]]).encode()
    content = A.stored_zip([("data/files/PLReport_1.zip", A.stored_zip([("a.xls", sheet), ("b.xls", sheet.replace(b" p\n", b" Q\n"))]))])
    uploads = spark.range(5).select(F.col("id").alias("doc_id"), F.lit(content).alias("content"), F.when(F.col("id") % 2 == 0, "q").alias("parent"))
    rows = lambda upload: [(matched, cells[1]) for matched, _, sheet in upload.sheets for cells in sheet.rows]
    for at_once in (1, 100, 1000):
        got = P._of_uploads(uploads, rows, "matched boolean, item string", X.separated_cells(), A.Budget(), at_once).collect()
        assert len(got) == 300 and {r.doc_id for r in got if r.matched} == {0, 2, 4} and sum(r.matched for r in got) == 90
    first = P.upload_rows(uploads, X.separated_cells()).where("doc_id = 2 AND row_no = 1").first()
    assert (first.part_no, first.component_item, first.operation_sequence, first.matched) == ("Q", "c0", "0", True)
    failing = P.upload_errors(uploads, lambda raw: [][1], A.Budget())
    assert {(r.file, r.error) for r in failing.collect()} == {("PLReport_1.zip/a.xls", "list index out of range"), ("PLReport_1.zip/b.xls", "list index out of range")}
