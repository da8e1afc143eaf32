"""Part lists: grids of cells to component rows, the parent part's first, whole archives or none."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES, cell_at, header_cell
from ..sources.adapters import Decoder
from ..sources.archive import BadArchive, Budget, sheets_of
from ..sources.kept import kept

#: Fixed column names of a part list, as normalised.
COLUMNS = ("operation sequence", "component item", "qty")
#: Fixed words of a title, as normalised; the part number follows the colon.
TITLE = "part list for"
FILE = ["doc_id", "file_ord"]


def titled(cell: Column) -> Column:
    """The part number that a cell names behind TITLE and a colon, up to a space or comma; NULL without one."""
    after = F.slice(F.split(F.regexp_replace(F.trim(F.regexp_replace(cell, r"(?U)\s+", " ")), " ?: ?", ":"), f"(?i){TITLE}:", -1), 2, 1 << 30)
    part = F.try_element_at(F.filter(F.transform(after, lambda x: F.regexp_replace(x, "[ ,].*$", "")), lambda x: x != ""), F.lit(1))
    return F.when(cell.contains(":"), part)  # most cells have no colon and need no pattern


def scanned(cells: DataFrame) -> DataFrame:
    """``cells`` (doc_id, file_ord, row_idx, cells) with part_no, pn_row, header_row and at: the columns' places.

    The title is the first row with "Part List for: <part>"; the header is the first row from there on (the title
    itself may be it) whose normalised cells have all three names.
    """
    title = F.try_element_at(F.filter(F.transform("cells", titled), lambda x: x.isNotNull()), F.lit(1))
    names = F.transform("cells", header_cell)
    # A row without the one-word names anywhere in its cells is no header; the others are normalised.
    holds = lambda c: F.exists("cells", lambda x: F.lower(x).contains(c))
    at = F.when(reduce(Column.__and__, [holds(c) for c in COLUMNS if " " not in c]), F.array(*[F.array_position(names, c) for c in COLUMNS])).otherwise(F.array(*[F.lit(0).cast("long") for _ in COLUMNS]))
    found = cells.withColumn("_title", title).withColumn("_at", at)
    whole = Window.partitionBy(*FILE)
    found = found.withColumn("pn_row", F.min(F.when(F.col("_title").isNotNull(), F.col("row_idx"))).over(whole))
    is_header = (F.col("row_idx") >= F.col("pn_row")) & F.forall("_at", lambda p: p > 0)
    found = found.withColumn("header_row", F.min(F.when(is_header, F.col("row_idx"))).over(whole))
    first = lambda c, row: F.max(F.when(F.col("row_idx") == F.col(row), F.col(c))).over(whole)
    return found.withColumn("part_no", first("_title", "pn_row")).withColumn("at", first("_at", "header_row")).drop("_title", "_at")


def components(found: DataFrame) -> DataFrame:
    """Rows below the header with a component: doc_id, file_ord, row_idx, part_no and the three cells as they are."""
    cell = [cell_at(F.col("cells"), F.try_element_at("at", F.lit(i + 1)) - 1) for i in range(3)]
    rows = found.where(F.col("row_idx") > F.col("header_row"))
    rows = rows.select(*FILE, "row_idx", "part_no", cell[0].alias("operation_sequence"), cell[1].alias("component_item"), cell[2].alias("qty"))
    return rows.where("component_item <> ''")


def errors(found: DataFrame) -> DataFrame:
    """doc_id, file_ord, error of files without a title, without a header or without a component row."""
    component = cell_at(F.col("cells"), F.try_element_at("at", F.lit(2)) - 1) != ""
    files = found.groupBy(*FILE).agg(F.min("pn_row").alias("pn"), F.min("header_row").alias("h"), F.count_if((F.col("row_idx") > F.col("header_row")) & component).alias("n"))
    error = F.when(F.col("pn").isNull(), "no part number").when(F.col("h").isNull(), "no header").when(F.col("n") == 0, "no rows")
    return files.select(*FILE, error.alias("error")).where("error IS NOT NULL")


def _listed(found: DataFrame, bad: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of the scanned files of archives that aren't in ``bad``."""
    good = found.join(bad.select("doc_id").distinct(), "doc_id", "left_anti").join(parents, "doc_id", "left")
    matched = F.coalesce((F.upper("part_no") == F.upper("parent")) & (F.col("parent") != ""), F.lit(False))
    good = good.withColumn("matched", matched)
    counts = good.groupBy("doc_id").agg(F.count_distinct("file_ord").alias("n_files"), F.count_distinct(F.when(F.col("matched"), F.col("file_ord"))).alias("n_matched"))
    rows = components(good).join(good.select(*FILE, "matched").distinct(), FILE)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("matched"), "file_ord", "row_idx")).cast("long")
    return rows.select("doc_id", number.alias("row_no"), "part_no", "operation_sequence", "component_item", "qty", "matched"), counts


def part_list(cells: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, counts, errors) of archives; ``parents`` has doc_id and parent. An archive with an error gives no rows.

    Files of the parent part (in any case; a blank parent is none's) come first, both halves in file order. The scanned
    cells are written once in the shared folder: errors, counts and rows read them.
    """
    found = kept(scanned(cells), "part-list-scan")
    bad = errors(found)
    rows, counts = _listed(found, bad, parents)
    return rows, counts, bad


_WHITE, _TITLE = re.compile(f"[{re.escape(SPACES)}]+"), re.compile(f"(?ai){TITLE}:")
#: White space that squeezing would change.
_ODD = re.compile(f"[{re.escape(SPACES.replace(' ', ''))}]|  ")
_SINGLE = [c for c in COLUMNS if " " not in c]


def _titled(cell: str) -> str | None:
    """``titled`` of a cell with a colon."""
    if _ODD.search(cell):
        cell = _WHITE.sub(" ", cell)
    for part in _TITLE.split(cell.strip(" ").replace(" :", ":").replace(": ", ":"))[1:]:
        if found := part.partition(",")[0].partition(" ")[0]:
            return found
    return None


@lru_cache(1 << 12)
def _places(cells: tuple[str | None, ...]) -> list[int] | None:
    """Where a header's columns are, None for a row that is no header."""
    if all(any(c and name in c.lower() for c in cells) for name in _SINGLE):
        names = [_WHITE.sub(" ", c or "").strip(SPACES).lower() for c in cells]
        if all(c in names for c in COLUMNS):
            return [names.index(c) for c in COLUMNS]
    return None


class Sheet(NamedTuple):
    """A sheet as read: its part number, its component rows (the three cells), and what is wrong with it."""

    part_no: str | None
    rows: list[tuple[str, str, str]]
    error: str | None


def read_sheet(grid: list[tuple[int | None, list[str | None] | None]]) -> Sheet:
    """What ``scanned``, ``components`` and ``errors`` find in the rows (row_idx, cells) of one sheet."""
    part_no, at, found, last = None, None, [], None
    for ordinal, cells in grid:
        if last is not None and (ordinal or 0) < last:
            return read_sheet(sorted(((n or 0, x) for n, x in grid), key=lambda row: row[0]))
        last = ordinal or 0
        if not cells:
            continue
        if at is not None:
            n, (a, b, c) = len(cells), at
            if b < n and cells[b]:
                found.append((a < n and cells[a] or "", cells[b], c < n and cells[c] or ""))
            continue
        if part_no is None:
            for cell in cells:
                if cell and ":" in cell and (part_no := _titled(cell)):
                    break
        if part_no is not None:
            at = _places(tuple(cells))
    error = "no part number" if part_no is None else "no header" if at is None else None if found else "no rows"
    return Sheet(part_no, found, error)


class Upload(NamedTuple):
    """An upload as read: its errors (file, error), or else its sheets with their reports, those of the parent part first."""

    errors: list[tuple[str | None, str]]
    sheets: list[tuple[bool, str, Sheet]]


def read_upload(raw: bytes | None, parent: str | None, decoder: Decoder, budget: Budget = Budget()) -> Upload:
    """An upload's sheets, or all errors of the first stage that has any: its archives, or its sheets, decoded and scanned."""
    try:
        files = sheets_of(raw or b"", budget)
    except BadArchive as error:
        return Upload([(None, message) for message in error.messages], [])
    except ValueError as error:
        return Upload([(None, str(error))], [])
    errors, sheets, wanted = [], [], (parent or "").upper()
    for report, name, payload in files:
        try:
            grid = [tuple(row) for row in decoder(payload)]
        except Exception as failed:  # a bad file never fails the job
            sheet = Sheet(None, [], str(failed) or type(failed).__name__)
        else:
            sheet = read_sheet(grid)
        if sheet.error is not None:
            errors.append((f"{report.rpartition('/')[2]}/{name.rpartition('/')[2]}", sheet.error))
        elif not errors:
            sheets.append((wanted != "" and sheet.part_no.upper() == wanted, report, sheet))
    return Upload(errors, [] if errors else sorted(sheets, key=lambda x: not x[0]))


def _of_uploads(uploads: DataFrame, rows: Callable[[Upload], Iterable[tuple]], schema: str, decoder: Decoder, budget: Budget, at_once: int = 20_000) -> DataFrame:
    """doc_id and the ``rows`` of each upload (doc_id, content, parent), at most so many and those of one upload at once."""
    kind = dict(uploads.dtypes)["doc_id"]
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [pa.field(name, types[t]) for name, t in (c.split() for c in schema.split(", "))]

    def made(doc_ids: pa.Array, at: list[int], found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [[] for _ in fields]
        return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(at, pa.int64())), *[pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]], ["doc_id", *[f.name for f in fields]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, contents, parents = (batch.column(c) for c in ("doc_id", "content", "parent"))
            at, found = [], []
            for i, parent in enumerate(parents.to_pylist()):
                own = list(rows(read_upload(contents[i].as_py(), parent, decoder, budget)))
                at += [i] * len(own)
                found += own
                if len(found) >= at_once:
                    yield made(doc_ids, at, found)
                    at, found = [], []
            yield made(doc_ids, at, found)

    return uploads.select("doc_id", "content", F.col("parent").cast("string").alias("parent")).mapInArrow(read, f"doc_id {kind}, {schema}")


def upload_rows(uploads: DataFrame, decoder: Decoder, budget: Budget = Budget()) -> DataFrame:
    """doc_id, row_no, part_no, the three cells and matched of ``uploads`` (doc_id, content, parent), the parent part's files first."""

    def rows(upload: Upload) -> list[tuple]:
        every = chain.from_iterable(((sheet.part_no, *cells, matched) for cells in sheet.rows) for matched, _, sheet in upload.sheets)
        return [(n, *row) for n, row in enumerate(every, 1)]

    return _of_uploads(uploads, rows, "row_no long, part_no string, operation_sequence string, component_item string, qty string, matched boolean", decoder, budget)


def upload_counts(uploads: DataFrame, decoder: Decoder, budget: Budget = Budget()) -> DataFrame:
    """doc_id, n_reports, n_files (sheets), n_matched of ``uploads`` without an error."""
    counts = lambda upload: [(len({report for _, report, _ in upload.sheets}), len(upload.sheets), sum(matched for matched, _, _ in upload.sheets))] if upload.sheets else []
    return _of_uploads(uploads, counts, "n_reports long, n_files long, n_matched long", decoder, budget)


def upload_errors(uploads: DataFrame, decoder: Decoder, budget: Budget = Budget()) -> DataFrame:
    """doc_id, file (report/sheet, NULL for the archives' errors, which name their report), error of ``uploads``."""
    return _of_uploads(uploads, lambda upload: upload.errors, "file string, error string", decoder, budget)


def archive_part_lists(uploads: DataFrame, parents: DataFrame, decoder: Decoder, budget: Budget = Budget()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, counts, errors) from uploads (doc_id, content) to numbered component rows, the parent part's files first.

    ``decoder`` turns a sheet's bytes into CELLS; ``parents`` has doc_id and parent, for instance the first parts of the quotations; a
    blank parent is none's. An upload fails as a whole, with all errors of the first stage that has any: first its archives (a bad
    report doesn't hide another), then its sheets, read and scanned (a bad sheet doesn't hide another).
    Each upload is opened, decoded and scanned in one place, so that no sheet or cell is a row; the three read the uploads anew.
    """
    asked = uploads.join(parents.select("doc_id", "parent"), "doc_id", "left")
    return upload_rows(asked, decoder, budget), upload_counts(asked, decoder, budget), upload_errors(asked, decoder, budget)
