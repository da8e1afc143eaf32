"""Queries over part list grids and archives made of line items, with oracles from the same line items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators.pages import by_groups
from ..sinks import tsv_body
from ..sources import archive as A
from ..sources.derived import LINES_SQL, relation
from . import part_lists as P


def _cells(spark, sf):
    """A grid per line item: blank rows, a title, a header in one of three column orders, up to three components.

    Some have no title or header, some components are blank; an order is an archive.
    """
    li = relation(spark, sf, LINES_SQL)
    blank = F.array(F.lit(""), F.lit("x"))
    title = F.array(F.lit(""), F.concat(F.lit("PART  list for: P"), F.col("part") % 50, F.lit(", rev A")))
    names = [F.lit("Operation\r\nSequence"), F.lit(" Component  Item "), F.lit("Qty")]
    heads = F.array(*[F.array(*[names[(i + k) % 3] for i in range(3)], F.lit("note")) for k in range(3)])
    turn = (F.col("part") % 3).cast("int")

    def row(k):
        item = F.when((F.col("part") + k) % 7 == 0, "").otherwise(F.concat(F.lit("=C-"), F.col("part"), F.lit("-"), k))
        values = [(k * 10).cast("string"), item, F.col("q").cast("string")]
        return F.element_at(F.array(*[F.array(*[values[(i + t) % 3] for i in range(3)]) for t in range(3)]), turn + 1)

    def when(condition, cells):
        return F.when(condition, F.array(cells)).otherwise(F.array().cast("array<array<string>>"))

    data = F.transform(F.sequence(F.lit(1), F.col("q") % 3 + 1), row)
    grid = F.concat(when(F.col("part") % 3 == 0, blank), when(F.col("part") % 41 != 0, title), when(F.col("part") % 2 == 0, blank), when(F.col("part") % 23 != 0, F.element_at(heads, turn + 1)), data)
    return li.select("doc_id", F.col("ord").alias("file_ord"), F.posexplode(grid).alias("row_idx", "cells"))


def _parents(spark, sf):
    li = relation(spark, sf, LINES_SQL)
    return li.groupBy("doc_id").agg(F.min_by(F.concat(F.lit("p"), F.col("part") % 50), "ord").alias("parent"))


def plr_header_scan(spark, sf):
    return P.scanned(_cells(spark, sf)).groupBy("doc_id", "file_ord").agg(F.max("part_no").alias("part_no"), F.coalesce(F.min("pn_row"), F.lit(-1)).alias("pn_row"), F.coalesce(F.min("header_row"), F.lit(-1)).alias("header_row"))


def plr_rows(spark, sf):
    return P.components(P.scanned(_cells(spark, sf))).select("doc_id", "file_ord", "part_no", "operation_sequence", "component_item", "qty")


def plr_parent_first(spark, sf):
    return P.part_list(_cells(spark, sf), _parents(spark, sf))[0]


def plr_counts(spark, sf):
    return P.part_list(_cells(spark, sf), _parents(spark, sf))[1]


def plr_errors(spark, sf):
    return P.errors(P.scanned(_cells(spark, sf)))


def plr_export(spark, sf):
    rows = P.part_list(_cells(spark, sf), _parents(spark, sf))[0]
    return tsv_body(rows, "doc_id", "row_no", {"row_no": "Row", "operation_sequence": "Operation Sequence", "component_item": "Component Item", "qty": "QTY"}, safe=True)


def path_filter(spark, sf):
    li = relation(spark, sf, LINES_SQL)
    path = F.concat(
        F.element_at(F.array(F.lit("././"), F.lit("./"), F.lit(""), F.lit("")), (F.col("part") % 4 + 1).cast("int")), F.when(F.col("supp") % 3 == 0, "Data\\files\\").otherwise("data/files/"),
        F.when(F.col("q") % 2 == 0, "PLReport").otherwise("Other"), F.col("ord").cast("string"), F.when(F.col("q") % 5 == 0, ".txt").otherwise(".ZIP"),
    )
    return li.select("doc_id", "ord", A.normal_path(path).alias("path"), A.is_report(path).alias("report"))


def budget_running(spark, sf):
    li = relation(spark, sf, LINES_SQL).select("doc_id", F.col("ord").alias("entry_ord"), (F.col("q") * 1000).cast("long").alias("size"))
    return A.within_budget(li, A.Budget(all_members=6, bytes=120_000))


def _uploads(spark, sf):
    """A ZIP of report ZIPs per order, wrapped once more for even orders; some broken, some without a sheet."""

    def build(rows: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        doc_ids, ords, parts, qs = (rows[c].tolist() for c in ("doc_id", "ord", "part", "q"))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            doc_id = doc_ids[a]
            if doc_id % 13 == 0:
                out.append((doc_id, b"no archive"))
                continue
            members = []
            for ord_, part, q in zip(ords[a:b], parts[a:b], qs[a:b], strict=True):
                report = [("readme.txt", b"x")]
                if doc_id % 17:
                    report.append(("a.XLS", str(part).encode()))
                if q % 2 == 0:
                    report.append(("b.xls", str(q).encode()))
                members += [(f"{'./' if q % 3 == 0 else ''}data/files/PLReport{ord_}.zip", A.stored_zip(report)), (f"data/other{ord_}.zip", b"y")]
            content = A.stored_zip(members)
            out.append((doc_id, A.stored_zip([("77_1_product.zip", content)]) if doc_id % 2 == 0 else content))
        return pd.DataFrame(out, columns=["doc_id", "content"])

    return by_groups(relation(spark, sf, LINES_SQL).select("doc_id", "ord", "part", "q"), ["doc_id"], ["ord"], build, "doc_id long, content binary")


def archive_sheets(spark, sf):
    found = A.archive_sheets(_uploads(spark, sf)).where("error IS NULL")
    return found.select("doc_id", F.col("file_ord").cast("long").alias("file_ord"), "report", "sheet", F.decode("payload", "utf-8").alias("payload"))


def archive_errors(spark, sf):
    return A.archive_sheets(_uploads(spark, sf)).where("error IS NOT NULL").select("doc_id", F.regexp_extract("error", "^(not a ZIP|no sheet)", 1).alias("error")).distinct()


QUERIES = {f.__name__: f for f in (plr_header_scan, plr_rows, plr_parent_first, plr_counts, plr_errors, plr_export, path_filter, budget_running, archive_sheets, archive_errors)}

_P = f"""
WITH li AS ({LINES_SQL}), f AS (
  SELECT *, part % 41 <> 0 AS titled, part % 41 <> 0 AND part % 23 <> 0 AS headed, CASE WHEN part % 41 <> 0 THEN 'P' || (part % 50) END AS pn,
    CASE WHEN part % 41 <> 0 THEN CASE WHEN part % 3 = 0 THEN 1 ELSE 0 END ELSE -1 END AS pn_row FROM li
), data AS (
  SELECT f.*, k, '=C-' || part || '-' || k AS item FROM f CROSS JOIN (VALUES (1), (2), (3)) AS t(k) WHERE headed AND k <= q % 3 + 1 AND (part + k) % 7 <> 0
), err AS (
  SELECT doc_id, ord AS file_ord, CASE WHEN NOT titled THEN 'no part number' WHEN NOT headed THEN 'no header' WHEN NOT EXISTS (SELECT 1 FROM data d WHERE d.doc_id = f.doc_id AND d.ord = f.ord) THEN 'no rows' END AS error FROM f
), bad AS (
  SELECT DISTINCT doc_id FROM err WHERE error IS NOT NULL
), par AS (
  SELECT doc_id, arg_min(part % 50, ord) AS parent FROM li GROUP BY doc_id
), fin AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY (part % 50 = parent) DESC, ord, k) AS row_no, pn AS part_no, (10 * k)::VARCHAR AS operation_sequence, item AS component_item, q::VARCHAR AS qty, part % 50 = parent AS matched
  FROM data JOIN par USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM bad)
)
"""
_Z = f"WITH li AS ({LINES_SQL}), s AS (SELECT doc_id, ord, 'a.XLS' AS sheet, part::VARCHAR AS payload FROM li WHERE doc_id % 17 <> 0 UNION ALL SELECT doc_id, ord, 'b.xls', q::VARCHAR FROM li WHERE q % 2 = 0)"

ORACLES = {
    "plr_header_scan": _P + "SELECT doc_id, ord AS file_ord, pn AS part_no, pn_row, CASE WHEN headed THEN pn_row + 1 + CASE WHEN part % 2 = 0 THEN 1 ELSE 0 END ELSE -1 END AS header_row FROM f",
    "plr_rows": _P + "SELECT doc_id, ord AS file_ord, pn AS part_no, (10 * k)::VARCHAR AS operation_sequence, item AS component_item, q::VARCHAR AS qty FROM data",
    "plr_parent_first": _P + "SELECT * FROM fin",
    "plr_counts": _P + "SELECT doc_id, count(*) AS n_files, count(*) FILTER (part % 50 = parent) AS n_matched FROM li JOIN par USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM bad) GROUP BY doc_id",
    "plr_errors": _P + "SELECT * FROM err WHERE error IS NOT NULL",
    "plr_export": _P + r"""SELECT doc_id, 'Row' || chr(9) || 'Operation Sequence' || chr(9) || 'Component Item' || chr(9) || 'QTY' || chr(13) || chr(10) ||
        string_agg(concat_ws(chr(9), row_no, operation_sequence, '''' || component_item, qty) || chr(13) || chr(10), '' ORDER BY row_no) AS body FROM fin GROUP BY doc_id""",
    "path_filter": f"""SELECT doc_id, ord, CASE WHEN supp % 3 = 0 THEN 'Data/files/' ELSE 'data/files/' END || CASE WHEN q % 2 = 0 THEN 'PLReport' ELSE 'Other' END || ord || CASE WHEN q % 5 = 0 THEN '.txt' ELSE '.ZIP' END AS path,
        q % 2 = 0 AND q % 5 <> 0 AS report FROM ({LINES_SQL})""",
    "budget_running": f"SELECT doc_id, ord AS entry_ord, (q * 1000)::BIGINT AS size, sum(q * 1000) OVER w <= 120000 AND count(*) OVER w <= 6 AS ok FROM ({LINES_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY ord)",
    "archive_sheets": _Z + """ SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, sheet) - 1 AS file_ord, 'data/files/PLReport' || ord || '.zip' AS report, sheet, payload
        FROM s WHERE doc_id % 13 <> 0 AND doc_id NOT IN (SELECT doc_id FROM li WHERE doc_id % 17 = 0 AND q % 2 <> 0)""",
    "archive_errors": f"""SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'not a ZIP' ELSE 'no sheet' END AS error FROM ({LINES_SQL}) WHERE doc_id % 13 = 0 OR doc_id % 17 = 0 GROUP BY doc_id
        HAVING doc_id % 13 = 0 OR bool_or(q % 2 <> 0)""",
}
