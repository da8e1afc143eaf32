"""Queries over spans of drawings laid out from line items, with oracles by windows and recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import drawing as D
from ..functions.geometry import border_label, title_block
from ..operators import spans as S
from ..sinks import csv_body
from ..sources.derived import LINES_SQL, relation
from . import drawings as P

_TEXTS = ["10.5", "±0.1", "R5", "3.2 ±0.05", "Ø 12", "45°", "M8", "25", "NOTES:", "1. Deburr", "X.XX", "0.01", "SECRET 12.5", "A", "12.5 +0.1/-0.2", "2) Clean", "General tolerances", "ANGLES", "7.25 TYP", "1/4-20 UNC"]
_CASE = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TEXTS))

#: Spans on one page of 1000 by 800 for each order; boxes lie on whole and quarter points.
SPANS_SQL = f"""
SELECT doc_id, CAST(ord % 2 AS INT) AS page, ord, CASE (part * 3 + supp * 7 + ord) % 20 {_CASE} END AS text,
  CAST((part * 37 + ord * 11) % 950 AS DOUBLE) AS x0, CAST((supp * 53 + part * 5) % 760 AS DOUBLE) AS y0,
  CAST((part * 37 + ord * 11) % 950 + 20 + part % 9 AS DOUBLE) AS x1, CAST((supp * 53 + part * 5) % 760 + 8 + q % 3 * 0.5 AS DOUBLE) AS y1, 8.0 AS size
FROM ({LINES_SQL}) AS li
"""
SIZES_SQL = "SELECT o_orderkey AS doc_id, page, 1000.0 AS w, CAST(800.0 + page AS DOUBLE) AS h FROM orders CROSS JOIN (SELECT 0 AS page UNION ALL SELECT 1 AS page) AS p "

#: Shapes drawn on the same pages: some with corners the wrong way round, thin lines, dots, and the page's frame.
DRAWINGS_SQL = f"""
SELECT doc_id, page, ord, CASE WHEN ord % 3 = 0 THEN x1 + 15 WHEN ord % 11 = 5 THEN 10.0 ELSE x0 - 15 END AS x0, CASE WHEN ord % 11 = 5 THEN 5.0 ELSE y0 + 2 END AS y0,
  CASE WHEN ord % 3 = 0 THEN x0 - 15 WHEN ord % 7 = 4 THEN x0 - 14.75 WHEN ord % 11 = 5 THEN 980.0 ELSE x1 + 60 END AS x1,
  CASE WHEN ord % 7 = 4 THEN y0 + 2.25 WHEN ord % 5 = 2 THEN y0 + 2 WHEN ord % 11 = 5 THEN 790.0 ELSE y0 - 40 END AS y1
FROM ({SPANS_SQL}) AS sp
"""
#: Spans with a tolerance table beside each fifth order's: a header low on the page, and rows of a label and values.
TABLED_SQL = f"""
SELECT * FROM ({SPANS_SQL}) AS sp
UNION ALL SELECT doc_id, 0, 500, 'General tolerances', 300.0, 600.0, 380.0, 608.0, 8.0 FROM (SELECT DISTINCT doc_id FROM ({SPANS_SQL}) AS sq) AS d WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 0, 510 + ord * 10, CASE ord % 3 WHEN 0 THEN 'X.XX' WHEN 1 THEN 'ANGLES' ELSE 'A' END, 300.0, 610.0 + 12 * ord, 325.0, 618.0 + 12 * ord, 8.0 FROM ({SPANS_SQL}) AS sr WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 0, 511 + ord * 10, CASE part % 3 WHEN 0 THEN '±0.1' WHEN 1 THEN '25' ELSE '0.01' END, 320.0 + supp % 4 * 5, 611.0 + 12 * ord, 350.0, 619.0 + 12 * ord, 8.0
  FROM (SELECT s.doc_id, s.ord, li.part, li.supp FROM ({SPANS_SQL}) AS s JOIN ({LINES_SQL}) AS li ON li.doc_id = s.doc_id AND li.ord = s.ord) AS st WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 0, 512 + ord * 10, '10.5', 360.0, 609.0 + 12 * ord, 390.0, 617.0 + 12 * ord, 8.0 FROM ({SPANS_SQL}) AS su WHERE doc_id % 5 = 0 AND ord % 2 = 0
"""
#: The place of each span in nested pages: its block, the block's kind, its line, and its text with blanks around it or blank.
NESTED_SQL = f"""
SELECT doc_id, page, CAST(ord % 3 AS INT) AS b, CASE WHEN (doc_id + ord % 3) % 5 = 0 THEN 1 ELSE 0 END AS kind, CAST(floor(ord / 3.0) % 2 AS INT) AS l, ord,
  CASE WHEN ord % 11 = 3 THEN '  ' ELSE concat(' ', text, CASE WHEN ord % 2 = 0 THEN ' ' ELSE '' END) END AS text, x0, y0, x1, y1, CAST(size AS DOUBLE) AS size
FROM ({SPANS_SQL}) AS sp
"""

#: Whole drawings for the inspection: every span on a line of its own, some with a tolerance table.
SHEETS_SQL = f"""
SELECT * FROM ({TABLED_SQL}) AS ta WHERE ord >= 500
UNION ALL SELECT doc_id, page, ord, text, x0, 30.0 + ord * 62 + y0 % 5 * 4 AS y0, x1, 38.0 + ord * 62 + y0 % 5 * 4 AS y1, 8.0 AS size FROM ({SPANS_SQL}) AS tb
"""
_PREFIXES, _NUMBERS, _UNITS, _TOLERANCES = ["", "R", "Ø ", "M", "#", "DIA ", "SECRET ", "Ra "], ["7", "12", "12.5", "3,25", "1/4-20"], ["", "°", " DEG", " TYP", " x 3", " UNC", " mm"], ["", " ±0.1", " +0.2/-0.1", "±2"]


def _choice(by: str, values: list[str]) -> str:
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(values)) + " END"


#: Texts put together from a prefix, a number, a unit and a tolerance.
GRAMMAR_SQL = f"""
SELECT doc_id, ord, {_choice("part", _PREFIXES)} AS prefix, {_choice("(part * 7 + supp)", _NUMBERS)} AS number, {_choice("(supp * 3 + ord)", _UNITS)} AS unit, {_choice("(q + part * 5)", _TOLERANCES)} AS tol FROM ({LINES_SQL}) AS li
"""

_S = f"""
WITH RECURSIVE spans AS ({SPANS_SQL}), full_spans AS (
  SELECT *, 1000.0 AS w, 800.0 + page AS h, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM spans
), flags AS (
  SELECT *, length(text) = 1 AND (cx < 30 OR cx > 970 OR cy < 0.03 * h OR cy > h - 0.03 * h) AS border, cx >= 620 AND cy >= 0.72 * h AS title FROM full_spans
), head AS (
  SELECT doc_id, page, coalesce(max_by({{'x': x0, 'y': y0}}, ord) FILTER (y0 > 0.5 * h), min_by({{'x': x0, 'y': y0}}, ord)) AS b
  FROM flags WHERE text = 'General tolerances' GROUP BY doc_id, page
), block AS (
  SELECT f.*, b.x AS hx, b.y AS hy, coalesce(y0 >= b.y AND x0 BETWEEN b.x - 60 AND b.x + 200, false) AS in_block FROM flags f LEFT JOIN head USING (doc_id, page)
), rows_ AS (
  SELECT *, sum(CASE WHEN gap > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY cy, ord) AS row_no
  FROM (SELECT *, cy - lag(cy) OVER (PARTITION BY doc_id, page ORDER BY cy, ord) AS gap FROM block WHERE in_block)
), edge AS (
  SELECT doc_id, page, row_no, min_by(x1, (x0, ord)) AS edge FROM rows_ WHERE text IN ('X.XX', 'ANGLES') GROUP BY ALL
), tol AS (
  SELECT r.doc_id, r.page, r.row_no, min_by({{'o': ord, 't': ltrim(text, '±')}}, (x0, ord)) AS v FROM rows_ r JOIN edge USING (doc_id, page, row_no)
  WHERE x0 >= edge AND text IN ('10.5', '±0.1', '25', '0.01') GROUP BY ALL
), rest AS (
  SELECT * FROM block WHERE NOT in_block AND NOT border AND NOT title
), nh AS (
  SELECT doc_id, page, min_by(y1, ord) AS nh FROM rest WHERE text = 'NOTES:' GROUP BY ALL
), below AS (
  SELECT *, max(CASE WHEN y0 - coalesce(prev, nh) > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, ord) AS stop
  FROM (SELECT r.*, nh, lag(y1) OVER (PARTITION BY r.doc_id, r.page ORDER BY y0, x0, ord) AS prev FROM rest r JOIN nh USING (doc_id, page) WHERE y0 >= nh)
), notes AS (
  SELECT doc_id, page, ord, text, x0, y0, x1, y1 FROM below WHERE stop = 0 AND text IN ('1. Deburr', '2) Clean')
), free AS (
  SELECT r.* FROM rest r WHERE NOT EXISTS (SELECT 1 FROM notes n WHERE n.doc_id = r.doc_id AND n.page = r.page AND n.x0 = r.x0 AND n.y0 = r.y0 AND n.x1 = r.x1 AND n.y1 = r.y1)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY cy, x0, ord) AS k FROM free
), walk AS (
  SELECT doc_id, page, k, ord AS first, text AS t, x0 AS a, y0 AS b, x1 AS c, y1 AS d, ord AS at FROM ranked WHERE k = 1
  UNION ALL
  SELECT r.doc_id, r.page, r.k, CASE WHEN m THEN first ELSE ord END, CASE WHEN m THEN t || ' ' || text ELSE text END, CASE WHEN m THEN least(a, x0) ELSE x0 END,
    CASE WHEN m THEN least(b, y0) ELSE y0 END, CASE WHEN m THEN greatest(c, x1) ELSE x1 END, CASE WHEN m THEN greatest(d, y1) ELSE y1 END, ord
  FROM (SELECT r.*, w.first, w.t, w.a, w.b, w.c, w.d, abs(r.cy - (w.b + w.d) / 2) <= 1.5 AND r.x0 - w.c BETWEEN 0 AND 6 AS m FROM walk w JOIN ranked r ON r.doc_id = w.doc_id AND r.page = w.page AND r.k = w.k + 1) AS r
), merged AS (
  SELECT doc_id, page, first AS ord, arg_max(t, k) AS text, arg_max(a, k) AS x0, arg_max(b, k) AS y0, arg_max(c, k) AS x1, arg_max(d, k) AS y1 FROM walk GROUP BY ALL
)
"""


def _spans(spark, sf):
    return relation(spark, sf, SPANS_SQL)


def _full(spark, sf):
    return S.on_pages(_spans(spark, sf), relation(spark, sf, SIZES_SQL))


def _rest(spark, sf):
    every = _full(spark, sf)
    return S.in_tolerance_block(S.filtered(every), S.tolerance_anchor(every)).where("NOT in_block")


def span_filter(spark, sf):
    return _full(spark, sf).select("doc_id", "ord", border_label().alias("border"), title_block().alias("title"))


def tol_header(spark, sf):
    return S.tolerance_anchor(_full(spark, sf))


def _block(spark, sf):
    every = _full(spark, sf)
    return S.in_tolerance_block(every, S.tolerance_anchor(every))


def tol_rows(spark, sf):
    return S.banded_rows(_block(spark, sf).where("in_block")).select("doc_id", "page", "ord", F.col("row_no").cast("long").alias("row_no"))


def tol_items(spark, sf):
    every = S.on_pages(relation(spark, sf, TABLED_SQL), relation(spark, sf, SIZES_SQL))
    block = S.in_tolerance_block(every, S.tolerance_anchor(every)).where("in_block")
    return S.tolerance_items(S.banded_rows(block)).select("doc_id", "page", "ord", "text")


def notes_until_gap(spark, sf):
    return S.notes(_rest(spark, sf)).select("doc_id", "page", "ord", "text")


def _free(spark, sf):
    rest = _rest(spark, sf)
    return S.without_boxes(rest, S.notes(rest).select("doc_id", "page", "x0", "y0", "x1", "y1"))


def bbox_antijoin(spark, sf):
    return _free(spark, sf).groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum("ord").alias("ords"))


def span_merge(spark, sf):
    return S.merged_spans(_free(spark, sf)).select("doc_id", "page", "ord", "text", "x0", "y0", "x1", "y1")


def tol_split(spark, sf):
    nominal, tolerance = D.split_tolerance(F.col("text"))
    return _spans(spark, sf).select("doc_id", "ord", nominal.alias("nominal"), tolerance.alias("tolerance"))


def dim_classify(spark, sf):
    nominal, _ = D.split_tolerance(F.col("text"))
    text = F.col("text")
    return _spans(spark, sf).select("doc_id", "ord", D.stamp(text).alias("stamp"), D.dimension_hint(text).alias("hint"), D.classifiable(nominal).alias("good"), D.dimension_kind(text).alias("kind"))


def dim_grammar(spark, sf):
    """What texts of a grammar are, all its rules at once."""
    text = F.col("text")
    nominal, tolerance = D.split_tolerance(text)
    texts = relation(spark, sf, GRAMMAR_SQL).select("doc_id", "ord", F.concat("prefix", "number", "unit", "tol").alias("text"))
    return texts.select("doc_id", "ord", nominal.alias("nominal"), tolerance.alias("tolerance"), D.stamp(text).alias("stamp"), D.dimension_hint(text).alias("hint"), D.classifiable(nominal).alias("good"), D.dimension_kind(text).alias("kind"))


def inspection_rows(spark, sf):
    """Whole drawings to numbered notes, dimensions and general tolerances."""
    items = P.inspection(relation(spark, sf, SHEETS_SQL), relation(spark, sf, SIZES_SQL))
    return items.select("doc_id", "page", "balloon", "kind", "text", "tolerance")


def pair_distance(spark, sf):
    return S.near_pairs(_spans(spark, sf), 100.0)


def components(spark, sf):
    return S.clustered(_spans(spark, sf), 100.0).select("doc_id", "page", "ord", "cluster")


def centroid(spark, sf):
    items = S.clustered(_spans(spark, sf), 100.0)
    return items.groupBy("doc_id", "page", "cluster").agg(F.round(F.avg((F.col("x0") + F.col("x1")) / 2), 6).alias("mx"), F.round(F.avg((F.col("y0") + F.col("y1")) / 2), 6).alias("my"), F.min("x0").alias("left"), F.max("y1").alias("bottom"))


def inspection_items(spark, sf):
    """Notes, dimensions and general tolerances of all drawings, before numbering, with their texts, tolerances and boxes."""
    items = P.inspection_items(relation(spark, sf, TABLED_SQL), relation(spark, sf, SIZES_SQL))
    return items.select("doc_id", "page", "ord", "kind", "text", "tolerance", "x0", "y0", "x1", "y1")


def clockwise_number(spark, sf):
    items = P.inspection(_spans(spark, sf), relation(spark, sf, SIZES_SQL))
    return items.select("doc_id", "page", "balloon", "kind", "text", "tolerance")


def number_spans(spark, sf):
    """All spans as items: numbered clockwise, clusters first."""
    items = S.clustered(_spans(spark, sf), 100.0)
    return S.numbered(S.on_pages(items, relation(spark, sf, SIZES_SQL)))


def number_clockwise(spark, sf):
    return number_spans(spark, sf).select("doc_id", "page", "ord", "balloon")


def inspection_csv(spark, sf):
    nominal, tolerance = D.split_tolerance(F.col("text"))
    rows = number_spans(spark, sf).select("doc_id", "balloon", nominal.alias("text"), D.dimension_kind(F.col("text")).alias("kind"), tolerance.alias("tolerance"))
    return csv_body(rows, "doc_id", "balloon", P.EXPORT)


def placement_rows(spark, sf):
    return P.balloons(_spans(spark, sf), relation(spark, sf, SIZES_SQL))[1]


def leader_lines(spark, sf):
    items, placed = P.balloons(_spans(spark, sf), relation(spark, sf, SIZES_SQL))
    return S.leader_lines(placed, items)


def span_unnest(spark, sf):
    nested = relation(spark, sf, NESTED_SQL)
    span = F.struct("ord", "text", "x0", "y0", "x1", "y1", "size")
    lines = nested.groupBy("doc_id", "page", "b", "kind", "l").agg(F.struct(F.array_sort(F.collect_list(span)).alias("spans")).alias("line"))
    blocks = lines.groupBy("doc_id", "page", "b", "kind").agg(F.array_sort(F.collect_list(F.struct("l", "line"))).alias("ls"))
    block = F.struct("b", F.struct("kind", F.transform("ls", lambda x: x["line"]).alias("lines")).alias("block"))
    pages = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(block)).alias("bs"))
    return S.span_boxes(pages.select("doc_id", "page", F.transform("bs", lambda x: x["block"]).alias("blocks")))


def _boxes(spark, sf):
    return S.page_boxes(_spans(spark, sf), relation(spark, sf, DRAWINGS_SQL), relation(spark, sf, SIZES_SQL))


def page_boxes(spark, sf):
    return _boxes(spark, sf)


def crossed_texts(spark, sf):
    return S.crossed_texts(_boxes(spark, sf)).select("doc_id", "page", "ord", "n", "area", F.round("nearest", 6).alias("nearest"))


QUERIES = {
    f.__name__: f
    for f in (
        span_filter, tol_header, tol_rows, tol_items, notes_until_gap, bbox_antijoin, span_merge, tol_split, dim_classify, dim_grammar, inspection_rows, pair_distance,
        components, centroid, inspection_items, clockwise_number, number_clockwise, inspection_csv, placement_rows, leader_lines, span_unnest, page_boxes, crossed_texts,
    )
}

#: What each text is, by hand: nominal, tolerance, stamp, hint, good, kind.
_KNOWN = [
    ("10.5", "", 0, 1, 1, "Linear"), ("", "±0.1", 0, 1, 0, "Linear"), ("R5", "", 0, 1, 1, "Radius"), ("3.2", "±0.05", 0, 1, 1, "Linear"), ("Ø 12", "", 0, 1, 1, "Diameter"),
    ("45°", "", 0, 1, 1, "Angle"), ("M8", "", 0, 1, 1, "Thread"), ("25", "", 0, 1, 0, "Linear"), ("NOTES:", "", 0, 0, 0, "Linear"), ("1. Deburr", "", 0, 0, 0, "Linear"),
    ("X.XX", "", 0, 0, 0, "Linear"), ("0.01", "", 0, 1, 1, "Linear"), ("SECRET 12.5", "", 1, 1, 1, "Linear"), ("A", "", 0, 0, 0, "Linear"), ("12.5", "+0.1/-0.2", 0, 1, 1, "Linear"),
    ("2) Clean", "", 0, 0, 0, "Linear"), ("General tolerances", "", 0, 0, 0, "Linear"), ("ANGLES", "", 0, 0, 0, "Linear"), ("7.25 TYP", "", 0, 1, 1, "Linear"), ("1/4-20 UNC", "", 0, 1, 1, "Thread"),
]
_TABLE = "known(text, nominal, tolerance, stamp, hint, good, kind) AS (VALUES " + ", ".join(f"('{t}', '{a}', '{b}', {bool(c)}, {bool(d)}, {bool(e)}, '{k}')" for t, (a, b, c, d, e, k) in zip(_TEXTS, _KNOWN, strict=True)) + ")"
_NEAR = f"""
WITH RECURSIVE s AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM ({SPANS_SQL})), edge AS (
  SELECT a.doc_id, a.page, a.ord AS a, b.ord AS b FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.page = b.page AND (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 <= 10000
), reach AS (
  SELECT doc_id, page, ord AS a, ord AS b FROM s UNION SELECT r.doc_id, r.page, r.a, e.b FROM reach r JOIN edge e ON e.doc_id = r.doc_id AND e.page = r.page AND e.a = r.b
), comp AS (
  SELECT doc_id, page, a AS ord, min(b) AS cluster FROM reach GROUP BY ALL
)
"""

_CLOCK = """, heart AS (
  SELECT doc_id, page, cluster, avg(cx) AS mx, avg(cy) AS my, min(ord) AS head FROM s JOIN comp USING (doc_id, page, ord) GROUP BY ALL
), away AS (
  SELECT s.*, cluster, head, mx - 500 AS px, my - (800 + page) / 2 AS py, cx - mx AS ix, cy - my AS iy FROM s JOIN comp USING (doc_id, page, ord) JOIN heart USING (doc_id, page, cluster)
), turned AS (
  SELECT *, CASE WHEN px = 0 AND py = 0 THEN pi() WHEN atan2(px, -py) < 0 THEN atan2(px, -py) + 2 * pi() ELSE atan2(px, -py) END AS macro,
    CASE WHEN atan2(iy, ix) + pi() / 2 < 0 THEN atan2(iy, ix) + 2.5 * pi() WHEN ix = 0 AND iy = 0 THEN pi() / 2 ELSE atan2(iy, ix) + pi() / 2 END AS micro FROM away
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, round(macro, 9), round(sqrt(px * px + py * py), 6), head, round(micro, 9), round(sqrt(ix * ix + iy * iy), 6), ord) AS balloon FROM turned
)
"""
_NUMBERED = _NEAR.rstrip() + _CLOCK
#: Notes, dimensions and tolerances; what merged texts are isn't known.
_FOUND = """, found AS (
  SELECT doc_id, page, 0 AS src, ord, trim(text) AS text, x0, y0, x1, y1, 'Note' AS kind, '' AS tolerance FROM notes
  UNION ALL SELECT m.doc_id, m.page, 1, m.ord, nominal, x0, y0, x1, y1, kind, tolerance FROM merged m JOIN known USING (text) WHERE NOT stamp AND hint AND good
  UNION ALL SELECT doc_id, page, 2, f.ord, v.t, x0, y0, x1, y1, 'GeneralTolerance', '' FROM tol JOIN full_spans f USING (doc_id, page) WHERE f.ord = v.o
)"""
#: Those of the sheets, linked up to 450 apart; their ord is their place on the page.
_SHEETS = _S.replace(f"spans AS ({SPANS_SQL})", f"{_TABLE}, spans AS ({SHEETS_SQL})", 1).rstrip() + _FOUND + """, s AS (
  SELECT * EXCLUDE (ord), row_number() OVER (PARTITION BY doc_id, page ORDER BY src, ord) AS ord, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM found
), link AS (
  SELECT a.doc_id, a.page, a.ord AS a, b.ord AS b FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.page = b.page AND (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 <= 202500
), reach AS (
  SELECT doc_id, page, ord AS a, ord AS b FROM s UNION SELECT r.doc_id, r.page, r.a, e.b FROM reach r JOIN link e ON e.doc_id = r.doc_id AND e.page = r.page AND e.a = r.b
), comp AS (
  SELECT doc_id, page, a AS ord, min(b) AS cluster FROM reach GROUP BY ALL
)""" + _CLOCK
_BOXES = f"""
WITH shapes AS (
  SELECT doc_id, page, ord, least(x0, x1) AS a, least(y0, y1) AS b, greatest(x0, x1) AS c, greatest(y0, y1) AS d FROM ({DRAWINGS_SQL})
), boxes AS (
  SELECT doc_id, page, 'text' AS kind, ord, x0, y0, x1, y1 FROM ({SPANS_SQL}) UNION ALL
  SELECT doc_id, page, 'drawing', ord, CASE WHEN c - a < 0.5 THEN a - 0.5 ELSE a END, CASE WHEN d - b < 0.5 THEN b - 0.5 ELSE b END, CASE WHEN c - a < 0.5 THEN c + 0.5 ELSE c END, CASE WHEN d - b < 0.5 THEN d + 0.5 ELSE d END
  FROM shapes WHERE (c - a >= 0.5 OR d - b >= 0.5) AND (c - a < 900 OR d - b < 0.9 * (800 + page))
)
"""

ORACLES = {
    "span_filter": _S + "SELECT doc_id, ord, border, title FROM flags",
    "tol_header": _S + "SELECT doc_id, page, b.x AS hx, b.y AS hy FROM head",
    "tol_rows": _S + "SELECT doc_id, page, ord, row_no::BIGINT AS row_no FROM rows_",
    "tol_items": _S.replace(f"spans AS ({SPANS_SQL})", f"spans AS ({TABLED_SQL})", 1) + "SELECT doc_id, page, v.o AS ord, v.t AS text FROM tol",
    "notes_until_gap": _S + "SELECT doc_id, page, ord, text FROM notes",
    "bbox_antijoin": _S + "SELECT doc_id, page, count(*) AS n, sum(ord)::BIGINT AS ords FROM free GROUP BY ALL",
    "span_merge": _S + "SELECT * FROM merged",
    "tol_split": f"WITH {_TABLE} SELECT doc_id, ord, nominal, tolerance FROM ({SPANS_SQL}) JOIN known USING (text)",
    "dim_classify": f"WITH {_TABLE} SELECT doc_id, ord, stamp, hint, good, kind FROM ({SPANS_SQL}) JOIN known USING (text)",
    "pair_distance": _NEAR + "SELECT doc_id, page, a, b FROM edge WHERE a < b",
    "components": _NEAR + "SELECT doc_id, page, ord, cluster FROM comp",
    "dim_grammar": f"""SELECT doc_id, ord, trim(prefix || number || unit) AS nominal, trim(tol) AS tolerance, prefix = 'SECRET ' AS stamp,
        prefix IN ('R', 'Ø ', 'M', '#', 'Ra ') OR number <> '7' OR unit IN ('°', ' TYP', ' x 3') OR tol IN (' ±0.1', ' +0.2/-0.1') OR (tol = '±2' AND unit = '') AS hint,
        number IN ('12.5', '3,25') OR prefix IN ('R', 'Ø ', 'DIA ', 'M', '#') OR unit = '°' OR (number = '1/4-20' AND unit = ' UNC') AS good,
        CASE WHEN prefix IN ('Ø ', 'DIA ') THEN 'Diameter' WHEN prefix = 'R' THEN 'Radius' WHEN unit IN ('°', ' DEG') THEN 'Angle' WHEN unit = ' UNC' OR prefix = 'M' THEN 'Thread' ELSE 'Linear' END AS kind FROM ({GRAMMAR_SQL})""",
    "inspection_rows": _SHEETS + "SELECT doc_id, page, balloon, kind, text, tolerance FROM numbered",
    "number_clockwise": _NUMBERED + "SELECT doc_id, page, ord, balloon FROM numbered",
    "inspection_csv": _NUMBERED.replace("WITH RECURSIVE", f"WITH RECURSIVE {_TABLE},", 1) + """SELECT doc_id, '"no","text","kind","tolerance","found"' || chr(13) || chr(10) ||
        string_agg('"' || balloon || '","' || nominal || '","' || kind || '","' || tolerance || '",""' || chr(13) || chr(10), '' ORDER BY balloon) AS body FROM numbered JOIN known USING (text) GROUP BY doc_id""",
    "span_unnest": f"""SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY b, l, ord) - 1)::INTEGER AS ord, trim(text) AS text, x0, y0, x1, y1, size::DOUBLE AS size
        FROM ({NESTED_SQL}) WHERE kind = 0 AND trim(text) <> ''""",
    "page_boxes": _BOXES + "SELECT * FROM boxes",
    "crossed_texts": _BOXES + """SELECT t.doc_id, t.page, t.ord, count(*) AS n, sum((least(t.x1, d.x1) - greatest(t.x0, d.x0)) * (least(t.y1, d.y1) - greatest(t.y0, d.y0))) AS area,
        round(min(sqrt(greatest(d.x0 - (t.x0 + t.x1) / 2, (t.x0 + t.x1) / 2 - d.x1, 0) ** 2 + greatest(d.y0 - (t.y0 + t.y1) / 2, (t.y0 + t.y1) / 2 - d.y1, 0) ** 2)), 6) AS nearest
        FROM boxes t JOIN boxes d ON d.doc_id = t.doc_id AND d.page = t.page AND t.kind = 'text' AND d.kind = 'drawing' AND d.x0 <= t.x1 AND t.x0 <= d.x1 AND d.y0 <= t.y1 AND t.y0 <= d.y1 GROUP BY ALL""",
    "centroid": _NEAR + "SELECT doc_id, page, cluster, round(avg(cx), 6) AS mx, round(avg(cy), 6) AS my, min(x0) AS left, max(y1) AS bottom FROM s JOIN comp USING (doc_id, page, ord) GROUP BY ALL",
}
