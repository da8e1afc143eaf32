"""Items of inspections as they are found, against DuckDB."""

from collections import Counter

import duckdb
from docloom.plans import queries_drawings as QD

SF = "/root/testdata/sf0.001"


def test_items_have_texts_tolerances_and_boxes(spark):
    con = duckdb.connect()
    for name in ("lineitem", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    columns = ["doc_id", "page", "ord", "kind", "text", "tolerance", "x0", "y0", "x1", "y1"]
    sql = QD._S.replace(f"spans AS ({QD.SPANS_SQL})", f"{QD._TABLE}, spans AS ({QD.TABLED_SQL})", 1).rstrip() + QD._FOUND
    want = con.sql(f"{sql} SELECT {', '.join(columns)} FROM found").fetchall()
    merged = con.sql(f"{sql} SELECT DISTINCT doc_id, page, ord FROM merged WHERE text NOT IN (SELECT text FROM known)").fetchall()
    items = QD.inspection_items(spark, SF)
    assert items.columns == columns
    got = Counter(tuple(r) for r in items.collect())
    assert Counter({r: n for r, n in got.items() if r[3] in ("Note", "GeneralTolerance") or r[:3] not in merged}) == Counter(want)
    assert {r[3] for r in got} > {"Note", "GeneralTolerance", "Linear", "Angle"} and {r[5] for r in got} > {"", "+0.1/-0.2"}
