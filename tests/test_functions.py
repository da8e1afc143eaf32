import math

from docloom.functions import drawing as D
from docloom.functions import geometry as G
from docloom.functions import text as T
from docloom.sinks import base64_text, number_text, quoted_csv_line, use_legacy_charsets, write_csv, write_tsv
from pyspark.sql import functions as F


def values(spark, rows, column, kind="string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], f"x {kind}").select(column).collect()]


def test_quantities(spark):
    assert values(spark, ["36.00", "1,495.00", "1,49.00", "1495", "", None, "1,2", "12,345,678.5"], T.thousands(F.col("x"))) == [36.0, 1495.0, None, 1495.0, None, None, None, 12345678.5]


def test_safe_cells(spark):
    got = values(spark, ["=1+1", "  +2", "-x", "@a", "a=b", "a\tb\r\nc", "\t=x", None, ""], T.safe_cell(F.col("x")))
    assert got == ["'=1+1", "'  +2", "'-x", "'@a", "a=b", "a b  c", "' =x", "", ""]


def test_dates_names_and_order(spark):
    assert values(spark, ["07/05/2026", "", "2026-05-07", "32/13/2026", "29/02/2023", "29/02/2024"], F.coalesce(T.valid_date(F.col("x")), F.lit(False))) == [True, False, False, False, False, True]
    assert values(spark, ["a.b.pdf", "noext", "", None], T.stem_with(F.col("x"), "_plr.txt", "upload")) == ["a.b_plr.txt", "noext_plr.txt", "upload_plr.txt", "upload_plr.txt"]
    assert values(spark, ["  cba  fed ", "אבג"], T.logical_order(F.col("x"))) == ["def abc", "גבא"]
    assert values(spark, [" Component\r\n Item ", None], T.header_cell(F.col("x"))) == ["component item", ""]
    assert values(spark, ["1", "4", None], T.digit_choice(F.col("x"))) == ["FAI 1", None, None]
    assert values(spark, [" none ", "A"], T.blank_sentinel(F.col("x"), "none")) == ["", "A"]


def test_anchored_name(spark):
    keys = [("ACME AVIONICS", "A1"), ("ACME", "A2")]
    rows = ["x", "terms\n\n acme \n avionics\n", "terms\na\nb\nc\nd\nACME", "terms\nFoo\nx acme", "terms\n \n"]
    assert values(spark, rows, T.anchored_name(F.col("x"), "terms", keys)) == [None, "A1", "a", "A2", None]


def test_tolerances_and_kinds(spark):
    texts = ["10.5 ±0.1 TYP", "25 ±0.1", "12 +0.1/-0.2", "R5", "M8x1", "Ø", "45 DEG", "7", ""]
    nominal, tolerance = D.split_tolerance(F.col("x"))
    assert values(spark, texts, nominal) == ["10.5TYP", "25", "12", "R5", "M8x1", "Ø", "45 DEG", "7", ""]
    assert values(spark, texts, tolerance) == ["±0.1", "±0.1", "+0.1/-0.2", "", "", "", "", "", ""]
    assert values(spark, ["25", "25.0", "R 5", "DIA. 3", "9°"], D.classifiable(F.col("x"))) == [False, True, True, True, True]
    assert values(spark, ["ø3 R2", "r 2", "3°", "#4-40", "x", ""], D.dimension_kind(F.col("x"))) == ["Diameter", "Radius", "Angle", "Thread", "Linear", "Linear"]
    assert values(spark, ["1. a", "1)", "1.5", "(1)"], D.note_bullet(F.col("x"))) == [True, True, False, False]
    assert values(spark, ["X", "X.XX", "X.XXXX", "angle", "XX"], D.tolerance_label(F.col("x"))) == [True, True, False, True, False]


def test_angles(spark):
    rows = spark.createDataFrame([(0.0, -1.0), (1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, 0.0)], "dx double, dy double")
    got = [tuple(r) for r in rows.select(G.clockwise(F.col("dx"), F.col("dy")), G.micro_angle(F.col("dx"), F.col("dy"))).collect()]
    want = [(0, 0), (math.pi / 2,) * 2, (math.pi,) * 2, (1.5 * math.pi,) * 2, (math.pi, math.pi / 2)]
    assert all(abs(a - b) < 1e-12 for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_boxes(spark):
    rows = spark.createDataFrame([(10.0, 5.0, 0.0, 5.0), (1.0, 1.0, 1.2, 1.2), (0.0, 0.0, 95.0, 95.0)], "x0 double, y0 double, x1 double, y1 double").withColumns({"w": F.lit(100.0), "h": F.lit(100.0)})
    keep, box = G.normalised_box()
    got = rows.select(keep.alias("k"), box.alias("b")).collect()
    assert [r.k for r in got] == [True, False, False] and tuple(got[0].b) == (0.0, 4.5, 10.0, 5.5)


def test_sinks(spark, tmp_path):
    assert values(spark, [36.0, 1495.25, 1e7, 0.0001], number_text(F.col("x")), "double") == ["36.0", "1495.25", "10000000.0", "0.0001"]
    assert values(spark, ["a" * 100], base64_text(F.encode("x", "utf-8"))) == ["YWFh" * 33 + "YQ=="]
    rows = spark.createDataFrame([('a"b', None)], "p string, q string")
    assert rows.select(quoted_csv_line(["p", "q"])).first()[0] == '"a""b",""\r\n'
    write_tsv(spark.createDataFrame([("אב", "=\"x", None), (" y ", "€中", "")], "a string, b string, c string").coalesce(1), f"{tmp_path}/t")
    body = next(tmp_path.glob("t/part-*")).read_bytes()
    assert body.decode("windows-1255") == 'a\tb\tc\r\nאב\t="x\t\r\n y \t€?\t\r\n'
    write_csv(rows.coalesce(1), f"{tmp_path}/c")
    assert next(tmp_path.glob("c/part-*")).read_bytes() == b'"p","q"\r\n"a""b",""\r\n'
    use_legacy_charsets(spark)
    assert spark.createDataFrame([("א",)], "x string").select(F.encode("x", "windows-1255")).first()[0] == b"\xe0"
