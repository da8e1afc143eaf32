"""Joins by position inside a page: semi, interval, nearest and first-match joins of words.

Every join has (doc_id, page) as equality keys, so Spark hashes on them and the position conditions are
residual; no page is compared with another. "First" is the least ordinal.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import center, in_band
from ..functions.text import digit_choice, without_spaces
from . import formpages
from .glyphs import line_numbers

PAGE = ["doc_id", "page"]


@dataclass(frozen=True)
class Bands:
    """Fixed values of the quotation form, in points."""

    number_x: tuple[float, float] = (128.0, 168.0)
    number_y: tuple[float, float] = (50.0, 62.0)
    mail_x_max: float = 200.0
    mail_y: tuple[float, float] = (86.0, 112.0)
    mail_top: float = 99.0
    quantity: tuple[float, float] = (255.0, 295.0)
    weeks: tuple[float, float] = (355.0, 380.0)
    each: tuple[float, float] = (495.0, 525.0)
    part: tuple[float, float] = (725.0, 785.0)
    marker: tuple[float, float] = (28.0, 50.0)
    digit: tuple[float, float] = (32.0, 45.0)
    row: float = 4.0
    cell_x: tuple[float, float] = (28.0, 48.0)
    cell_below: tuple[float, float] = (-1.0, 22.0)
    digit_below: float = 15.0
    header: float = 140.0
    end: float = 10_000.0


FORM = Bands()


def clean_words(words: DataFrame) -> DataFrame:
    """Words with a size, of printable ASCII characters and the minus sign only."""
    return words.where("size > 0").where(F.col("text").rlike(r"^[\x20-\x7E−]+$"))


def near(a: str, b: str, by: float = FORM.row) -> Column:
    return F.abs(F.col(a) - F.col(b)) <= by


def part_words(words: DataFrame, form: Bands = FORM) -> DataFrame:
    """Part numbers below the page header that have an ``Each`` on their row."""
    shaped = F.col("text").rlike(r"^[A-Z][A-Z0-9]{4,12}$") & F.col("text").rlike(r"\d")
    parts = words.where(in_band(*form.part) & (F.col("top") > form.header) & shaped)
    each = words.where(in_band(*form.each) & (F.col("text") == "Each")).select(*PAGE, F.col("top").alias("each_top"))
    same_row = [parts["doc_id"] == each["doc_id"], parts["page"] == each["page"], F.abs(parts["top"] - each["each_top"]) <= form.row]
    return parts.join(each, same_row, "left_semi")


def part_intervals(parts: DataFrame, form: Bands = FORM) -> DataFrame:
    """Each part with the closed interval of tops, up to the next part's, that is its own."""
    following = F.lead("top", 1, form.end).over(Window.partitionBy(*PAGE).orderBy("top", "ord"))
    return parts.select(*PAGE, F.col("ord").alias("part_ord"), F.col("text").alias("part_no"), F.col("top").alias("part_top"), (F.col("top") - form.row).alias("lo"), (following - form.row).alias("hi"))


def quantities(words: DataFrame, intervals: DataFrame, form: Bands = FORM) -> DataFrame:
    """Quantity words joined to the part intervals that hold their top; one on a common end belongs to both."""
    found = words.where(in_band(*form.quantity) & F.col("text").rlike(r"^\d+\.\d{1,3}$"))
    found = found.select(*PAGE, F.col("ord").alias("qty_ord"), F.col("text").try_cast("double").alias("quantity"), F.col("top").alias("qty_top"))
    return found.join(intervals, PAGE).where("qty_top BETWEEN lo AND hi")


def first_weeks(words: DataFrame, rows: DataFrame, form: Bands = FORM) -> DataFrame:
    """``rows`` with weeks: the first whole number on the row in the weeks band, NULL if there is none."""
    found = words.where(in_band(*form.weeks) & F.col("text").rlike(r"^\d+$"))
    found = found.select(*PAGE, F.col("ord").alias("w_ord"), F.col("text").try_cast("int").alias("w"), F.col("top").alias("w_top"))
    first = rows.select(*PAGE, "qty_ord", "part_ord", "qty_top").join(found, PAGE).where(near("w_top", "qty_top", form.row))
    first = first.groupBy(*PAGE, "qty_ord", "part_ord").agg(F.min_by("w", "w_ord").alias("weeks"))
    return rows.join(first, [*PAGE, "qty_ord", "part_ord"], "left")


def marked_choice(words: DataFrame, rows: DataFrame, form: Bands = FORM) -> DataFrame:
    """``rows`` with has_marker and choice: the first marker on the row, then the first whole number just below it."""
    markers = words.where(in_band(*form.marker) & F.col("text").startswith("FAI")).select(*PAGE, F.col("ord").alias("m_ord"), F.col("top").alias("m_top"))
    digits = words.where(in_band(*form.digit) & F.col("text").rlike(r"^\d+$")).select(*PAGE, F.col("ord").alias("d_ord"), F.col("text").alias("digit"), F.col("top").alias("d_top"))
    keys = [*PAGE, "qty_ord", "part_ord"]
    marked = rows.select(*keys, "qty_top").join(markers, PAGE).where(near("m_top", "qty_top", form.row))
    marked = marked.groupBy(*keys).agg(F.min_by("m_top", "m_ord").alias("m_top"))
    below = marked.join(digits, PAGE).where((F.col("d_top") > F.col("m_top")) & (F.col("d_top") <= F.col("m_top") + form.digit_below))
    below = below.groupBy(*keys).agg(F.min_by("digit", "d_ord").alias("digit"))
    out = rows.join(marked.withColumn("has_marker", F.lit(True)).drop("m_top"), keys, "left").join(below, keys, "left")
    return out.withColumn("has_marker", F.coalesce("has_marker", F.lit(False))).withColumn("choice", digit_choice(F.col("digit"))).drop("digit")


def cell_choice(chars: DataFrame, maps: DataFrame, rows: DataFrame, word: str, form: Bands = FORM) -> DataFrame:
    """``rows`` whose cell of unsized characters reads ``word`` under one of the page's fonts get it as choice.

    Only rows without a marker and choice are looked at. ``chars`` has code; spaces don't count.
    """
    keys = [*PAGE, "qty_ord", "part_ord"]
    lo, hi = form.cell_below
    open_ = rows.where("NOT has_marker AND choice IS NULL").select(*keys, "qty_top")
    unsized = chars.where((F.coalesce("size", F.lit(0)) == 0) & F.col("x0").between(*form.cell_x))
    cells = unsized.join(open_, PAGE).where((F.col("top") >= F.col("qty_top") + lo) & (F.col("top") <= F.col("qty_top") + hi)).drop("qty_top")
    # Lines don't depend on the font, so characters are put in lines once. Right to left and without spaces, a cell is its
    # characters by x, the last line first, reversed as a whole.
    placed = line_numbers(cells, "code", keys=keys)
    read = placed.join(maps.select(*PAGE, "font_id", "code", "glyph").hint("merge"), [*PAGE, "code"]).groupBy(*keys, "font_id")
    letters = F.array_sort(F.collect_list(F.struct((-F.col("line_no")).alias("up"), "x0", "ord", "glyph", "at")))
    whole = read.agg(F.bool_and(F.col("glyph").isNotNull()).alias("whole"), F.max("n").alias("n"), letters.alias("l"))
    text = F.reverse(without_spaces(F.array_join("l.glyph", "")))
    found = whole.where(F.col("whole") & (text == without_spaces(F.lit(word))) & (F.size(F.array_distinct("l.at")) == F.col("n")))
    found = found.select(*keys).distinct().withColumn("_word", F.lit(word))
    return rows.join(found, keys, "left").withColumn("choice", F.coalesce("choice", "_word")).drop("_word")


def form_number(words: DataFrame, form: Bands = FORM) -> DataFrame:
    """doc_id, number: the first six digits in the header box, over pages and then words."""
    found = words.where(in_band(*form.number_x) & F.col("top").between(*form.number_y) & F.col("text").rlike(r"^\d{6}$"))
    return found.groupBy("doc_id").agg(F.min_by("text", F.struct("page", "ord")).alias("number"))


def mail_anchor(words: DataFrame, domain: str, form: Bands = FORM) -> DataFrame:
    """doc_id, page and the box x0, x1, top of the address word nearest to the form's line; ties go to the first."""
    found = words.where(F.col("text").endswith("@" + domain) & ((F.col("x0") + F.col("x1")) / 2 <= form.mail_x_max) & F.col("top").between(*form.mail_y))
    best = found.groupBy(*PAGE).agg(F.min_by(F.struct("text", "x0", "x1", "top"), F.struct(F.abs(F.col("top") - form.mail_top), "ord")).alias("anchor"))
    return best.select(*PAGE, "anchor.*")


def buyer_box(anchors: DataFrame) -> DataFrame:
    """The closed rectangle above an anchor in which the buyer's name stands."""
    return anchors.select(*PAGE, F.greatest(F.col("x0") - 15, F.lit(0.0)).alias("x0"), (F.col("x1") + 2).alias("x1"), (F.col("top") - 27).alias("y0"), (F.col("top") - 13).alias("y1"))


def date_box(anchors: DataFrame) -> DataFrame:
    """The closed rectangle below an anchor in which the date stands."""
    return anchors.select(*PAGE, F.lit(283.0).alias("x0"), F.lit(327.5).alias("x1"), (F.col("top") + 73.5).alias("y0"), (F.col("top") + 86.5).alias("y1"))


def chars_in(chars: DataFrame, boxes: DataFrame) -> DataFrame:
    """Characters without a size whose origin lies in the page's box."""
    box = boxes.select(*PAGE, *[F.col(c).alias(f"b_{c}") for c in ("x0", "x1", "y0", "y1")])
    joined = chars.where("coalesce(size, 0) = 0").join(box, PAGE)
    return joined.where("x0 BETWEEN b_x0 AND b_x1 AND top BETWEEN b_y0 AND b_y1").select(*chars.columns)


def read_pages(words: DataFrame, domain: str, form: Bands = FORM) -> DataFrame:
    """doc_id, page, parts, number, mail: all that a page of clean ``words`` says, in one pass.

    Words that stand where nothing is read are left out; a page is one group, and batches of pages are read in numpy
    (``formpages``). parts is part_ord, part_no, part_top and deliveries (qty_ord,
    quantity, qty_top, weeks, has_marker, digit), as ``part_intervals``, ``quantities``, ``first_weeks`` and ``marked_choice`` have them;
    number is the page's first form number (ord, text), mail its ``mail_anchor`` (text, x0, x1, top), both NULL without one.
    """
    top, kinds = F.col("top"), dict(words.dtypes)
    fields = F.struct("ord", "text", *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top")])
    columns = [in_band(*band) for band in (form.part, form.each, form.quantity, form.weeks, form.marker, form.digit)]
    placed = reduce(Column.__or__, [*columns, in_band(*form.number_x) & top.between(*form.number_y), (center() <= form.mail_x_max) & top.between(*form.mail_y)])
    # Places are looked at in the aggregate: before it they would make one generated method with the words' own, too long to be compiled.
    pages = words.groupBy(*PAGE).agg(F.collect_list(F.when(placed & F.col("text").isNotNull(), fields)).alias("words"))
    delivery = f"struct<qty_ord: {kinds['ord']}, quantity: double, qty_top: double, weeks: int, has_marker: boolean, digit: string>"
    parts = f"array<struct<part_ord: {kinds['ord']}, part_no: string, part_top: double, deliveries: array<{delivery}>>>"
    mail = f"struct<away: double, ord: {kinds['ord']}, text: string, x0: double, x1: double, top: double>"
    schema = f"doc_id {kinds['doc_id']}, page {kinds['page']}, parts {parts}, number struct<ord: {kinds['ord']}, text: string>, mail {mail}"
    return pages.mapInArrow(lambda batches: formpages.read_all(batches, domain, form), schema)
