"""Spans of drawings: rows by gap, runs that stop at a gap, merging, anchors, clusters, numbering."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import drawing as D
from ..functions.geometry import border_label, center, clockwise, edge_distance, micro_angle, nearest_point, normalised_box, overlap_area, overlaps, title_block
from ..functions.text import strip
from .pages import by_groups

PAGE = ["doc_id", "page"]
CLUSTER_DISTANCE = 450.0
#: Pages of at most so many items are clustered without numpy, whose calls cost more than they do.
FEW = 24


def on_pages(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """``spans`` with their page's w and h; 1 by 1 where the page isn't known."""
    joined = spans.join(sizes.select(*PAGE, "w", "h"), PAGE, "left")
    return joined.withColumn("w", F.coalesce("w", F.lit(1.0))).withColumn("h", F.coalesce("h", F.lit(1.0)))


def filtered(spans: DataFrame) -> DataFrame:
    """Spans (with w, h) that are neither border labels nor in the title block."""
    return spans.where(~border_label() & ~title_block())


def tolerance_anchor(spans: DataFrame) -> DataFrame:
    """doc_id, page, hx, hy: the last header in the page's lower half, but the first of all if none after it is there."""
    heads = spans.where(D.tolerance_header(F.col("text")))
    first = F.min_by(F.struct("x0", "y0"), "ord")
    low = F.max_by(F.when(F.col("y0") > 0.5 * F.col("h"), F.struct("x0", "y0")), F.when(F.col("y0") > 0.5 * F.col("h"), F.col("ord")))
    best = heads.groupBy(*PAGE).agg(F.coalesce(low, first).alias("head"))
    return best.select(*PAGE, F.col("head.x0").alias("hx"), F.col("head.y0").alias("hy"))


def in_tolerance_block(spans: DataFrame, anchors: DataFrame) -> DataFrame:
    """``spans`` with in_block: below the anchor and beside it; false on pages without one."""
    inside = (F.col("y0") >= F.col("hy")) & F.col("x0").between(F.col("hx") - 60, F.col("hx") + 200)
    return spans.join(anchors, PAGE, "left").withColumn("in_block", F.coalesce(inside, F.lit(False))).drop("hx", "hy")


def banded_rows(spans: DataFrame, gap: float = 5.0) -> DataFrame:
    """``spans`` with row_no from 0: a row ends where the centre is more than ``gap`` below the one before."""
    order = Window.partitionBy(*PAGE).orderBy("cy", "ord")
    placed = spans.withColumn("cy", center("y0", "y1"))
    new = F.coalesce((F.col("cy") - F.lag("cy").over(order) > gap).cast("int"), F.lit(0))
    return placed.withColumn("_new", new).withColumn("row_no", F.sum("_new").over(order)).drop("_new", "cy")


def tolerance_items(rows: DataFrame) -> DataFrame:
    """One item per row with a label: the first number at or right of the first label's right edge, by x."""
    rank = F.struct("x0", "ord")
    key = [*PAGE, "row_no"]
    labels = rows.where(D.tolerance_label(F.col("text"))).groupBy(*key).agg(F.min_by("x1", rank).alias("edge"))
    values = rows.withColumn("value", D.tolerance_value(F.col("text"))).where("value IS NOT NULL")
    first = values.join(labels, key).where("x0 >= edge").groupBy(*key).agg(F.min_by(F.struct("ord", F.col("value").alias("text"), "x0", "y0", "x1", "y1"), rank).alias("v"))
    return first.select(*PAGE, "v.*", F.lit("GeneralTolerance").alias("kind"), F.lit("").alias("tolerance"))


def notes(spans: DataFrame, gap: float = 60.0) -> DataFrame:
    """Numbered lines below a page's first notes header, up to the first gap after the bottom of the span before."""
    heads = spans.where(D.notes_header(F.col("text"))).groupBy(*PAGE).agg(F.min_by("y1", "ord").alias("head"))
    below = spans.join(heads, PAGE).where("y0 >= head")
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "ord")
    broken = (F.col("y0") - F.lag("y1", 1).over(order) > gap).cast("int")
    first = (F.col("y0") - F.col("head") > gap).cast("int")
    below = below.withColumn("_gap", F.coalesce(broken, first)).withColumn("_stop", F.max("_gap").over(order))
    found = below.where("_stop = 0").where(D.note_bullet(F.col("text")))
    return found.select(*PAGE, "ord", F.trim("text").alias("text"), "x0", "y0", "x1", "y1", F.lit("Note").alias("kind"), F.lit("").alias("tolerance"))


def without_boxes(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Spans whose exact box is none of the others' on the page."""
    return spans.join(others, [*PAGE, "x0", "y0", "x1", "y1"], "left_anti")


def merged_spans(spans: DataFrame, y_gap: float = 1.5, x_gap: float = 6.0) -> DataFrame:
    """Neighbours on a line joined, by centre y, then x: ord (of the first), text, box.

    A span joins the one before if its centre is within ``y_gap`` and it begins 0 to ``x_gap`` right of it; the
    comparison is with what has been merged so far, whose box grows. So this is a fold over a page's spans; its
    state is one box, and boxes and texts of the runs that it finds are put together afterwards.
    """

    def run_starts(boxes: list[tuple[float, ...]], begins: set[int]) -> list[int]:
        out, top, right, bottom = [], 0.0, 0.0, 0.0
        for i, (cy, x0, y0, x1, y1) in enumerate(boxes):
            if i not in begins and abs(cy - (top + bottom) / 2) <= y_gap and 0 <= x0 - right <= x_gap:
                top, right, bottom = min(top, y0), max(right, x1), max(bottom, y1)
            else:
                out.append(i)
                top, right, bottom = y0, x1, y1
        return out

    def pages(rows: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        boxes = list(zip(*(rows[c].tolist() for c in ("_cy", "x0", "y0", "x1", "y1")), strict=True))
        start = run_starts(boxes, set(cuts))
        texts, ends = rows["text"].tolist(), [*start[1:], len(rows)]
        out = rows.iloc[start][[*PAGE, "ord"]].assign(text=[texts[a] if b == a + 1 else " ".join(texts[a:b]) for a, b in zip(start, ends, strict=True)])
        return out.assign(**{c: take.reduceat(rows[c].to_numpy(), start) for c, take in (("x0", np.minimum), ("y0", np.minimum), ("x1", np.maximum), ("y1", np.maximum))})

    sorted_ = spans.select(*PAGE, F.col("ord").cast("int").alias("ord"), "text", "x0", "y0", "x1", "y1", ((F.col("y0") + F.col("y1")) / 2).alias("_cy"))
    kinds = ", ".join(f"{c} {t}" for c, t in sorted_.select(*PAGE).dtypes)
    return by_groups(sorted_, PAGE, ["_cy", "x0", "ord"], pages, f"{kinds}, ord int, text string, x0 double, y0 double, x1 double, y1 double")


def dimensions(spans: DataFrame) -> DataFrame:
    """Spans that are dimensions: no stamp, with a hint, and classifiable without their tolerance; kind and tolerance."""
    text = F.col("text")
    nominal, tolerance = D.split_tolerance(text)
    found = spans.where(~D.stamp(text) & D.dimension_hint(text)).withColumn("nominal", nominal).withColumn("tolerance", tolerance)
    found = found.where(D.classifiable(F.col("nominal")))
    return found.select(*PAGE, "ord", F.col("nominal").alias("text"), "x0", "y0", "x1", "y1", D.dimension_kind(F.col("text")).alias("kind"), "tolerance")


def near_pairs(items: DataFrame, distance: float = CLUSTER_DISTANCE) -> DataFrame:
    """(doc_id, page, a, b) of items of a page whose centres are at most ``distance`` apart, a < b by ord."""
    placed = items.select(*PAGE, "ord", center().alias("cx"), center("y0", "y1").alias("cy"))
    a = placed.select(*PAGE, F.col("ord").alias("a"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    b = placed.select(*PAGE, F.col("ord").alias("b"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return a.join(b, PAGE).where((F.col("a") < F.col("b")) & (dx * dx + dy * dy <= distance * distance)).select(*PAGE, "a", "b")


def clustered(items: DataFrame, distance: float = CLUSTER_DISTANCE) -> DataFrame:
    """``items`` with cluster: the least ord of the items linked with it by steps of at most ``distance`` on its page.

    One page, whose items are few, is one group: links are followed from item to item, over plain numbers on small pages,
    over rows of its distance matrix in numpy on others.
    """

    def few(ord_: list, x: list[float], y: list[float]) -> list:
        out, left = list(ord_), list(range(len(ord_)))
        while left:  # by ord
            head, left = left[0], left[1:]
            front = [head]
            while front and left:
                k, far = front.pop(), []
                for i in left:
                    dx, dy = x[i] - x[k], y[i] - y[k]
                    if dx * dx + dy * dy <= distance * distance:
                        front.append(i)
                        out[i] = ord_[head]
                    else:
                        far.append(i)
                left = far
        return out

    def many(ord_: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = ord_.copy()
        seen = np.zeros(len(ord_), bool)
        for i in range(len(ord_)):  # by ord
            if seen[i]:
                continue
            front = [i]
            seen[i] = True
            while front:
                k = front.pop()
                out[k] = ord_[i]
                hit = np.flatnonzero(~seen & ((x - x[k]) ** 2 + (y - y[k]) ** 2 <= distance * distance))
                seen[hit] = True
                front += hit.tolist()
        return out

    def pages(rows: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        ord_, x, y = rows["ord"].to_numpy(), ((rows["x0"] + rows["x1"]) / 2).to_numpy(), ((rows["y0"] + rows["y1"]) / 2).to_numpy()
        lists, out = (ord_.tolist(), x.tolist(), y.tolist()), ord_.copy()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > FEW:
                out[a:b] = many(ord_[a:b], x[a:b], y[a:b])
            elif b - a > 1:
                out[a:b] = few(*(v[a:b] for v in lists))
        return rows.assign(cluster=out)

    schema = ", ".join(f"`{n}` {t}" for n, t in items.dtypes)
    return by_groups(items, PAGE, ["ord"], pages, f"{schema}, cluster {dict(items.dtypes)['ord']}")


def numbered(items: DataFrame) -> DataFrame:
    """``items`` (with cluster, w, h) with balloon from 1 in each document: pages, clusters clockwise round the page, items clockwise round their cluster."""
    by_cluster = Window.partitionBy(*PAGE, "cluster")
    placed = items.withColumn("cx", center()).withColumn("cy", center("y0", "y1"))
    placed = placed.withColumn("mx", F.avg("cx").over(by_cluster)).withColumn("my", F.avg("cy").over(by_cluster)).withColumn("head", F.min("ord").over(by_cluster))
    px, py = F.col("mx") - F.col("w") / 2, F.col("my") - F.col("h") / 2
    ix, iy = F.col("cx") - F.col("mx"), F.col("cy") - F.col("my")
    keys = ["page", F.round(clockwise(px, py), 9), F.round(F.hypot(px, py), 6), "head", F.round(micro_angle(ix, iy), 9), F.round(F.hypot(ix, iy), 6), "ord"]
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(*keys)).cast("long")
    return placed.withColumn("balloon", number).drop("cx", "cy", "mx", "my", "head")


# Measures of balloons in points and the weights of a place's score.
RADIUS, GAP = 10.0, 2.0
#: Half a balloon's square, and the distance of centres from which two balloons don't collide.
HALF, CLEAR = RADIUS + 2.0, 2 * RADIUS + GAP
#: The grid of places: its step, and how far around the box it reaches.
STEP, REACH = 5.0, 60.0
#: What a square point of overlap costs, and what a place level with the box or above or below it saves.
OVERLAP_COST, BAND_GAIN = 500.0, 500.0
#: A balloon farther than this from its box's centre has a leader.
LEADER_DISTANCE = 25.0
#: Notes stand so far left of their text; a place without a grid is so far right of the box; steps that a note moves at most.
NOTE_LEFT, ASIDE, NOTE_MOVES = 20.0, 16.0, 40


def _grid(low: float, high: float, size: float) -> np.ndarray:
    first, last = max(HALF, low - REACH), min(size - HALF, high + REACH)
    return first + STEP * np.arange(max(0, math.floor((last + 1e-9 - first) / STEP) + 1))


def _covered(centres: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How much of each interval (rows) a balloon's square at each centre (columns) covers."""
    return np.clip(np.minimum(centres + HALF, high[:, None]) - np.maximum(centres - HALF, low[:, None]), 0, None)


def _dimension_place(box: np.ndarray, texts: np.ndarray, earlier: np.ndarray, w: float, h: float) -> tuple[float, float]:
    x0, y0, x1, y1 = box
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    xs, ys = _grid(x0, x1, w), _grid(y0, y1, h)
    if not len(xs) or not len(ys):
        return max(HALF, x1 + ASIDE), max(HALF, my)
    near = (texts[:, 0] <= xs[-1] + HALF) & (texts[:, 2] >= xs[0] - HALF) & (texts[:, 1] <= ys[-1] + HALF) & (texts[:, 3] >= ys[0] - HALF)
    boxes = np.vstack([texts[near], box])
    # Overlap with all boxes at all places: widths times heights, summed over boxes.
    overlap = _covered(xs, boxes[:, 0], boxes[:, 2]).T @ _covered(ys, boxes[:, 1], boxes[:, 3])
    close = earlier[(earlier[:, 0] > xs[0] - CLEAR) & (earlier[:, 0] < xs[-1] + CLEAR) & (earlier[:, 1] > ys[0] - CLEAR) & (earlier[:, 1] < ys[-1] + CLEAR)]
    for px, py in close:
        overlap += CLEAR * CLEAR * (np.hypot((xs - px)[:, None], ys - py) < CLEAR)
    band = ((ys >= y0) & (ys <= y1)) | ((xs >= x0) & (xs <= x1))[:, None]
    cost = overlap * OVERLAP_COST + ((xs - mx) ** 2)[:, None] + (ys - my) ** 2 - BAND_GAIN * band
    i, j = np.unravel_index(cost.argmin(), cost.shape)  # columns of places from left to right, each from top to bottom
    return float(xs[i]), float(ys[j])


def _note_place(box: np.ndarray, earlier: np.ndarray, w: float, h: float) -> tuple[float, float]:
    bx = max(HALF, min(w - HALF, box[0] - NOTE_LEFT))
    by = max(HALF, min(h - HALF, (box[1] + box[3]) / 2))
    level = earlier[np.abs(earlier[:, 0] - bx) < CLEAR]
    for _ in range(NOTE_MOVES):
        if not (np.hypot(level[:, 0] - bx, level[:, 1] - by) < CLEAR).any():
            break
        by = max(HALF, min(h - HALF, by - CLEAR))
    return bx, by


def placed_balloons(items: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """doc_id, page, balloon, bx, by, leader: where the balloons of ``items`` (numbered, with w, h) go, one after another.

    Dimensions try the grid of places within REACH of their box on the page. A place costs its squared
    distance from the box's centre, and OVERLAP_COST for each square point of overlap with the boxes of ``spans`` (all
    texts of the page), with the item's box once more, and with a square of CLEAR for each earlier balloon nearer
    than that; BAND_GAIN is saved in line with the box. The least cost wins, of equal ones the leftmost, then the topmost
    place. Without a place on the page a balloon goes to the right of its box. Notes stand left of their text
    and move up, at most NOTE_MOVES times and not beyond the page, until no earlier balloon is near. leader tells whether a
    dimension's balloon is more than LEADER_DISTANCE from its box's centre. Pages of ``spans`` without items have no row;
    without ``spans`` the items' boxes stand for them.
    """
    spans = items if spans is None else spans
    corners = ["x0", "y0", "x1", "y1"]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("balloon", "long"), ("kind", "string"), ("w", "double"), ("h", "double"))]
    both = items.select(*PAGE, *corners, F.col("balloon").cast("long").alias("balloon"), "kind", F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"))
    both = both.unionByName(spans.join(items.select(*PAGE).distinct(), PAGE, "left_semi").select(*PAGE, *corners, *none))

    def page(kinds: list, boxes: np.ndarray, size: np.ndarray, n_texts: int) -> tuple[np.ndarray, list[bool]]:
        texts, placed, leaders = boxes[:n_texts], np.empty((len(boxes) - n_texts, 2)), []
        for k in range(len(placed)):
            box, (w, h) = boxes[n_texts + k], size[n_texts + k]
            note = kinds[n_texts + k] == "Note"
            placed[k] = _note_place(box, placed[:k], w, h) if note else _dimension_place(box, texts, placed[:k], w, h)
            far = math.hypot(placed[k, 0] - (box[0] + box[2]) / 2, placed[k, 1] - (box[1] + box[3]) / 2)
            leaders.append(not note and far > LEADER_DISTANCE)
        return placed, leaders

    def pages(rows: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        boxes, size, kinds = rows[corners].to_numpy(float), rows[["w", "h"]].to_numpy(float), rows["kind"].tolist()
        is_item = rows["balloon"].notna().to_numpy()
        found = [page(kinds[a:b], boxes[a:b], size[a:b], int((~is_item[a:b]).sum())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out = rows.loc[is_item, [*PAGE, "balloon"]]
        places = np.concatenate([x for x, _ in found])
        return out.assign(balloon=out["balloon"].astype("int64"), bx=places[:, 0], by=places[:, 1], leader=[x for _, own in found for x in own])

    return by_groups(both, PAGE, ["balloon"], pages, "doc_id long, page int, balloon long, bx double, by double, leader boolean")


def leader_lines(placed: DataFrame, items: DataFrame) -> DataFrame:
    """From the rim of each balloon with a leader to the nearest point of its box, where that is farther than the rim."""
    joined = placed.where("leader").join(items.select(*PAGE, "balloon", "x0", "y0", "x1", "y1"), [*PAGE, "balloon"])
    tx, ty = nearest_point(F.col("bx"), F.col("by"))
    joined = joined.withColumn("tx", tx).withColumn("ty", ty).withColumn("far", edge_distance(F.col("bx"), F.col("by"))).where(F.col("far") > RADIUS + 0.5)
    return joined.select(*PAGE, "balloon", (F.col("bx") + (F.col("tx") - F.col("bx")) * RADIUS / F.col("far")).alias("sx"), (F.col("by") + (F.col("ty") - F.col("by")) * RADIUS / F.col("far")).alias("sy"), "tx", "ty")


def span_boxes(pages: DataFrame) -> DataFrame:
    """Spans of nested ``pages``: doc_id, page, blocks (kind, lines (spans (text, x0, y0, x1, y1, size))), in reading order as ord.

    Blocks of a kind other than 0 hold no text. Texts are trimmed, blank ones are left out and don't count in ord;
    null arrays hold nothing. The page's arrays are unnested three times by position, so ord is
    the place among the page's spans whatever the rows' order.
    """
    blocks = pages.select(*PAGE, F.posexplode("blocks").alias("b", "block")).where("block.kind = 0")
    lines = blocks.select(*PAGE, "b", F.posexplode("block.lines").alias("l", "line"))
    found = lines.select(*PAGE, "b", "l", F.posexplode("line.spans").alias("s", "span"))
    found = found.select(*PAGE, "b", "l", "s", strip(F.col("span.text")).alias("text"), "span.x0", "span.y0", "span.x1", "span.y1", F.coalesce("span.size", F.lit(0.0)).alias("size")).where("text <> ''")
    order = Window.partitionBy(*PAGE).orderBy("b", "l", "s")
    return found.select(*PAGE, (F.row_number().over(order) - 1).alias("ord"), "text", "x0", "y0", "x1", "y1", "size")


def page_boxes(spans: DataFrame, drawings: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, page, kind (text, drawing), ord, box: all boxes of a page in one relation, those of ``drawings`` put in order.

    Drawings that are dots or frame the page are left out, thin ones are widened (``normalised_box``).
    """
    keep, box = normalised_box()
    shapes = on_pages(drawings, sizes).where(keep).select(*PAGE, F.lit("drawing").alias("kind"), "ord", box.alias("b")).select(*PAGE, "kind", "ord", "b.*")
    return spans.select(*PAGE, F.lit("text").alias("kind"), "ord", "x0", "y0", "x1", "y1").unionByName(shapes)


def crossed_texts(boxes: DataFrame) -> DataFrame:
    """For each text of ``page_boxes``: how many drawings touch its box, their area on it, and how near the nearest touching one's edge is to the text's centre."""

    def side(name: str, kind: str) -> DataFrame:
        return boxes.where(F.col("kind") == kind).select(*PAGE, *(F.col(c).alias(f"{name}_{c}") for c in ("ord", "x0", "y0", "x1", "y1")))

    met = side("t", "text").join(side("d", "drawing"), PAGE).where(overlaps("t", "d"))
    away = edge_distance(center("t_x0", "t_x1"), center("t_y0", "t_y1"), "d_")
    return met.groupBy(*PAGE, F.col("t_ord").alias("ord")).agg(F.count("*").alias("n"), F.sum(overlap_area("t", "d")).alias("area"), F.min(away).alias("nearest"))
