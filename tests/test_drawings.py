"""Numbering, placement and leaders against plain page walks; nested spans, boxes; folds on a large page."""

import math
import random
import time

from docloom.operators import glyphs as G
from docloom.operators import spans as S
from pyspark.sql import functions as F

ITEM = "doc_id long, page int, balloon long, kind string, x0 double, y0 double, x1 double, y1 double, w double, h double"
BOX = "doc_id long, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double"


def rect_overlap(a, b):
    if a[2] < b[0] or b[2] < a[0] or a[3] < b[1] or b[3] < a[1]:
        return 0.0
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def plain_places(items, texts):
    """One page's balloons, place by place and text by text."""
    placed, out = [], []
    for kind, x0, y0, x1, y1, w, h in items:
        mx, my = (x0 + x1) / 2, (y0 + y1) / 2
        if kind == "Note":
            bx, by = max(12.0, min(w - 12.0, x0 - 20.0)), max(12.0, min(h - 12.0, my))
            for _ in range(40):
                if all(math.hypot(bx - px, by - py) >= 22.0 for px, py in placed):
                    break
                by = max(12.0, min(h - 12.0, by - 22.0))
            leader = False
        else:
            best, least = None, math.inf
            cx = max(12.0, x0 - 60.0)
            while cx <= min(w - 12.0, x1 + 60.0) + 1e-9:
                cy = max(12.0, y0 - 60.0)
                while cy <= min(h - 12.0, y1 + 60.0) + 1e-9:
                    square = (cx - 12, cy - 12, cx + 12, cy + 12)
                    over = sum(rect_overlap(square, t) for t in [*texts, (x0, y0, x1, y1)]) + sum(484.0 for px, py in placed if math.hypot(cx - px, cy - py) < 22.0)
                    cost = 500 * over + (cx - mx) ** 2 + (cy - my) ** 2 - (500 if y0 <= cy <= y1 or x0 <= cx <= x1 else 0)
                    if cost < least:
                        best, least = (cx, cy), cost
                    cy += 5.0
                cx += 5.0
            bx, by = best or (max(12.0, x1 + 16.0), max(12.0, my))
            leader = math.hypot(bx - mx, by - my) > 25.0
        placed.append((bx, by))
        out.append((bx, by, leader))
    return out


def random_page(rng, n, w, h, notes):
    """Items and texts on quarter points, many of them close together."""
    boxes = []
    for _ in range(n):
        x, y = rng.randrange(0, int(w) * 4) / 4, rng.randrange(0, int(h) * 4) / 4
        boxes.append((x, y, x + rng.randrange(8, 160) / 4, y + rng.randrange(8, 48) / 4))
    items = [("Note" if rng.random() < notes else "Linear", *b, w, h) for b in boxes[: n // 2]]
    return items, boxes


def test_placement_by_a_plain_walk(spark):
    rng = random.Random(7)
    pages = [random_page(rng, 24, 300.0, 200.0, 0.3) for _ in range(5)]
    pages += [([("Note", 5.0, y, 25.0, y + 4.0, 300.0, 200.0) for y in (10.0, 12.0, 15.0, 30.0, 31.0)], [])]  # crowded at the top
    pages += [([("Linear", 2.0, 2.0, 9.0, 9.0, 20.0, 20.0), ("Note", 2.0, 2.0, 9.0, 9.0, 20.0, 20.0)], [])]  # no room
    pages += [([("Linear", 100.0, 100.0, 130.0, 110.0, 600.0, 400.0)] * 12, [(60.0, 60.0, 170.0, 99.0)])]
    items = [(1 + p % 3, p, k + 1, *item) for p, (own, _) in enumerate(pages) for k, item in enumerate(own)]
    texts = [(1 + p % 3, p, k, "t", *box) for p, (_, own) in enumerate(pages) for k, box in enumerate(own)] + [(9, 0, 0, "alone", 1.0, 1.0, 2.0, 2.0)]
    items_df = spark.createDataFrame(items, ITEM)
    placed = S.placed_balloons(items_df, spark.createDataFrame(texts, BOX))
    got = {(r.page, r.balloon): (r.bx, r.by, r.leader) for r in placed.collect()}
    want = {(p, k + 1): place for p, (own, boxes) in enumerate(pages) for k, place in enumerate(plain_places(own, boxes))}
    assert got == want and sum(x[2] for x in want.values()) >= 5
    lines = {(r.page, r.balloon): (r.sx, r.sy, r.tx, r.ty) for r in S.leader_lines(placed, items_df).collect()}
    ends = {}
    for _, page, balloon, _, x0, y0, x1, y1, _, _ in items:
        bx, by, leader = want[page, balloon]
        tx, ty = max(x0, min(x1, bx)), max(y0, min(y1, by))
        d = math.hypot(tx - bx, ty - by)
        if leader and d > 10.5:
            ends[page, balloon] = (bx + (tx - bx) / d * 10, by + (ty - by) / d * 10, tx, ty)
    assert lines.keys() == ends.keys() and ends and all(abs(a - b) < 1e-9 for k in ends for a, b in zip(lines[k], ends[k], strict=True))


def test_clusters_and_numbers_by_a_plain_walk(spark):
    rng = random.Random(3)
    rows = []
    for doc, page, n in ((1, 0, 30), (1, 1, 12), (2, 0, 1), (3, 4, 40)):
        for k in range(n):
            x, y = rng.randrange(0, 4000) / 4, rng.randrange(0, 3200) / 4
            rows.append((doc, page, k, "t", x, y, x + 10.0, y + 6.0))
    sizes = spark.createDataFrame([(1, 0, 1000.0, 800.0), (1, 1, 900.0, 800.0), (2, 0, 100.0, 100.0)], "doc_id long, page int, w double, h double")
    got = {(r.doc_id, r.page, r.ord): r.balloon for r in S.numbered(S.on_pages(S.clustered(spark.createDataFrame(rows, BOX), 150.0), sizes)).collect()}
    size = {(1, 0): (1000.0, 800.0), (1, 1): (900.0, 800.0), (2, 0): (100.0, 100.0)}
    want = {}
    for doc in (1, 2, 3):
        ordered = []
        for page in sorted({r[1] for r in rows if r[0] == doc}):
            own = {r[2]: ((r[4] + r[6]) / 2, (r[5] + r[7]) / 2) for r in rows if r[:2] == (doc, page)}
            clusters, left = [], sorted(own)
            while left:
                group, front = [left[0]], [left.pop(0)]
                while front:
                    a = front.pop()
                    near = [b for b in left if (own[a][0] - own[b][0]) ** 2 + (own[a][1] - own[b][1]) ** 2 <= 150.0**2]
                    left = [b for b in left if b not in near]
                    group, front = group + near, front + near
                clusters.append(sorted(group))
            w, h = size.get((doc, page), (1.0, 1.0))
            turn = lambda dx, dy: (math.atan2(dx, -dy) + 2 * math.pi) % (2 * math.pi)
            entries = []
            for group in clusters:
                mx, my = (sum(own[k][i] for k in group) / len(group) for i in (0, 1))
                inner = sorted(group, key=lambda k: (round((math.atan2(own[k][1] - my, own[k][0] - mx) + math.pi / 2) % (2 * math.pi), 9), round(math.hypot(own[k][0] - mx, own[k][1] - my), 6), k))
                entries.append((round(turn(mx - w / 2, my - h / 2), 9), math.hypot(mx - w / 2, my - h / 2), inner))
            ordered += [(page, k) for _, _, inner in sorted(entries) for k in inner]
        want |= {(doc, page, k): i for i, (page, k) in enumerate(ordered, 1)}
    assert got == want


def test_nested_spans(spark):
    span = "struct<text string, x0 double, y0 double, x1 double, y1 double, size double>"
    text = lambda t, x, size=8.0: (t, x, 1.0, x + 5, 2.0, size)
    pages = [
        (1, 0, [(0, [([text(" a ", 0.0), text("   ", 5.0)],), ([text("b\u00a0", 9.0, None)],)]), (1, [([text("image", 0.0)],)]), (0, None), (0, [(None,), ([text("c", 1.0)],)])]),
        (1, 1, None), (2, 0, []),
    ]
    rows = spark.createDataFrame(pages, f"doc_id long, page int, blocks array<struct<kind int, lines array<struct<spans array<{span}>>>>>")
    assert [(r.doc_id, r.page, r.ord, r.text, r.x0, r["size"]) for r in S.span_boxes(rows).orderBy("ord").collect()] == [(1, 0, 0, "a", 0.0, 8.0), (1, 0, 1, "b", 9.0, 0.0), (1, 0, 2, "c", 1.0, 8.0)]


def test_folds_are_linear_in_a_page(spark):
    def took(n):
        spans = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("page"), F.col("id").cast("int").alias("ord"), F.lit("t").alias("text"), (F.col("id") % 500 * 8.0).alias("x0"), (F.floor(F.col("id") / 500) * 10.0).alias("y0"))
        spans = spans.withColumn("x1", F.col("x0") + F.when(F.col("ord") % 2 == 0, 5.0).otherwise(1.0)).withColumn("y1", F.col("y0") + 4.0)
        chars = spans.select("doc_id", "page", "ord", F.lit("g").alias("glyph"), "x0", F.col("y0").alias("top"))
        begin = time.perf_counter()
        merged, lines = S.merged_spans(spans).count(), G.lines(chars).count()
        return time.perf_counter() - begin, merged, lines

    took(1000)
    small, large = took(10_000), took(100_000)
    assert (large[1], large[2]) == (10 * small[1], 10 * small[2]) and large[2] == 200 and large[1] < 100_000
    assert large[0] < 10 * small[0] + 5
