import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromatile.operators import drawing, paint, vector

LINES = "image_id long, region_id int, loop_id int, points array<struct<x: double, y: double>>"


def winding(line, cx, cy):
    """Winding number of closed lines around a point: crossings of the ray to the left, a point on a line counted as right of or below it."""
    n = 0
    for p in line:
        for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1]):
            if min(y1, y2) <= cy < max(y1, y2) and x1 + (cy - y1) * (x2 - x1) / (y2 - y1) <= cx:
                n += 1 if y2 > y1 else -1
    return n


def apart2(cx, cy, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = 0.0 if length == 0 else max(0.0, min(1.0, ((cx - x1) * dx + (cy - y1) * dy) / length))
    gx, gy = cx - (x1 + t * dx), cy - (y1 + t * dy)
    return gx * gx + gy * gy


def outlines(seed, n=8, side=24):
    rng = np.random.default_rng(seed)
    rows = []
    for region in range(n):
        for loop in range(1 + region % 2):
            corners = rng.uniform(-3, side + 3, (int(rng.integers(3, 9)), 2))
            if region % 3 == 0:
                corners = np.round(corners * 2) / 2  # corners and sides on centres and edges of pixels
            rows.append((7 + region % 2, region, loop, [(float(x), float(y)) for x, y in corners]))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_fill_equals_winding_numbers(spark, seed):
    rows, side = outlines(seed), 24
    images = spark.createDataFrame([(7, side, side), (8, side, side - 5)], "image_id long, width int, height int")
    extra = [(7, 90, 0, None), (7, 91, 0, []), (7, 92, 0, [(1.0, 1.0)]), (7, 93, 0, [(1.0, 1.0), (9.0, 7.0)])]
    lines = spark.createDataFrame(rows + extra, LINES)
    got = {tuple(r) for r in drawing.fill(lines, ["image_id", "region_id"], images).select("image_id", "region_id", "x", "y").collect()}
    want = set()
    for image, region in {r[:2] for r in rows}:
        own = [r[3] for r in rows if r[:2] == (image, region)]
        want |= {(image, region, x, y) for x in range(side) for y in range(side - 5 * (image == 8)) if winding(own, x + 0.5, y + 0.5)}
    assert got == want and len(want) > 300
    free = drawing.fill(lines, ["image_id", "region_id"])
    assert free.count() == free.distinct().count() >= len(got)


def test_a_hole_of_the_other_way_stays_empty(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    rows = [(1, 1, 0, square(0.0, 9.0)), (1, 1, 1, square(3.0, 6.0)[::-1]), (1, 2, 0, square(0.0, 9.0)), (1, 2, 1, square(3.0, 6.0))]
    n = {r.region_id: r["count"] for r in drawing.fill(spark.createDataFrame(rows, LINES), ["image_id", "region_id"]).groupBy("region_id").count().collect()}
    assert n == {1: 72, 2: 81}


@pytest.mark.parametrize("width", [2.0, 0.9, 5.5])
def test_contours_equal_distances(spark, width):
    rows, side = outlines(5), 24
    images = spark.createDataFrame([(7, side, side), (8, side, side)], "image_id long, width int, height int")
    got = {tuple(r) for r in drawing.contours(spark.createDataFrame(rows + [(7, 5, 5, [(4.5, 4.5)]), (7, 6, 6, None)], LINES), ["image_id"], width, images).collect()}
    want = set()
    for image, _, _, p in rows + [(7, 5, 5, [(4.5, 4.5)])]:
        for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1]):
            want |= {(image, x, y) for x in range(side) for y in range(side) if apart2(x + 0.5, y + 0.5, x1, y1, x2, y2) <= (width / 2) ** 2}
    assert got == want


def strokes(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for stroke in range(6):
        for seq in range((1, 2, 3, 7, 12, 1)[stroke]):
            rows.append((stroke % 2, stroke, seq, float(rng.uniform(-4, 34)), float(rng.uniform(0, 30)), float(rng.choice([0.0, 0.25, 0.5, 1.0, 1.5])), float((3, 1, 6, 2.5, 4, 9)[stroke])))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_brush_marks_equal_plain_strokes(spark, seed):
    rows = strokes(seed)
    images = spark.createDataFrame([(0, 30, 30), (1, 30, 30)], "image_id int, width int, height int")
    table = spark.createDataFrame(rows, "image_id int, stroke int, seq int, x double, y double, pressure double, size double")
    got = [tuple(r) for r in drawing.brush_marks(table, ["image_id", "stroke"], "seq", images, 0.05).collect()]
    width = lambda size, p: size * (0.25 + 0.75 * min(1.0, max(0.0, p)))
    want = set()
    for stroke in range(6):
        own = [r[3:] for r in rows if r[1] == stroke]
        pieces = []
        if len(own) == 1:
            pieces = [(0, own[0][:2], own[0][:2], own[0][:2], width(own[0][3], own[0][2]) / 2)]
        for i in range(1, len(own)):
            a, b = own[i - 1], own[i]
            start = tuple((own[i - 2][k] + a[k]) / 2 for k in (0, 1)) if i >= 2 else a[:2]
            pieces.append((i, start, a[:2], tuple((a[k] + b[k]) / 2 for k in (0, 1)), width(a[3], (a[2] + b[2]) / 2) / 2))
        for part, p, via, q, r in pieces:
            bend = math.sqrt(sum((p[k] - 2 * via[k] + q[k]) ** 2 for k in (0, 1)))
            n = max(1, math.ceil(math.sqrt(bend / (4 * 0.05))))
            at = lambda k, c: (1 - k / n) * (1 - k / n) * p[c] + 2 * (k / n) * (1 - k / n) * via[c] + (k / n) * (k / n) * q[c]
            for k in range(n):
                s = (at(k, 0), at(k, 1), at(k + 1, 0), at(k + 1, 1))
                want |= {(stroke % 2, stroke, part, x, y) for x in range(30) for y in range(30) if apart2(x + 0.5, y + 0.5, *s) <= r * r}
    assert set(got) == want and len(got) == len(want) > 300


@pytest.mark.parametrize("rise", [0.0, 2e-15, -2e-15, 1e-9, -1e-9, 1e-3])
def test_level_segments_that_touch_a_row(spark, rise):
    """A row may be just ``r`` away from a segment that is level but for rounding."""
    shapes = [(k, x1, y, x2, y + rise, r) for k, (x1, x2, y, r) in enumerate([(2.0, 9.0, 10.0, 0.5), (9.0, 2.0, 10.0, 0.5), (1.25, 11.5, 7.25, 1.75), (3.0, 12.0, 5.0, 2.5)])]
    got = {tuple(r) for r in drawing.cover(spark.createDataFrame(shapes, "k int, x1 double, y1 double, x2 double, y2 double, r double"), ["k"]).select("k", "x", "y").collect()}
    assert got == {(k, x, y) for k, *s, r in shapes for x in range(-4, 20) for y in range(-4, 20) if apart2(x + 0.5, y + 0.5, *s) <= r * r}


def test_flattened_pieces_stay_near(spark):
    rng = np.random.default_rng(9)
    rows = [(i, *map(float, rng.uniform(0, 300, 6)), 1.0) for i in range(20)]
    names = "k int, from_x double, from_y double, via_x double, via_y double, to_x double, to_y double, r double"
    got = drawing.flatten(spark.createDataFrame(rows, names), ["k"], 0.1).toPandas()
    for k, *c, _ in rows:
        own = got[got.k == k][["x1", "y1", "x2", "y2"]].to_numpy()
        for t in np.linspace(0, 1, 101):
            p = [(1 - t) ** 2 * c[i] + 2 * t * (1 - t) * c[2 + i] + t * t * c[4 + i] for i in (0, 1)]
            assert min(apart2(*p, *s) for s in own) <= 0.1001**2


def plain_composite(marks):
    """Marks laid on one by one: source-over, destination-out, destination-over on (r, g, b, a), not premultiplied."""
    out = {}
    for key in {m[0] for m in marks}:
        r = g = b = a = 0.0
        for _, _, _, tool, mr, mg, mb, o in sorted((m for m in marks if m[0] == key), key=lambda m: m[1:3]):
            o = 1.0 if o is None else min(1.0, max(0.0, o))
            if tool == "eraser":
                a *= 1 - o
                continue
            if mr is None:
                continue
            first, second = ((a, (r, g, b)), (o, (mr, mg, mb)))[:: -1 if tool != "fill-all" else 1]
            new = first[0] + second[0] * (1 - first[0])
            if new > 0:
                r, g, b = (((first[0] * p + second[0] * (1 - first[0]) * q) / new) for p, q in zip(first[1], second[1]))
            a = new
        out[key] = (r, g, b, a * 255) if a > 0 else (0, 0, 0, 0)
    return out


@pytest.mark.parametrize("fold", [2, 5, 256])
def test_composite_equals_laying_on_one_by_one(spark, fold):
    rng = np.random.default_rng(fold)
    marks = []
    for key in range(12):
        for seq in range(int(rng.integers(1, 40))):
            for part in range(int(rng.integers(1, 6))):
                tool = str(rng.choice(["brush", "eraser", "fill-all"], p=[0.7, 0.2, 0.1]))
                color = [None] * 3 if rng.random() < 0.05 else [int(v) for v in rng.integers(0, 256, 3)]
                marks.append((key, seq, part, tool, *color, [0.0, 0.3, 0.5, 1.0, None][int(rng.integers(0, 5))]))
    marks += [(50, 0, 0, "eraser", None, None, None, 0.5), (51, 3, 0, "brush", None, None, None, 1.0), (52, 0, 0, "fill-all", 9, 8, 7, 1.0)]
    table = spark.createDataFrame(marks, "p int, seq int, part int, tool string, r int, g int, b int, opacity double").repartition(3)
    got = {r.p: (r.r, r.g, r.b, r.a) for r in paint.composite(table, ["p"], fold).collect()}
    want = plain_composite(marks)
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert all(abs(x - y) <= 0.5 + 1e-6 for x, y in zip(got[key], values)), (key, got[key], values)
    assert paint.composite(table.limit(0), ["p"]).count() == 0


def test_painted_layer_equals_its_sql_where_a_stroke_is_level(spark, tmp_path):
    """The last stroke of either user has neighbouring points of one height, and a row that its line just touches."""
    import duckdb

    from chromatile.plans import drawn  # noqa: F401  registers its queries
    from chromatile.plans.queries import QUERIES, SQL

    level = [251505, 252977, 253093, 255576, 256705, 258475, 258904, 259980]
    other = [553163, 553687, 555510, 555962, 557912, 560860, 560865, 560938]
    # As a user's fifth stroke and sixth stroke, which have the sizes and tools of those.
    own = [(0, e) for e in [*range(1, 65, 2), *level]] + [(1, e) for e in [*range(2, 82, 2), *other]]
    spark.createDataFrame([(e, u) for u, e in own], "event_id long, user_id long").selectExpr("event_id", "timestamp_seconds(event_id) AS ts", "user_id", "'x' AS event_type", "0D AS value", "'' AS props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("brush_pixels", "painted_layer"):
        got = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(db.sql(SQL[name]).select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall()), name


def test_a_hot_pixel_is_folded_in_pieces(spark):
    n = 20_000  # one pixel under all marks
    marks = spark.range(n).select(F.lit(1).alias("p"), F.floor(F.col("id") / 40).alias("seq"), (F.col("id") % 40).alias("part"), F.when(F.col("id") % 7 == 3, "eraser").otherwise("brush").alias("tool"), (F.col("id") % 256).alias("r"), F.lit(10).alias("g"), (F.col("id") % 3 * 100).alias("b"), F.lit(0.1).alias("opacity"))
    rows = [(1, r.seq, r.part, r.tool, r.r, r.g, r.b, r.opacity) for r in marks.collect()]
    got = paint.composite(marks, ["p"], 16).first()
    assert all(abs(x - y) <= 0.51 for x, y in zip(got[1:], plain_composite(rows)[1]))


def test_stamps_have_the_shape_of_the_atlas(spark):
    # At font size 10 a symbol is 5 wide and 7 high: the atlas itself.
    numbers = spark.createDataFrame([(1, k, s, 10.5, 20.5 * (k + 1), 10) for k, s in enumerate(drawing.GLYPHS)] + [(1, 99, "nope", 1.0, 1.0, 10), (1, 98, None, 1.0, 1.0, 10)], "image_id int, k int, symbol string, x double, y double, font_size int")
    got = {tuple(r) for r in drawing.stamp(numbers, ["k"]).collect()}
    want = {(k, 8 + c, int(20.5 * (k + 1) - 3.5 + 0.5) + r) for k, cells in enumerate(drawing.GLYPHS.values()) for r, row in enumerate(cells.split()) for c, bit in enumerate(row) if bit == "1"}
    assert {(k, x) for k, x, _ in got} == {(k, x) for k, x, _ in want} and len(got) == len(want)
    assert all(len(row) == 5 for cells in drawing.GLYPHS.values() for row in cells.split()) and all(len(c.split()) == 7 for c in drawing.GLYPHS.values())
    large = drawing.stamp(numbers.filter("k = 8").withColumn("font_size", F.lit(48)), ["image_id", "k"], spark.createDataFrame([(1, 16, 200)], "image_id int, width int, height int"))
    assert large.filter("x >= 16 OR x < 0").count() == 0 and large.count() > 100


def test_export_lays_numbers_over_lines_over_paint(spark):
    pixels = spark.createDataFrame([(1, x, 0, 200, 100, 0, a) for x, a in enumerate((255, 0, 51, None))], "image_id int, x int, y int, r int, g int, b int, a int")
    at = lambda *xs: spark.createDataFrame([(1, x, 0) for x in xs], "image_id int, x int, y int")
    rows = {r.x: (r.r, r.g, r.b, r.a) for r in drawing.export(pixels, at(0, 1), at(1, 9)).collect()}
    assert rows == {0: (0, 0, 0, 255), 1: (51, 51, 51, 255), 2: (244, 224, 204, 255), 3: (255, 255, 255, 255)}
    assert {r.x: r.r for r in drawing.export(pixels).collect()} == {0: 200, 1: 255, 2: 244, 3: 255}


def test_highlight_lays_overlapping_outlines_on_twice(spark):
    box = lambda x: [(x, 0.0), (x + 4, 0.0), (x + 4, 4.0), (x, 4.0)]
    lines = spark.createDataFrame([(1, 1, 0, box(0.0)), (1, 2, 0, box(3.0)), (1, 3, 0, box(0.0)), (2, 1, 0, box(0.0))], LINES)
    regions = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 1, 1)], "image_id long, region_id int, color_idx int")
    palette = spark.createDataFrame([(0, "#0a141e"), (1, None)], "color_idx int, hex string")
    chosen = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "image_id long, color_idx int")
    rows = drawing.highlight(lines, regions, palette, chosen).collect()
    assert {(r.image_id, r.r, r.g, r.b) for r in rows} == {(1, 10, 20, 30)} and len(rows) == 28
    assert {(r.x, r.a) for r in rows} == {(x, 147 if x == 3 else 89) for x in range(7)}


def plain_strip(colors, width, height):
    n = len(colors)
    cell = max(44, math.floor(width / 12 + 0.5))
    cols = min(n, max(6, width // cell))
    strip = math.ceil(n / cols) * cell + cell * 0.4
    pad, out = cell * 0.12, {}
    for y in range(height, height + math.floor(strip + 0.5)):
        for x in range(width):
            c = [17.0] * 3
            for i, h in enumerate(colors):
                left, top, size = (width - cols * cell) / 2 + i % cols * cell + pad, height + cell * 0.2 + i // cols * cell + pad, cell - 2 * pad
                part = max(0.0, min(x + 1, left + size) - max(x, left)) * max(0.0, min(y + 1, top + size) - max(y, top))
                c = [v * (1 - part) + int(h[1 + 2 * k : 3 + 2 * k], 16) * part for k, v in enumerate(c)]
            out[x, y] = (*c, 255 * min(1.0, height + strip - y))
    return out, cell, cols


@pytest.mark.parametrize("n,width", [(1, 30), (7, 300), (13, 777)])
def test_legend_strip(spark, n, width):
    colors = [f"#{(i * 2654435761) % (1 << 24):06x}" for i in range(n)]
    palette = spark.createDataFrame([(1, i, h) for i, h in enumerate(colors)] + [(2, 0, "#ffffff")], "image_id int, idx int, hex string")
    images = spark.createDataFrame([(1, width, 50), (2, 100, 80), (3, 9, 9)], "image_id int, width int, height int")
    rows = drawing.legend_strip(palette, images).collect()
    want, cell, cols = plain_strip(colors, width, 50)
    got = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in rows if r.image_id == 1}
    assert got.keys() == want.keys() and {r.image_id for r in rows} == {1, 2}
    signs = {(0x1C, 0x19, 0x17), (255, 255, 255)}
    off = {k for k, v in want.items() if any(abs(a - b) > 0.5 + 1e-6 for a, b in zip(got[k], v))}
    assert all(got[k][:3] in signs for k in off) and off  # only the symbols
    layout = {r.idx: r for r in drawing.legend_layout(palette, images).filter("image_id = 1").collect()}
    for x, y in off:
        i = (y - 50 - int(cell * 0.2)) // cell * cols + int((x - (width - cols * cell) / 2) // cell)
        assert abs(x + 0.5 - layout[i].left - layout[i].size / 2) < layout[i].size / 2 and abs(y + 0.5 - layout[i].top - layout[i].size / 2) < layout[i].size / 2


def test_corner_cutting_is_linear_where_it_is_exploded(spark):
    import time

    n = 20_000
    points = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i % 97).cast("double").alias("x"), (i % 31).cast("double").alias("y")))
    lines = spark.range(2).select("id", points.alias("points"), F.lit("kept").alias("other"))
    began = time.time()
    rows = vector.chaikin(lines, 3).select("id", "other", F.posexplode("points").alias("i", "p"))
    assert rows.count() == 2 * 8 * n and time.time() - began < 20
    p = [(i % 97, i % 31) for i in range(n)]
    for _ in range(3):
        p = [v for (a, b), (c, d) in zip(p, p[1:] + p[:1]) for v in ((a * 0.75 + c * 0.25, b * 0.75 + d * 0.25), (a * 0.25 + c * 0.75, b * 0.25 + d * 0.75))]
    got = [(r.p.x, r.p.y) for r in rows.filter("id = 1 AND i < 1000").orderBy("i").collect()]
    assert got == p[:1000]


def test_lines_of_any_length_are_redrawn(spark):
    rows = [(1, 1, 0, None), (1, 2, 0, []), (1, 3, 0, [(1.0, 2.0)]), (1, 4, 0, [(0.0, 0.0), (4.0, 0.0)]), (1, 5, 0, [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)])]
    cut = {r.region_id: r.points for r in vector.chaikin(spark.createDataFrame(rows, LINES)).collect()}
    assert cut[1] is None and cut[2] == [] and {k: len(cut[k]) for k in (3, 4, 5)} == {3: 4, 4: 8, 5: 16}
    assert all((p.x, p.y) == (1.0, 2.0) for p in cut[3])
    stays = vector.simplified(spark.createDataFrame(rows, LINES)).collect()
    assert [(r.image_id, r.region_id, len(r.points)) for r in stays] == [(1, 5, 4)]


def test_ids_of_any_type_have_outlines(spark):
    cells = spark.createDataFrame([(1 << 40, x, y, "a" if x < 2 else "b") for x in range(4) for y in range(4)], "image_id long, x int, y int, region_id string")
    loops = vector.trace_loops(vector.boundary_edges(cells))
    assert {(r.image_id, r.region_id, len(r.points)) for r in loops.collect()} == {(1 << 40, "a", 13), (1 << 40, "b", 13)}
