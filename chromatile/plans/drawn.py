"""The queries of what is drawn: paths, strokes, numbers, legends, and the project store, over the given tables.

Polygons and pictures come from ``lineitem`` (one image a supplier), strokes from ``events`` (one canvas a user), projects
from ``orders``. The queries register with those of ``queries``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import drawing, paint, regions, stencil, vector
from ..operators.settling import new_path, settle
from ..sources.store import ProjectStore
from .queries import _FONT, _LABEL, _RG, _STORE, PALETTE, PX, SYMBOL, _channel, _grid_regions, _store, catalog_palette, pixels, query, table

CORNERS = 6


def _polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Closed lines of up to six corners from neighbouring pixels: image_id, region_id, loop_id, points."""
    p = pixels(spark, sf).select("image_id", F.expr(f"p div {CORNERS}").cast("long").alias("region_id"), "p", (F.col("r") * 3 % 81 / 20.0 + F.expr(f"p div {CORNERS} * 7 % 16")).alias("x"), ((F.col("g") + 7 * F.col("p")) % 121 / 20.0 + F.expr(f"p div {CORNERS} * 11 % 24")).alias("y"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("p", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    return p.groupBy("image_id", "region_id").agg(ordered.alias("points")).withColumn("loop_id", F.lit(0))


_POLY = f"q AS (SELECT image_id, p // {CORNERS} AS region_id, p % {CORNERS} AS i, count(*) OVER (PARTITION BY image_id, p // {CORNERS}) AS n, (r * 3 % 81) / 20.0::DOUBLE + p // {CORNERS} * 7 % 16 AS x, ((g + 7 * p) % 121) / 20.0::DOUBLE + p // {CORNERS} * 11 % 24 AS y FROM px)"


def _sql_cut(source: str, name: str) -> str:
    return f"""{name} AS (SELECT a.image_id, a.region_id, a.i * 2 + k AS i, a.n * 2 AS n, CASE k WHEN 0 THEN a.x * .75::DOUBLE + b.x * .25::DOUBLE ELSE a.x * .25::DOUBLE + b.x * .75::DOUBLE END AS x,
  CASE k WHEN 0 THEN a.y * .75::DOUBLE + b.y * .25::DOUBLE ELSE a.y * .25::DOUBLE + b.y * .75::DOUBLE END AS y FROM {source} a JOIN {source} b ON a.image_id = b.image_id AND a.region_id = b.region_id AND b.i = (a.i + 1) % a.n, (VALUES (0), (1)) v(k))"""


_SMOOTH = f"{_sql_cut('q', 'q1')}, {_sql_cut('q1', 'q2')}"


def _sql_fill(source: str) -> str:
    """fl: the pixels by winding numbers, summed anew for each pixel."""
    return f"""sd AS (SELECT a.image_id, a.region_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM {source} a JOIN {source} b ON a.image_id = b.image_id AND a.region_id = b.region_id AND b.i = (a.i + 1) % a.n),
cr AS (SELECT image_id, region_id, y, x1 + (y + .5 - y1) * (x2 - x1) / (y2 - y1) AS xc, CASE WHEN y2 > y1 THEN 1 ELSE -1 END AS way
  FROM (SELECT *, unnest(range(CAST(ceil(least(y1, y2) - .5) AS BIGINT), CAST(ceil(greatest(y1, y2) - .5) AS BIGINT))) AS y FROM sd WHERE y1 != y2)),
fl AS (SELECT image_id, region_id, CAST(t.x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM cr JOIN range(21) t(x) ON xc <= t.x + .5 GROUP BY ALL HAVING sum(way) != 0)"""


@query(f"WITH {PX}, {_POLY}, {_sql_fill('q')} SELECT image_id, region_id, x, y FROM fl")
def path_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Polygons filled by the nonzero rule."""
    return drawing.fill(_polygons(spark, sf), ["image_id", "region_id"]).select("image_id", "region_id", "x", "y")


@query(f"""WITH {PX}, {_POLY}, {_SMOOTH}, {_sql_fill('q2')}, {PALETTE}, pick AS (SELECT image_id, x, y, hex, count(*) AS k FROM fl JOIN pal ON idx = region_id % 7 WHERE region_id % 7 = CAST(image_id AS INTEGER) % 5 GROUP BY ALL)
SELECT image_id, x, y, {_channel(2)} AS r, {_channel(4)} AS g, {_channel(6)} AS b, CAST(floor(255 * (1 - pow(0.65::DOUBLE, k)) + .5) AS INTEGER) AS a FROM pick""")
def highlight_fill(spark: SparkSession, sf: str) -> DataFrame:
    """The smoothed paths of the active colour of each image, filled; where several overlap, laid on several times."""
    lines = _polygons(spark, sf)
    found = lines.select("image_id", "region_id", (F.col("region_id") % 7).cast("int").alias("color_idx"))
    chosen = lines.select("image_id", (F.col("image_id").cast("int") % 5).alias("color_idx")).distinct()
    return drawing.highlight(vector.chaikin(lines), found, catalog_palette(spark).select(F.col("idx").alias("color_idx"), "hex"), chosen)


_NEAR_SEGMENT = """(cx - (x1 + t * (x2 - x1))) * (cx - (x1 + t * (x2 - x1))) + (cy - (y1 + t * (y2 - y1))) * (cy - (y1 + t * (y2 - y1))) <= r * r"""


def _sql_cover(source: str, keys: str, width: int, height: int) -> str:
    """cv: all pixels of the box around each segment, decided by distance."""
    box = lambda a, n: f"unnest(range(greatest(0, CAST(floor(least({a}1, {a}2) - r) AS BIGINT) - 1), least({n}, CAST(ceil(greatest({a}1, {a}2) + r) AS BIGINT) + 1)))"
    return f"""bx AS (SELECT *, {box('x', width)} AS x FROM {source}), by_ AS (SELECT *, {box('y', height)} AS y FROM bx), ct AS (SELECT *, x + .5::DOUBLE AS cx, y + .5::DOUBLE AS cy, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS len FROM by_),
tt AS (SELECT *, CASE WHEN len = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((cx - x1) * (x2 - x1) + (cy - y1) * (y2 - y1)) / len)) END AS t FROM ct),
cv AS MATERIALIZED (SELECT DISTINCT {keys}, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM tt WHERE {_NEAR_SEGMENT})"""


_LINES = f"{_POLY}, {_SMOOTH}, sg AS (SELECT a.image_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, 1.0::DOUBLE AS r FROM q2 a JOIN q2 b ON a.image_id = b.image_id AND a.region_id = b.region_id AND b.i = (a.i + 1) % a.n), {_sql_cover('sg', 'image_id', 20, 30)}"


def _drawn_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = vector.chaikin(_polygons(spark, sf))
    images = lines.select("image_id", F.lit(20).alias("width"), F.lit(30).alias("height")).distinct()
    return drawing.contours(lines, ["image_id"], images=images)


@query(f"WITH {PX}, {_LINES} SELECT image_id, x, y FROM cv")
def path_contours(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed polygons as lines of width 2 with round joins."""
    return _drawn_lines(spark, sf).select("image_id", "x", "y")


# ---- numbers, export, legend ----

_ATLAS = "atlas AS (SELECT * FROM (VALUES {}) v(symbol, cells))".format(", ".join(f"('{s}', '{c.replace(' ', '')}')" for s, c in drawing.GLYPHS.items()))
_STAMP = """gl AS (SELECT w.*, cells, lx - fs * 0.25::DOUBLE AS gx, ly - fs * 0.35::DOUBLE AS gy, fs * 0.1::DOUBLE AS cw, fs * (0.7::DOUBLE / 7) AS ch FROM wr w JOIN atlas USING (symbol)),
gp AS (SELECT *, unnest(range(CAST(floor(gy) AS BIGINT) - 1, CAST(ceil(gy + 7 * ch) AS BIGINT) + 1)) AS y FROM (SELECT *, unnest(range(CAST(floor(gx) AS BIGINT) - 1, CAST(ceil(gx + 5 * cw) AS BIGINT) + 1)) AS x FROM gl)),
gc AS (SELECT *, CAST(floor((x + .5 - gx) / cw) AS BIGINT) AS c, CAST(floor((y + .5 - gy) / ch) AS BIGINT) AS w FROM gp),
sp AS (SELECT DISTINCT * EXCLUDE (cells, gx, gy, cw, ch, c, w, symbol, lx, ly, fs) FROM gc WHERE c BETWEEN 0 AND 4 AND w BETWEEN 0 AND 6 AND substr(cells, w * 5 + c + 1, 1) = '1')"""
_NUMBERS = f"{_LABEL}, {_RG}, wr AS (SELECT image_id, label_x AS lx, label_y AS ly, {SYMBOL} AS symbol, {_FONT} AS fs FROM (SELECT *, color_idx AS idx FROM rg)), {_ATLAS}, {_STAMP}"


@query(f"""WITH {PX}, {_LINES}, {_NUMBERS}, ink AS MATERIALIZED (SELECT image_id, x, y, max(k) AS k FROM (SELECT image_id, x, y, 0 AS k FROM cv UNION ALL SELECT image_id, x, y, 51 FROM sp) GROUP BY ALL)
SELECT p.image_id, p.x, p.y, {', '.join(f"coalesce(k, CAST(floor({c} * (p.n * 255 // 7) / 255.0::DOUBLE + 255 * (1 - (p.n * 255 // 7) / 255.0::DOUBLE) + .5) AS INTEGER)) AS {c}" for c in 'rgb')}, 255 AS a
FROM px p LEFT JOIN ink i ON i.image_id = p.image_id AND i.x = p.x AND i.y = p.y""")
def drawn_export(spark: SparkSession, sf: str) -> DataFrame:
    """Translucent paint over white, contours by path, and the numbers of the regions of the label grid."""
    painted = pixels(spark, sf).select("image_id", "x", "y", "r", "g", "b", F.expr("CAST(n * 255 div 7 AS INT)").alias("a"))
    return drawing.export(painted, _drawn_lines(spark, sf), drawing.stamp(regions.numbers(_grid_regions(spark, sf)), ["image_id"]))


_STRIP = f"""im AS (SELECT image_id, CAST(40 + count(*) % 60 AS INTEGER) AS width, CAST(max(y) + 1 AS INTEGER) AS height FROM px GROUP BY image_id), {PALETTE},
l0 AS (SELECT image_id, width, height, idx, hex, greatest(44, CAST(floor(width / 12.0::DOUBLE + .5) AS INTEGER)) AS cell, CAST(count(*) OVER (PARTITION BY image_id) AS INTEGER) AS n FROM im JOIN pal ON idx <= CAST(image_id AS INTEGER) % 7),
l1 AS (SELECT *, least(n, greatest(6, width // cell)) AS cols FROM l0), l2 AS (SELECT *, ceil(n / cols::DOUBLE) * cell + cell * 0.4::DOUBLE AS strip, cell * (1 - 2 * 0.12::DOUBLE) AS size,
  (width - cols * cell) / 2.0::DOUBLE + (idx % cols) * cell + cell * 0.12::DOUBLE AS lft, height + cell * (0.4::DOUBLE / 2) + (idx // cols) * cell + cell * 0.12::DOUBLE AS top FROM l1)"""


def _legends(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Palettes of one to seven colours and pictures of many widths."""
    images = pixels(spark, sf).groupBy("image_id").agg((40 + F.count(F.lit(1)) % 60).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"))
    return images.join(F.broadcast(catalog_palette(spark)), F.col("idx") <= F.col("image_id").cast("int") % 7).select("image_id", "idx", "hex"), images


@query(f"WITH {PX}, {_STRIP} SELECT image_id, idx, hex, cell, CAST(cols AS INTEGER) AS cols, round(strip, 6) AS strip, round(lft, 6) AS lft, round(top, 6) AS top, round(size, 6) AS size FROM l2")
def legend_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Where the colours of each image's legend go."""
    placed = drawing.legend_layout(*_legends(spark, sf))
    return placed.select("image_id", "idx", "hex", "cell", "cols", *[F.round(c, 6).alias("lft" if c == "left" else c) for c in ("strip", "left", "top", "size")])


@query(f"""WITH {PX}, {_STRIP}, gr AS (SELECT *, unnest(range(width)) AS x FROM (SELECT *, unnest(range(height, height + CAST(floor(strip + .5) AS INTEGER))) AS y FROM (SELECT DISTINCT image_id, width, height, strip FROM l2))),
sw AS (SELECT g.image_id, g.x, g.y, l.hex, (least(g.x + 1.0::DOUBLE, lft + size) - greatest(g.x::DOUBLE, lft)) * (least(g.y + 1.0::DOUBLE, top + size) - greatest(g.y::DOUBLE, top)) AS part
  FROM gr g JOIN l2 l ON l.image_id = g.image_id AND g.x < lft + size AND g.x + 1 > lft AND g.y < top + size AND g.y + 1 > top),
wr AS (SELECT image_id, CASE WHEN 0.299 * {_channel(2)} + 0.587 * {_channel(4)} + 0.114 * {_channel(6)} >= 128 THEN '#1c1917' ELSE '#ffffff' END AS sign, {SYMBOL} AS symbol, lft + size / 2 AS lx, top + size / 2 + floor(size * 0.52::DOUBLE + .5) * 0.04::DOUBLE AS ly, floor(size * 0.52::DOUBLE + .5) AS fs FROM l2), {_ATLAS}, {_STAMP},
px2 AS (SELECT g.image_id, g.x, g.y, CAST(floor(255 * least(1.0::DOUBLE, g.height + strip - g.y) + .5) AS INTEGER) AS a, sw.hex, coalesce(part, 0) AS part, sign FROM gr g LEFT JOIN sw ON sw.image_id = g.image_id AND sw.x = g.x AND sw.y = g.y LEFT JOIN sp ON sp.image_id = g.image_id AND sp.x = g.x AND sp.y = g.y)
SELECT image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {', '.join(f"CASE WHEN sign IS NOT NULL THEN CAST('0x' || substr(sign, {at}, 2) AS INTEGER) ELSE CAST(floor(17 * (1 - part) + coalesce({_channel(at)}, 0) * part + .5) AS INTEGER) END AS {c}" for c, at in zip('rgb', (2, 4, 6)))}, a FROM px2""")
def legend_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """The strip under each picture, as pixels."""
    return drawing.legend_strip(*_legends(spark, sf))


# ---- strokes ----

CANVAS = (64, 48)
_STROKES = """st AS (SELECT image_id, (seq - 1) // 8 AS stroke, seq, (event_id * 13 % 257) / 4.0::DOUBLE AS x, (event_id * 7 % 193) / 4.0::DOUBLE AS y, (event_id % 5) / 4.0::DOUBLE AS pressure, 2.0::DOUBLE + ((seq - 1) // 8) % 4 AS size
  FROM (SELECT user_id AS image_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)),
bk AS (SELECT *, row_number() OVER o - 1 AS part, lag(x) OVER o AS x_1, lag(x, 2) OVER o AS x_2, lag(y) OVER o AS y_1, lag(y, 2) OVER o AS y_2, lag(pressure) OVER o AS p_1, lead(seq) OVER o IS NULL AS final FROM st WINDOW o AS (PARTITION BY image_id, stroke ORDER BY seq)),
pc AS (SELECT image_id, stroke, part, coalesce((x_2 + x_1) / 2, x_1, x) AS fx, coalesce((y_2 + y_1) / 2, y_1, y) AS fy, coalesce(x_1, x) AS vx, coalesce(y_1, y) AS vy, coalesce((x_1 + x) / 2, x) AS tx, coalesce((y_1 + y) / 2, y) AS ty,
  size * (0.25::DOUBLE + 0.75::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce((p_1 + pressure) / 2, pressure)))) / 2 AS r FROM bk WHERE part > 0 OR final),
nn AS (SELECT *, greatest(1, CAST(ceil(sqrt(sqrt((fx - 2 * vx + tx) * (fx - 2 * vx + tx) + (fy - 2 * vy + ty) * (fy - 2 * vy + ty)) / (4 * 0.1::DOUBLE))) AS INTEGER)) AS n FROM pc),
kk AS (SELECT *, k / n::DOUBLE AS a, (k + 1) / n::DOUBLE AS b FROM (SELECT *, unnest(range(n)) AS k FROM nn)),
sg AS (SELECT image_id, stroke, part, r, (1 - a) * (1 - a) * fx + 2 * a * (1 - a) * vx + a * a * tx AS x1, (1 - a) * (1 - a) * fy + 2 * a * (1 - a) * vy + a * a * ty AS y1, (1 - b) * (1 - b) * fx + 2 * b * (1 - b) * vx + b * b * tx AS x2, (1 - b) * (1 - b) * fy + 2 * b * (1 - b) * vy + b * b * ty AS y2 FROM kk)"""
_MARKS = f"{_STROKES}, {_sql_cover('sg', 'image_id, stroke, part', *CANVAS)}"


def _marks(spark: SparkSession, sf: str) -> DataFrame:
    """What strokes of eight points, from the events of each user, paint on a canvas: image_id, stroke, part, x, y."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("image_id"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"))
    stroke = F.expr("(seq - 1) div 8")
    points = e.select("image_id", stroke.alias("stroke"), "seq", (F.col("event_id") * 13 % 257 / 4.0).alias("x"), (F.col("event_id") * 7 % 193 / 4.0).alias("y"), (F.col("event_id") % 5 / 4.0).alias("pressure"), (stroke % 4 + 2.0).alias("size"))
    images = e.select("image_id", F.lit(CANVAS[0]).alias("width"), F.lit(CANVAS[1]).alias("height")).distinct()
    return drawing.brush_marks(points, ["image_id", "stroke"], images=images)


@query(f"WITH {_MARKS} SELECT image_id, stroke, CAST(part AS INTEGER) AS part, x, y FROM cv")
def brush_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """The pixels of every piece of every stroke."""
    return _marks(spark, sf).select("image_id", "stroke", "part", "x", "y")


_TOOL = "CASE stroke % 6 WHEN 3 THEN 'eraser' WHEN 5 THEN 'fill-all' ELSE 'brush' END"


@query(f"""WITH RECURSIVE {_MARKS}, mk AS MATERIALIZED (SELECT image_id, x, y, row_number() OVER (PARTITION BY image_id, x, y ORDER BY stroke, part) AS i, {_TOOL} AS tool, (stroke * 53 % 256)::DOUBLE AS r, (stroke * 101 % 256)::DOUBLE AS g, (stroke * 197 % 256)::DOUBLE AS b, [0.35, 0.6, 0.85, 1.0][stroke % 4 + 1]::DOUBLE AS o FROM cv),
ly(image_id, x, y, i, r, g, b, a) AS (SELECT DISTINCT image_id, x, y, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM mk UNION ALL
  SELECT m.image_id, m.x, m.y, m.i, {', '.join(f"CASE m.tool WHEN 'brush' THEN l.{c} * (1 - o) + o * m.{c} WHEN 'eraser' THEN l.{c} * (1 - o) ELSE l.{c} + (1 - l.a) * o * m.{c} END" for c in 'rgb')}, CASE m.tool WHEN 'eraser' THEN l.a * (1 - o) ELSE l.a * (1 - o) + o END
  FROM ly l JOIN mk m ON m.image_id = l.image_id AND m.x = l.x AND m.y = l.y AND m.i = l.i + 1)
SELECT image_id, x, y, {', '.join(f"CASE WHEN a > 0 THEN CAST(floor(least(255, {c} / a) + .5) AS INTEGER) ELSE 0 END AS {c}" for c in 'rgb')}, CAST(floor(255 * a + .5) AS INTEGER) AS a FROM ly QUALIFY row_number() OVER (PARTITION BY image_id, x, y ORDER BY i DESC) = 1""")
def painted_layer(spark: SparkSession, sf: str) -> DataFrame:
    """The canvas of each user after all strokes, erasers and fills, each with its opacity."""
    at = F.col("stroke")
    tool = F.when(at % 6 == 3, "eraser").when(at % 6 == 5, "fill-all").otherwise("brush")
    opacity = F.element_at(F.array(*[F.lit(o) for o in (0.35, 0.6, 0.85, 1.0)]), (at % 4 + 1).cast("int"))
    marks = _marks(spark, sf).select("image_id", "x", "y", at.alias("seq"), "part", tool.alias("tool"), *[(at * k % 256).alias(c) for c, k in (("r", 53), ("g", 101), ("b", 197))], opacity.alias("opacity"))
    return paint.composite(marks, ["image_id", "x", "y"])


# ---- templates with outlines ----


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures of plain areas: cells of 5 x 5 pixels, labelled by the mean of their pixels."""
    cell = Window.partitionBy("image_id", F.floor(F.col("x") / 5), F.floor(F.col("y") / 5))
    label = F.expr("_s * 10 div _n % 3").cast("int")
    return pixels(spark, sf).withColumns({"_s": F.sum("n").over(cell), "_n": F.count(F.lit(1)).over(cell)}).select("image_id", "p", "x", "y", "r", "g", "b", label.alias("label"))


def _template(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Regions of ``_cells`` and their smoothed outlines."""
    found = settle(regions.components(_cells(spark, sf)), "cells")
    return found, vector.chaikin(vector.simplified(vector.trace_loops(vector.boundary_edges(found))))


@query()
def template_highlight(spark: SparkSession, sf: str) -> DataFrame:
    """Traced, simplified and smoothed outlines of the active label of each image, filled."""
    found, lines = _template(spark, sf)
    areas = found.groupBy("image_id", "region_id").agg(F.first("label").alias("color_idx"))
    chosen = areas.select("image_id", (F.col("image_id").cast("int") % 3).alias("color_idx")).distinct()
    return drawing.highlight(lines, areas, catalog_palette(spark).select(F.col("idx").alias("color_idx"), "hex"), chosen)


@query()
def template_export(spark: SparkSession, sf: str) -> DataFrame:
    """Whole templates on white: outlines drawn along their paths, numbers where a queue from the border ends."""
    found, lines = _template(spark, sf)
    points = regions.label_points(found, tie="reference").withColumnRenamed("label", "color_idx")
    blank = found.select("image_id", "x", "y", *[F.lit(0).alias(c) for c in "rgba"])
    images = found.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return drawing.export(blank, drawing.contours(lines, ["image_id"], images=images), drawing.stamp(regions.numbers(points), ["image_id"], images))


@query()
def label_points_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Label points of all regions of the label grid, ties as a queue from the border has them."""
    found = regions.components(stencil.majority(pixels(spark, sf).select("image_id", F.col("p").cast("long").alias("p"), "x", "y", (F.col("n") <= 5).cast("int").alias("label"))))
    return regions.label_points(settle(found, "majority"), tie="reference")


# ---- the store ----


@query(f"WITH {_STORE} SELECT coalesce(c.id, s.id) AS id, coalesce(c.name, s.name) AS name, coalesce(s.created_at, c.updated_at) AS created_at, coalesce(c.updated_at, s.updated_at) AS updated_at FROM store s FULL JOIN changes c USING (id) WHERE coalesce(c.id, s.id) % 11 != 0")
def stored_projects(spark: SparkSession, sf: str) -> DataFrame:
    """Orders saved in a store, changed and deleted from, and read from its third version."""
    first, changes = _store(spark, sf)
    store = ProjectStore(spark, new_path(spark, "store"), "id long, name long, created_at timestamp, updated_at timestamp")
    store.save(first)
    store.save(changes)
    store.delete(first.unionByName(changes).filter("id % 11 = 0").select("id"))
    return store.read()
