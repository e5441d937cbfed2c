"""Drawing: outlines, strokes, numbers and legends become pixels.

A pixel (x, y) has its centre at (x + 0.5, y + 0.5) and is covered where its centre is. Shapes are
exploded to the rows they touch and then to the pixels of each row, so the work is the area that is
drawn; pixels are dealt by image and place, never by image alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.color import digit_color, fill_hex, half_up, stroke_width, symbol_for

#: Widening of rows of candidates, well above rounding; what is covered is decided exactly afterwards.
SLACK = 1e-6
#: Width of the outlines of a template.
OUTLINE = 2.0


def sides(lines: DataFrame, keys: list[str], column: str = "points") -> DataFrame:
    """Directed sides of closed lines (array of x, y): keys, x1, y1, x2, y2. Null and empty lines have none."""
    p = F.col(column)
    after = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    each = lines.select(*keys, F.explode(F.arrays_zip(p.alias("p"), after.alias("q"))).alias("s"))
    return each.select(*keys, F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))


def _rows(low: Column, high: Column, images: DataFrame | None) -> Column:
    """Whole numbers from ``low`` to ``high``, inside the picture if there is one; none if there are none."""
    if images is not None:
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.col("_height") - 1)
    return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))


def _in_picture(shapes: DataFrame, images: DataFrame | None) -> DataFrame:
    if images is None:
        return shapes
    return shapes.join(images.select("image_id", F.col("width").alias("_width"), F.col("height").alias("_height")), "image_id")


def _across(df: DataFrame, keys: list[str], low: Column, high: Column, images: DataFrame | None, *more: Column | str) -> DataFrame:
    """keys, y, x: the pixels of row ``y`` from ``low`` to ``high``, inside the picture if there is one."""
    if images is not None:
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.col("_width") - 1)
    return df.withColumns({"_low": low.cast("int"), "_high": high.cast("int")}).filter("_low <= _high").select(*keys, "y", *more, F.explode(F.sequence("_low", "_high")).alias("x"))


def fill(lines: DataFrame, keys: list[str], images: DataFrame | None = None, column: str = "points") -> DataFrame:
    """keys, x, y: the pixels that the closed lines of a key wind around, by the nonzero rule.

    Each side becomes its crossings with the middle of rows, with the way it goes; along a row the sum
    of the ways so far is the winding number, and where it is not zero lies a run of pixels. A centre on
    a line belongs to what is right of or below it. ``images`` (image_id, width, height) cuts off what lies outside.
    """
    s = _in_picture(sides(lines, keys, column).filter("y1 != y2"), images)
    top, bottom = F.least("y1", "y2"), F.greatest("y1", "y2")
    own = [*keys] + (["_width"] if images is not None else [])
    rows = s.select(*own, "x1", "y1", "x2", "y2", F.explode(_rows(F.ceil(top - 0.5), F.ceil(bottom - 0.5) - 1, images)).alias("y"))
    at = F.col("x1") + (F.col("y") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossings = rows.select(*own, "y", at.alias("_at"), F.when(F.col("y2") > F.col("y1"), 1).otherwise(-1).alias("_way")).groupBy(*own, "y", "_at").agg(F.sum("_way").alias("_way"))
    along = Window.partitionBy(*own, "y").orderBy("_at")
    runs = crossings.withColumns({"_winds": F.sum("_way").over(along), "_next": F.lead("_at").over(along)}).filter("_winds != 0 AND _next IS NOT NULL")
    return _across(runs, keys, F.ceil(F.col("_at") - 0.5), F.ceil(F.col("_next") - 0.5) - 1, images)


def cover(capsules: DataFrame, keys: list[str], images: DataFrame | None = None, many: bool = False) -> DataFrame:
    """keys, x, y: the pixels within ``r`` of the segment (x1, y1) to (x2, y2); with ``many`` once for every capsule, else once.

    A segment of no length is a disc. On each row only the part of the segment within ``r`` of the row
    (and a little more: of a segment that is level but for rounding, all or nothing is) gives candidates; distances
    decide. ``images`` cuts off what lies outside.
    """
    own = ["x1", "y1", "x2", "y2", "r"]
    shapes = _in_picture(capsules.select(*dict.fromkeys([*keys, *own])), images)
    low, high = F.least("y1", "y2") - F.col("r"), F.greatest("y1", "y2") + F.col("r")
    rows = shapes.withColumn("y", F.explode(_rows(F.ceil(low - 0.5 - SLACK), F.floor(high - 0.5 + SLACK), images)))
    dx, dy, cx, cy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("x") + 0.5, F.col("y") + 0.5
    inside = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    at = lambda k: F.when(dy == 0, F.lit(0.0 if k < 0 else 1.0)).otherwise(inside((cy + k * (F.col("r") + SLACK) - F.col("y1")) / dy))
    ends = [F.col("x1") + at(k) * dx for k in (-1, 1)]
    pixels = _across(rows, keys, F.ceil(F.least(*ends) - F.col("r") - 0.5 - SLACK), F.floor(F.greatest(*ends) + F.col("r") - 0.5 + SLACK), images, *[c for c in own if c not in keys])
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(inside(((cx - F.col("x1")) * dx + (cy - F.col("y1")) * dy) / length))
    gap_x, gap_y = cx - (F.col("x1") + t * dx), cy - (F.col("y1") + t * dy)
    met = pixels.filter(gap_x * gap_x + gap_y * gap_y <= F.col("r") * F.col("r")).select(*keys, "x", "y")
    return met if many else met.distinct()


def contours(lines: DataFrame, keys: list[str], width: float = OUTLINE, images: DataFrame | None = None) -> DataFrame:
    """keys, x, y: closed lines drawn with round joins, ``width`` wide."""
    return cover(sides(lines, keys).withColumn("r", F.lit(width / 2)), keys, images)


def brush_pieces(points: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The quadratic pieces of strokes: keys, part, from, via and to (x, y), r.

    points: keys, order, x, y, pressure, size. Piece ``part`` (from 1) ends in the middle of two points and
    is as wide as their mean pressure says; a stroke of one point is a dot (part 0).
    """
    w = Window.partitionBy(*keys).orderBy(order)
    back = points.withColumns({f"{c}{k}": F.lag(c, k).over(w) for c in ("x", "y") for k in (1, 2)} | {"pressure1": F.lag("pressure").over(w), "part": F.row_number().over(w) - 1, "_last": F.lead(order).over(w).isNull()})
    kept = back.filter("part > 0 OR _last")
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    ends = [e for c in ("x", "y") for e in (F.coalesce(middle(f"{c}2", f"{c}1"), F.col(f"{c}1"), F.col(c)).alias(f"from_{c}"), F.coalesce(f"{c}1", c).alias(f"via_{c}"), F.coalesce(middle(f"{c}1", c), F.col(c)).alias(f"to_{c}"))]
    return kept.select(*keys, "part", *ends, (stroke_width(F.col("size"), F.coalesce(middle("pressure1", "pressure"), F.col("pressure"))) / 2).alias("r"))


def flatten(pieces: DataFrame, keys: list[str], tolerance: float = 0.1) -> DataFrame:
    """Quadratic pieces as segments that stay within ``tolerance`` of them: keys, x1, y1, x2, y2, r.

    A chord of one of n equal parts is at most |from - 2 via + to| / (4 n^2) away.
    """
    bend = [F.col(f"from_{c}") - 2 * F.col(f"via_{c}") + F.col(f"to_{c}") for c in "xy"]
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.sqrt(bend[0] * bend[0] + bend[1] * bend[1]) / (4 * tolerance))).cast("int"))
    each = pieces.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def at(c: str, k: Column) -> Column:
        t = k / F.col("_n")
        return (1 - t) * (1 - t) * F.col(f"from_{c}") + 2 * t * (1 - t) * F.col(f"via_{c}") + t * t * F.col(f"to_{c}")

    k = F.col("_k")
    return each.select(*keys, at("x", k).alias("x1"), at("y", k).alias("y1"), at("x", k + 1).alias("x2"), at("y", k + 1).alias("y2"), "r")


def brush_marks(points: DataFrame, keys: list[str], order: str = "seq", images: DataFrame | None = None, tolerance: float = 0.1) -> DataFrame:
    """keys, part, x, y: the pixels each piece of a stroke paints, once a piece (pieces overlap, and each one paints)."""
    named = [*keys, "part"]
    return cover(flatten(brush_pieces(points, keys, order), named, tolerance), named, images)


# The shapes of the symbols, 5 wide and 7 high, row by row.
GLYPHS = {
    "0": "01110 10001 10011 10101 11001 10001 01110", "1": "00100 01100 00100 00100 00100 00100 01110",
    "2": "01110 10001 00001 00110 01000 10000 11111", "3": "11110 00001 00001 01110 00001 00001 11110",
    "4": "00010 00110 01010 10010 11111 00010 00010", "5": "11111 10000 11110 00001 00001 10001 01110",
    "6": "00110 01000 10000 11110 10001 10001 01110", "7": "11111 00001 00010 00100 00100 01000 01000",
    "8": "01110 10001 10001 01110 10001 10001 01110", "9": "01110 10001 10001 01111 00001 00010 01100",
    "A": "01110 10001 10001 11111 10001 10001 10001", "B": "11110 10001 10001 11110 10001 10001 11110",
    "C": "01110 10001 10000 10000 10000 10001 01110", "D": "11110 10001 10001 10001 10001 10001 11110",
    "E": "11111 10000 10000 11110 10000 10000 11111", "F": "11111 10000 10000 11110 10000 10000 10000",
    "G": "01110 10001 10000 10111 10001 10001 01110", "H": "10001 10001 10001 11111 10001 10001 10001",
    "I": "01110 00100 00100 00100 00100 00100 01110", "J": "00111 00010 00010 00010 00010 10010 01100",
    "K": "10001 10010 10100 11000 10100 10010 10001", "L": "10000 10000 10000 10000 10000 10000 11111",
    "M": "10001 11011 10101 10101 10001 10001 10001", "N": "10001 11001 10101 10011 10001 10001 10001",
    "O": "01110 10001 10001 10001 10001 10001 01110", "P": "11110 10001 10001 11110 10000 10000 10000",
    "Q": "01110 10001 10001 10001 10101 10010 01101", "R": "11110 10001 10001 11110 10100 10010 10001",
    "S": "01111 10000 10000 01110 00001 00001 11110", "T": "11111 00100 00100 00100 00100 00100 00100",
    "U": "10001 10001 10001 10001 10001 10001 01110", "V": "10001 10001 10001 10001 10001 01010 00100",
    "W": "10001 10001 10001 10101 10101 11011 10001", "X": "10001 10001 01010 00100 01010 10001 10001",
    "Y": "10001 10001 01010 00100 00100 00100 00100", "Z": "11111 00001 00010 00100 01000 10000 11111",
    "?": "01110 10001 00001 00010 00100 00000 00100",
}
#: How wide and high a symbol is, as a part of its font size.
GLYPH_WIDTH, GLYPH_HEIGHT = 0.5, 0.7


def glyphs(spark: SparkSession) -> DataFrame:
    """The atlas: symbol, cells (35 times 0 or 1, row by row)."""
    return spark.createDataFrame([(s, c.replace(" ", "")) for s, c in GLYPHS.items()], "symbol string, cells string")


def stamp(numbers: DataFrame, keys: list[str], images: DataFrame | None = None) -> DataFrame:
    """keys, x, y: the pixels of symbols written with their middle at (x, y): numbers(keys, symbol, x, y, font_size).

    The atlas, 37 fixed rows, is scaled to the font size and met by the symbols in a broadcast join. A symbol the atlas lacks leaves no mark.
    """
    left, top = F.col("_x") - F.col("font_size") * (GLYPH_WIDTH / 2), F.col("_y") - F.col("font_size") * (GLYPH_HEIGHT / 2)
    cell_x, cell_y = F.col("font_size") * (GLYPH_WIDTH / 5), F.col("font_size") * (GLYPH_HEIGHT / 7)
    named = numbers.select(*keys, "symbol", F.col("x").alias("_x"), F.col("y").alias("_y"), "font_size").join(F.broadcast(glyphs(numbers.sparkSession)), "symbol")
    boxes = _in_picture(named, images)
    rows = boxes.withColumn("y", F.explode(_rows(F.ceil(top - 0.5), F.ceil(top + 7 * cell_y - 0.5) - 1, images)))
    pixels = _across(rows, keys, F.ceil(left - 0.5), F.ceil(left + 5 * cell_x - 0.5) - 1, images, "_x", "_y", "font_size", "cells")
    col = F.floor((F.col("x") + 0.5 - left) / cell_x)
    row = F.floor((F.col("y") + 0.5 - top) / cell_y)
    set_ = F.substring("cells", (row * 5 + col + 1).cast("int"), F.lit(1)) == "1"
    return pixels.filter(col.between(0, 4) & row.between(0, 6) & set_).select(*keys, "x", "y")


# Fixed value: the colour of numbers on a template.
NUMBER_INK = 0x33


def export(paint: DataFrame, lines: DataFrame | None = None, numbers: DataFrame | None = None) -> DataFrame:
    """paint(image_id, x, y, r, g, b, a) over white, opaque, with ``lines`` (image_id, x, y) in black and ``numbers`` over them."""
    k = F.coalesce(F.col("a"), F.lit(0)) / 255.0
    over = {c: half_up(F.coalesce(F.col(c), F.lit(0)) * k + 255.0 * (1 - k)).cast("int") for c in ("r", "g", "b")} | {"a": F.lit(255)}
    inks = [df.select("image_id", "x", "y", F.lit(ink).alias("_ink")) for df, ink in ((lines, 0), (numbers, NUMBER_INK)) if df is not None]
    if not inks:
        return paint.withColumns(over)
    ink = (inks[0] if len(inks) == 1 else inks[0].unionByName(inks[1])).groupBy("image_id", "x", "y").agg(F.max("_ink").alias("_ink"))
    drawn = paint.join(ink, ["image_id", "x", "y"], "left")
    return drawn.withColumns({c: F.coalesce(F.col("_ink"), over[c]) for c in ("r", "g", "b")} | {"a": F.lit(255)}).drop("_ink")


def highlight(outlines: DataFrame, regions: DataFrame, palette: DataFrame, chosen: DataFrame, opacity: float = 0.35, images: DataFrame | None = None) -> DataFrame:
    """image_id, x, y, r, g, b, a: the outlines of the regions of the ``chosen`` colour, each filled with ``opacity`` of it.

    outlines: image_id, region_id, points (closed lines; those of one region are filled as one path); regions: image_id,
    region_id, color_idx; palette: color_idx, hex (and image_id where palettes differ); chosen: image_id, color_idx. Where smoothed
    outlines of n regions overlap, the colour is laid on n times. A colour without a hex text or without regions gives no pixel.
    """
    keys = [c for c in ("image_id", "color_idx") if c in palette.columns]
    active = regions.select("image_id", "region_id", "color_idx").join(chosen, ["image_id", "color_idx"], "left_semi").join(palette.filter("hex IS NOT NULL").select(*keys, "hex"), keys)
    filled = fill(outlines.join(active.select("image_id", "region_id", "hex"), ["image_id", "region_id"]), ["image_id", "region_id", "hex"], images)
    layers = filled.groupBy("image_id", "x", "y", "hex").agg(F.count(F.lit(1)).alias("_n"))
    r, g, b = fill_hex(F.col("hex"))
    return layers.select("image_id", "x", "y", r.alias("r"), g.alias("g"), b.alias("b"), half_up(255 * (1 - F.pow(F.lit(1 - opacity), F.col("_n")))).cast("int").alias("a"))


# The strip under an exported picture.
STRIP = 0x11
CELL_LEAST, CELLS_ACROSS, COLUMNS_LEAST, STRIP_MARGIN, SWATCH_PAD, SYMBOL_SIZE, SYMBOL_DROP = 44, 12, 6, 0.4, 0.12, 0.52, 0.04


def legend_layout(palette: DataFrame, images: DataFrame) -> DataFrame:
    """Where each colour of an image's legend goes, under the picture.

    palette: image_id, idx, hex; images: image_id, width, height. Gives those with cell, cols, strip (its exact height), place
    (the rank of idx in its image), and the swatch: left, top, size.
    """
    by = Window.partitionBy("image_id")
    cell = F.greatest(F.lit(CELL_LEAST), half_up(F.col("width") / CELLS_ACROSS)).cast("int")
    sized = palette.select("image_id", "idx", "hex").join(images.select("image_id", "width", "height"), "image_id")
    sized = sized.withColumns({"cell": cell, "_n": F.count(F.lit(1)).over(by), "place": F.row_number().over(by.orderBy("idx")) - 1})
    sized = sized.withColumn("cols", F.least(F.col("_n"), F.greatest(F.lit(COLUMNS_LEAST), F.floor(F.col("width") / F.col("cell")))).cast("int"))
    col, row = F.col("place") % F.col("cols"), F.floor(F.col("place") / F.col("cols"))
    strip = F.ceil(F.col("_n") / F.col("cols")) * F.col("cell") + F.col("cell") * STRIP_MARGIN
    left = (F.col("width") - F.col("cols") * F.col("cell")) / 2 + col * F.col("cell") + F.col("cell") * SWATCH_PAD
    top = F.col("height") + F.col("cell") * (STRIP_MARGIN / 2) + row * F.col("cell") + F.col("cell") * SWATCH_PAD
    return sized.select("image_id", "idx", "hex", "width", "height", "cell", "cols", strip.alias("strip"), "place", left.alias("left"), top.alias("top"), (F.col("cell") * (1 - 2 * SWATCH_PAD)).alias("size"))


def legend_strip(palette: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, x, y, r, g, b, a: the pixels of the strip under each picture, a swatch with its symbol for every colour.

    Swatches and the lower end of the strip do not end at whole pixels: a pixel takes as much of a colour as its square
    is covered. Rows go on below the picture, from y = height. Symbols are drawn over them.
    """
    places = legend_layout(palette, images)
    strips = places.groupBy("image_id", "width", "height", "strip").agg(F.count(F.lit(1)).alias("_n"))
    first, last = F.col("height"), F.col("height") + half_up(F.col("strip")).cast("int") - 1
    ground = strips.withColumn("y", F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - 1)))
    ground = ground.select("image_id", "x", "y", half_up(255 * F.least(F.lit(1.0), F.col("height") + F.col("strip") - F.col("y"))).cast("int").alias("a"))
    span = lambda at, size: F.sequence(F.floor(at).cast("int"), F.ceil(at + size).cast("int") - 1)
    part = lambda p, at: F.least(p + 1, at + F.col("size")) - F.greatest(p.cast("double"), at)
    swatch = places.withColumn("y", F.explode(span(F.col("top"), F.col("size")))).withColumn("x", F.explode(span(F.col("left"), F.col("size"))))
    swatch = swatch.select("image_id", "x", "y", "hex", (part(F.col("x"), F.col("left")) * part(F.col("y"), F.col("top"))).alias("_part"))
    size = half_up(F.col("size") * SYMBOL_SIZE)
    signs = places.select("image_id", digit_color(F.col("hex")).alias("_sign"), symbol_for(F.col("place")).alias("symbol"), (F.col("left") + F.col("size") / 2).alias("x"), (F.col("top") + F.col("size") / 2 + size * SYMBOL_DROP).alias("y"), size.alias("font_size"))
    marks = stamp(signs, ["image_id", "_sign"])
    over = swatch.select("image_id", "x", "y", "hex", "_part", F.lit(None).cast("string").alias("_sign")).unionByName(marks.select("image_id", "x", "y", F.lit(None).cast("string").alias("hex"), F.lit(None).cast("double").alias("_part"), "_sign"))
    over = over.groupBy("image_id", "x", "y").agg(F.max("hex").alias("hex"), F.max("_part").alias("_part"), F.max("_sign").alias("_sign"))
    seen = ground.join(over, ["image_id", "x", "y"], "left")
    part_ = F.coalesce("_part", F.lit(0.0))
    channel = lambda k: F.when(F.col("_sign").isNotNull(), fill_hex(F.col("_sign"))[k]).otherwise(half_up(STRIP * (1 - part_) + F.when(F.col("hex").isNull(), F.lit(0)).otherwise(fill_hex(F.col("hex"))[k]) * part_)).cast("int")
    return seen.select("image_id", "x", "y", *[channel(k).alias(c) for k, c in enumerate("rgb")], "a")
