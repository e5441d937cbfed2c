"""The queries over the given tables, with DuckDB SQL for those that SQL can express.

Rasters come from ``lineitem`` (one image a supplier, 20 pixels wide) and from a drawn scene; colour
points from ``embeddings``, paint logs from ``events``, projects from ``orders``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import paint, raster, regions, stencil, superpixel, vector
from ..operators import palette as pal
from ..sources import catalog, projects
from . import convert as template

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The colours of the first picture of the catalog.
CATALOG_COLORS = ("#17223d", "#315f7e", "#5d91a3", "#d48f5e", "#f4d58a", "#29473f", "#f7eee0")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without negative zero."""
    return df.select(*[(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- inputs ----

WIDTH = 20
REFINED = 48
FITTED = 200


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    p = F.row_number().over(w) - 1
    t = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("image_id"), p.alias("p"), C.half_up((F.col("l_quantity") - 1) * 255 / 49).cast("int").alias("r"), C.half_up(F.col("l_discount") * 2550).cast("int").alias("g"), C.half_up(F.col("l_tax") * 255 / 0.08).cast("int").alias("b"), F.col("l_linenumber").alias("n"))
    return t.select("*", (F.col("p") % WIDTH).cast("int").alias("x"), F.floor(F.col("p") / WIDTH).cast("int").alias("y"))


PX = """px AS MATERIALIZED (
  SELECT *, CAST(p % 20 AS INTEGER) AS x, CAST(p // 20 AS INTEGER) AS y FROM (
    SELECT CAST(l_suppkey AS VARCHAR) AS image_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS p,
      CAST(floor((l_quantity - 1) * 255 / 49 + .5) AS INTEGER) AS r, CAST(floor(l_discount * 2550 + .5) AS INTEGER) AS g, CAST(floor(l_tax * 255 / 0.08 + .5) AS INTEGER) AS b, l_linenumber AS n FROM lineitem))"""


def sql_lab(r: str, g: str, b: str) -> tuple[str, str, str]:
    lin = lambda c: f"(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"
    f = lambda t: f"(CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787::DOUBLE * {t} + 16.0::DOUBLE / 116 END)"
    x, y, z = (f(f"(({m[0]}::DOUBLE * {lin(r)} + {m[1]}::DOUBLE * {lin(g)} + {m[2]}::DOUBLE * {lin(b)}) / {w}::DOUBLE)") for m, w in zip(C.TO_XYZ, C.WHITE, strict=True))
    return f"(116 * {y} - 16)", f"(500 * ({x} - {y}))", f"(200 * ({y} - {z}))"


_L, _A, _B = sql_lab("r", "g", "b")
LAB = f"{PX}, lab AS (SELECT image_id, p, x, y, n, r, g, b, {_L} AS \"L\", {_A} AS a, {_B} AS bb FROM px)"


def lab_pixels(spark: SparkSession, sf: str) -> DataFrame:
    lab = C.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return pixels(spark, sf).select("image_id", "p", "x", "y", "n", *[c.alias(k) for c, k in zip(lab, ("L", "a", "b"), strict=True)])


def colors(spark: SparkSession, sf: str) -> DataFrame:
    e = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf, "embeddings").select("vec_id", "label", (50 + 100 * e(0)).alias("L"), (200 * e(1)).alias("a"), (200 * e(2)).alias("b"))


COLORS = "colors AS (SELECT vec_id, label, 50 + 100 * embedding[1]::DOUBLE AS \"L\", 200 * embedding[2]::DOUBLE AS a, 200 * embedding[3]::DOUBLE AS b FROM embeddings)"


def catalog_palette(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(CATALOG_COLORS)), "idx int, hex string")
    lab = C.rgb_to_lab(*C.parse_hex(F.col("hex")))
    return rows.select("idx", "hex", *[c.alias(k) for c, k in zip(lab, ("L", "a", "b"), strict=True)])


def literal_palette(spark: SparkSession) -> list[tuple[int, float, float, float]]:
    """The catalog palette as values: a fixed handful of colours."""
    return [tuple(r) for r in catalog_palette(spark).select("idx", "L", "a", "b").orderBy("idx").collect()]


def _channel(at: int) -> str:
    return f"CAST('0x' || substr(hex, {at}, 2) AS INTEGER)"


PALETTE = "pal AS (SELECT idx, hex, {} AS \"L\", {} AS a, {} AS b FROM (VALUES {}) v(idx, hex))".format(*sql_lab(_channel(2), _channel(4), _channel(6)), ", ".join(f"({i}, '{h}')" for i, h in enumerate(CATALOG_COLORS)))

_FONT_OF = "CAST(least(48, greatest(10, floor(sqrt(area) / 3 + .5))) AS INTEGER)"
SYMBOL = "CASE WHEN idx BETWEEN 0 AND 8 THEN CAST(idx + 1 AS VARCHAR) WHEN idx = 9 THEN '0' WHEN idx BETWEEN 10 AND 35 THEN chr(CAST(55 + idx AS INTEGER)) ELSE '?' END"


def log(spark: SparkSession, sf: str) -> DataFrame:
    tool = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("brush")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select(F.col("user_id").alias("project_id"), seq.cast("long").alias("seq"), "event_id", tool.alias("tool"), F.col("value").alias("size"), "props")


LOG = """log AS (SELECT user_id AS project_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id,
  CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'brush' END AS tool, value AS size, props FROM events)"""


_NEAR4 = """nb AS MATERIALIZED (SELECT a.image_id, a.p, b.p AS q, a.label = b.label AS same FROM lb a JOIN (VALUES (1), (-1), (20), (-20)) d(k) ON true JOIN lb b ON b.image_id = a.image_id AND b.p = a.p + d.k AND (abs(d.k) = 20 OR a.y = b.y))"""
_REGION = f"""{_NEAR4}, reach(image_id, p, root) AS (SELECT image_id, p, p FROM lb WHERE NOT EXISTS (SELECT 1 FROM nb WHERE nb.image_id = lb.image_id AND nb.p = lb.p AND same AND q < lb.p)
  UNION SELECT nb.image_id, nb.q, reach.root FROM reach JOIN nb ON nb.image_id = reach.image_id AND nb.p = reach.p AND same),
reg AS (SELECT s.*, dense_rank() OVER (PARTITION BY image_id ORDER BY root) - 1 AS region_id FROM lb s JOIN (SELECT image_id, p, min(root) AS root FROM reach GROUP BY ALL) r USING (image_id, p))"""


def found_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The regions of the label grids of all images."""
    return regions.components(labels(spark, sf)).withColumn("region_id", F.col("region_id").cast("long"))


# ---- colour ----


@query(f"""WITH {LAB}, {PALETTE}, near AS (
  SELECT p.idx, p.hex FROM (SELECT image_id, p, arg_min(idx, struct_pack(d, idx)) AS idx FROM (
    SELECT l.image_id, l.p, q.idx, round((l."L" - q."L") ** 2 + (l.a - q.a) ** 2 + (l.bb - q.b) ** 2, 9) AS d FROM lab l, pal q) GROUP BY ALL) JOIN pal p USING (idx))
SELECT idx, {SYMBOL} AS symbol, hex, CASE WHEN 0.299 * {_channel(2)} + 0.587 * {_channel(4)} + 0.114 * {_channel(6)} >= 128 THEN '#1c1917' ELSE '#ffffff' END AS digit,
  count(*) AS pixel_count, row_number() OVER (ORDER BY count(*) DESC, idx) - 1 AS rank FROM near GROUP BY idx, hex""")
def palette_histogram(spark: SparkSession, sf: str) -> DataFrame:
    counted = pal.nearest_of(lab_pixels(spark, sf), literal_palette(spark)).groupBy("idx").agg(F.count(F.lit(1)).alias("pixel_count"))
    named = counted.join(F.broadcast(catalog_palette(spark).select("idx", "hex")), "idx").withColumn("image_id", F.lit(0))
    return template.ranked(named).select("idx", C.symbol_for(F.col("idx")).alias("symbol"), "hex", C.digit_color(F.col("hex")).alias("digit"), "pixel_count", F.col("rank").cast("long").alias("rank"))


@query(f'WITH {LAB} SELECT image_id, p, round("L", 6) + 0.0 AS "L", round(a, 6) + 0.0 AS a, round(bb, 6) + 0.0 AS b FROM lab')
def lab_convert(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lab_pixels(spark, sf).select("image_id", F.col("p").cast("long").alias("p"), "L", "a", "b"))


@query(f"WITH {PX} SELECT image_id, p, r, g, b, '#' || printf('%02x%02x%02x', r, g, b) AS hex FROM px")
def lab_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    lab = [F.col(c) for c in ("L", "a", "b")]
    r, g, b = C.lab_to_rgb(*lab)
    return lab_pixels(spark, sf).select("image_id", F.col("p").cast("long").alias("p"), r.alias("r"), g.alias("g"), b.alias("b"), C.lab_to_hex(*lab).alias("hex"))


_DE = """pairs AS (SELECT p.vec_id AS p_id, q.vec_id AS q_id, p."L" AS l1, p.a AS a1, p.b AS b1, q."L" AS l2, q.a AS a2, q.b AS b2 FROM colors p JOIN colors q ON q.vec_id = p.vec_id + 1),
s1 AS (SELECT *, (sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2 AS m FROM pairs),
s2 AS (SELECT *, (1.5 - 0.5 * sqrt(m ** 7 / (m ** 7 + 25.0::DOUBLE ** 7))) AS g FROM s1),
s3 AS (SELECT *, sqrt(g * a1 * g * a1 + b1 * b1) AS c1, sqrt(g * a2 * g * a2 + b2 * b2) AS c2, degrees(atan2(b1, g * a1)) AS t1, degrees(atan2(b2, g * a2)) AS t2 FROM s2),
s4 AS (SELECT *, t1 + CASE WHEN t1 < 0 THEN 360 ELSE 0 END AS h1, t2 + CASE WHEN t2 < 0 THEN 360 ELSE 0 END AS h2 FROM s3),
s5 AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm, (l1 + l2) / 2 - 50 AS lm, (c1 + c2) / 2 AS cm FROM s4),
s6 AS (SELECT *, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.2 * cos(radians(4 * hm - 63)) AS t,
  (l2 - l1) / (1 + 0.015 * lm * lm / sqrt(20 + lm * lm)) AS dl, (c2 - c1) / (1 + 0.045 * cm) AS dc, -sin(radians(60 * exp(-(((hm - 275) / 25) ** 2)))) * 2 * sqrt(cm ** 7 / (cm ** 7 + 25.0::DOUBLE ** 7)) AS rt FROM s5),
s7 AS (SELECT *, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * cm * t) AS dd FROM s6)"""


@query(f"WITH {COLORS}, {_DE} SELECT p_id, q_id, round(sqrt(greatest(0.0, dl * dl + dc * dc + dd * dd + rt * dc * dd)), 6) AS de FROM s7")
def ciede2000_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = colors(spark, sf)
    q = c.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("q_id"), *[F.col(k).alias(f"q_{k}") for k in ("L", "a", "b")])
    return rounded(C.with_ciede2000(c.join(q, "vec_id"), ["L", "a", "b"], ["q_L", "q_a", "q_b"]).select(F.col("vec_id").alias("p_id"), "q_id", "de"))


@query(f"""WITH {COLORS}, {PALETTE} SELECT vec_id, arg_min(idx, struct_pack(d, idx)) AS idx, round(min(d), 6) AS d FROM (
  SELECT c.vec_id, p.idx, round(sqrt((c."L" - p."L") ** 2 + (c.a - p.a) ** 2 + (c.b - p.b) ** 2), 9) AS d FROM colors c, pal p) GROUP BY vec_id""")
def cie76_nearest(spark: SparkSession, sf: str) -> DataFrame:
    near = pal.nearest_of(colors(spark, sf), literal_palette(spark))
    return rounded(near.select("vec_id", "idx", F.sqrt("d").alias("d")))


_HEXES = "texts AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN ' #' || substr(md5(p_name), 1, 6) WHEN 1 THEN substr(md5(p_name), 1, 3) WHEN 2 THEN '#' || substr(md5(p_name), 1, 5) WHEN 3 THEN p_brand ELSE upper(substr(md5(p_name), 1, 6)) END AS t FROM part)"


def _hex_texts(spark: SparkSession, sf: str) -> DataFrame:
    md5, kind = F.md5(F.col("p_name").cast("binary")), F.col("p_size") % 5
    t = F.when(kind == 0, F.concat(F.lit(" #"), F.substring(md5, 1, 6))).when(kind == 1, F.substring(md5, 1, 3)).when(kind == 2, F.concat(F.lit("#"), F.substring(md5, 1, 5))).when(kind == 3, F.col("p_brand")).otherwise(F.upper(F.substring(md5, 1, 6)))
    return table(spark, sf, "part").select("p_partkey", t.alias("t"))


@query(f"""WITH {_HEXES}, h AS (SELECT p_partkey, regexp_extract(trim(t), '^#?([0-9a-fA-F]{{6}}|[0-9a-fA-F]{{3}})$', 1) AS h, regexp_extract(t, '^#?([0-9a-fA-F]{{6}})$', 1) AS f FROM texts),
w AS (SELECT p_partkey, CASE WHEN len(h) = 3 THEN h[1] || h[1] || h[2] || h[2] || h[3] || h[3] WHEN len(h) = 6 THEN h END AS h, CASE WHEN f = '' THEN 'ffffff' ELSE f END AS f FROM h)
SELECT p_partkey, CAST('0x' || h[1:2] AS INTEGER) AS r, CAST('0x' || h[3:4] AS INTEGER) AS g, CAST('0x' || h[5:6] AS INTEGER) AS b, CAST('0x' || f[1:2] AS INTEGER) AS fill_r,
  CASE WHEN 0.299 * CAST('0x' || h[1:2] AS INTEGER) + 0.587 * CAST('0x' || h[3:4] AS INTEGER) + 0.114 * CAST('0x' || h[5:6] AS INTEGER) >= 128 THEN '#1c1917' ELSE '#ffffff' END AS digit FROM w""")
def hex_parse(spark: SparkSession, sf: str) -> DataFrame:
    r, g, b = C.parse_hex(F.col("t"))
    return _hex_texts(spark, sf).select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"), C.fill_hex(F.col("t"))[0].alias("fill_r"), C.digit_color(F.col("t")).alias("digit"))


@query(f"""WITH i AS (SELECT p_partkey, p_size AS idx, p_retailprice FROM part), s AS (SELECT *, {SYMBOL} AS symbol FROM i)
SELECT p_partkey, symbol, CASE WHEN symbol = '0' THEN 9 WHEN symbol BETWEEN '1' AND '9' THEN ascii(symbol) - 49 WHEN symbol != '?' THEN ascii(symbol) - 55 END AS back,
  CAST(least(48, greatest(10, floor(sqrt(p_retailprice) / 3 + .5))) AS INTEGER) AS font_size, round(idx * (0.25 + 0.75 * least(1.0, p_retailprice / 1500)), 6) AS stroke FROM s""")
def symbol_map(spark: SparkSession, sf: str) -> DataFrame:
    s = C.symbol_for(F.col("p_size"))
    return rounded(table(spark, sf, "part").select("p_partkey", s.alias("symbol"), C.index_for_symbol(s).alias("back"), C.font_size(F.col("p_retailprice")).alias("font_size"), C.stroke_width(F.col("p_size"), F.col("p_retailprice") / 1500).alias("stroke")))


@query("""SELECT o_orderkey, round(s, 6) AS scale, round((1000 - w * s) / 2, 6) AS tx, round((700 - h * s) / 2, 6) AS ty, round((100 - (1000 - w * s) / 2) / s, 6) AS cx FROM (
  SELECT *, least(12.0::DOUBLE, greatest(0.05::DOUBLE, least(976.0::DOUBLE / w, 676.0::DOUBLE / h))) AS s FROM (SELECT o_orderkey, 1 + o_orderkey % 977 AS w, 1 + o_custkey % 613 AS h FROM orders))""")
def view_fit(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 977).alias("w"), (1 + F.col("o_custkey") % 613).alias("h"))
    s, tx, ty = C.fit_to(F.col("w"), F.col("h"), 1000.0, 700.0)
    return rounded(o.select("o_orderkey", s.alias("scale"), tx.alias("tx"), ty.alias("ty"), C.to_canvas(F.lit(100.0), F.lit(0.0), s, tx, ty)[0].alias("cx")))


# ---- rasters and stencils ----


@query(f"""WITH {PX}, sz AS (SELECT image_id, w, h, CAST(greatest(1, floor(w * k + .5)) AS BIGINT) AS nw, CAST(greatest(1, floor(h * k + .5)) AS BIGINT) AS nh FROM (SELECT *, least(1.0::DOUBLE, 16 / greatest(w, h)::DOUBLE) AS k FROM (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY image_id))),
t AS (SELECT *, unnest(range(nh)) AS y FROM (SELECT *, unnest(range(nw)) AS x FROM sz)), s AS (SELECT *, least(w - 1.0::DOUBLE, (x + .5::DOUBLE) * (w / nw::DOUBLE) - .5::DOUBLE) AS sx, least(h - 1.0::DOUBLE, (y + .5::DOUBLE) * (h / nh::DOUBLE) - .5::DOUBLE) AS sy FROM t),
f AS (SELECT *, CAST(greatest(0, floor(sx)) AS INTEGER) AS x0, CAST(greatest(0, floor(sy)) AS INTEGER) AS y0, greatest(0.0, sx - greatest(0, floor(sx))) AS fx, greatest(0.0, sy - greatest(0, floor(sy))) AS fy FROM s),
k AS (SELECT image_id, x, y, least(w - 1, x0 + dx) AS ax, least(h - 1, y0 + dy) AS ay, (CASE dx WHEN 1 THEN fx ELSE 1 - fx END) * (CASE dy WHEN 1 THEN fy ELSE 1 - fy END) AS k FROM f, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy))
SELECT k.image_id, CAST(k.x AS INTEGER) AS x, CAST(k.y AS INTEGER) AS y, round(sum(px.r * k), 6) AS r FROM k JOIN px ON px.image_id = k.image_id AND px.x = ax AND px.y = ay GROUP BY ALL""")
def downscale_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    """All images reduced to 16 pixels at most; where an image lacks the end of its last row, the taps that are there are summed."""
    return rounded(raster.downscale(pixels(spark, sf), 16, ("r",)))


@query(f"WITH {PX} SELECT image_id, p, round(CASE WHEN g < 250 THEN r * g / 255.0::DOUBLE + 255 * (1 - g / 255.0::DOUBLE) ELSE r END, 6) AS r FROM px")
def white_matte(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(raster.white_matte(pixels(spark, sf), "g", ("r",)).select("image_id", F.col("p").cast("long").alias("p"), "r"))


def _sql_box(source: str, name: str, columns: list[str], r: int) -> str:
    mean = lambda c, key, at, last: f"(coalesce(sum({c}) OVER (PARTITION BY image_id, {key} ORDER BY {at} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING), 0) + greatest(0, {r} - {at}) * first({c}) OVER w + greatest(0, {at} + {r} - max({at}) OVER w) * last({c}) OVER w) / {2 * r + 1} AS {c}"
    step = lambda src, key, at: f"SELECT * EXCLUDE ({', '.join(columns)}), {', '.join(mean(c, key, at, '') for c in columns)} FROM {src} WINDOW w AS (PARTITION BY image_id, {key} ORDER BY {at} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"{name}_h AS ({step(source, 'y', 'x')}), {name} AS ({step(name + '_h', 'x', 'y')})"


@query(f"WITH {PX}, src AS (SELECT image_id, p, x, y, r::DOUBLE AS r FROM px), {_sql_box('src', 'box', ['r'], 3)} SELECT image_id, p, round(r, 6) AS r FROM box")
def box_filter_edge(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stencil.box_mean(pixels(spark, sf).withColumn("r", F.col("r").cast("double")), ["r"], 3).select("image_id", F.col("p").cast("long").alias("p"), "r"))


@query(f"""WITH {PX}, src AS (SELECT image_id, p, x, y, r::DOUBLE AS i, r::DOUBLE AS m, r::DOUBLE * r AS s FROM px), {_sql_box('src', 'one', ['m', 's'], 3)},
k AS (SELECT image_id, p, x, y, i, m AS m0, greatest(0.0, s - m * m) / (greatest(0.0, s - m * m) + 80.0) AS s FROM one), ab AS (SELECT image_id, p, x, y, i, m0 * (1 - s) AS m, s FROM k), {_sql_box('ab', 'two', ['m', 's'], 3)}
SELECT image_id, p, round(s * i + m, 6) AS r FROM two""")
def guided_filter(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stencil.guided_filter(pixels(spark, sf).withColumn("r", F.col("r").cast("double")), ["r"]).select("image_id", F.col("p").cast("long").alias("p"), "r"))


_NEAR = "lag({0}) OVER h AS l, lead({0}) OVER h AS r_, lag({0}) OVER v AS u, lead({0}) OVER v AS d"
_HV = "WINDOW h AS (PARTITION BY image_id, y ORDER BY x), v AS (PARTITION BY image_id, x ORDER BY y)"


@query(f"WITH {PX}, q AS (SELECT image_id, p, {_NEAR.format('r')} FROM px {_HV}) SELECT image_id, p, CAST(coalesce((r_ - l) * (r_ - l) + (d - u) * (d - u), 0) AS DOUBLE) AS grad FROM q")
def gradient(spark: SparkSession, sf: str) -> DataFrame:
    return stencil.gradient(pixels(spark, sf).withColumn("r", F.col("r").cast("double")), "r").select("image_id", F.col("p").cast("long").alias("p"), "grad")


_LABEL = "lb AS MATERIALIZED (SELECT image_id, p, x, y, CAST(n <= 5 AS INTEGER) AS label FROM px)"


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).select("image_id", F.col("p").cast("long").alias("p"), "x", "y", (F.col("n") <= 5).cast("int").alias("label"))


def _sql_majority(source: str, name: str) -> str:
    votes = f"""{name}_v AS (SELECT a.image_id, a.p, b.label, count(*) AS n, sum(count(*)) OVER (PARTITION BY a.image_id, a.p) AS near FROM {source} a JOIN {source} b
      ON a.image_id = b.image_id AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND a.p != b.p GROUP BY a.image_id, a.p, b.label)"""
    return f"{votes}, {name} AS (SELECT s.image_id, s.p, s.x, s.y, coalesce(v.label, s.label) AS label FROM {source} s LEFT JOIN {name}_v v ON v.image_id = s.image_id AND v.p = s.p AND v.n >= 6 AND v.near = 8)"


@query(f"WITH {PX}, {_LABEL}, {_sql_majority('lb', 'm1')}, {_sql_majority('m1', 'm2')} SELECT image_id, p, label FROM m2")
def majority_filter(spark: SparkSession, sf: str) -> DataFrame:
    return stencil.majority(labels(spark, sf)).select("image_id", "p", "label")


@query(f"WITH {PX}, {_LABEL}, q AS (SELECT image_id, p, label, {_NEAR.format('label')} FROM lb {_HV}) SELECT image_id, p, CAST(coalesce(l != label, false) OR coalesce(r_ != label, false) OR coalesce(u != label, false) OR coalesce(d != label, false) AS INTEGER) AS contour FROM q")
def contour_mask(spark: SparkSession, sf: str) -> DataFrame:
    return stencil.contour_mask(labels(spark, sf)).select("image_id", "p", "contour")


@query(f"WITH {PX}, {_LABEL}, q AS (SELECT image_id, p, label, {_NEAR.format('label')} FROM lb {_HV}) SELECT image_id, p, CAST(coalesce(l != label, true) OR coalesce(r_ != label, true) OR coalesce(u != label, true) OR coalesce(d != label, true) AS INTEGER) AS border FROM q")
def border_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return stencil.border(labels(spark, sf), "label").select("image_id", "p", "border")


@query(f"WITH {PX}, {_LABEL}, q AS (SELECT image_id, x, y, label, {_NEAR.format('label')} FROM lb {_HV}), m AS (SELECT * FROM q WHERE l != label OR r_ != label OR u != label OR d != label) SELECT DISTINCT image_id, x + dx AS x, y + dy AS y FROM m, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy)")
def contour_dilate(spark: SparkSession, sf: str) -> DataFrame:
    return stencil.dilate2(stencil.contour_mask(labels(spark, sf)))


@query("""WITH c AS (SELECT s_suppkey, range AS k, range % 12 AS gx, range // 12 AS gy, 120 + 12 * (s_suppkey % 31) AS w, 80 + 7 * (s_suppkey % 23) AS h, 3 + s_suppkey % 5 AS n, s_suppkey % 11 AS seed FROM supplier, range(96)),
e AS (SELECT *, gx * w // 12 AS x0, (gx + 1) * w // 12 AS x1, gy * h // 8 AS y0, (gy + 1) * h // 8 AS y1 FROM c)
SELECT s_suppkey AS image_id, k AS region_id, CAST((gx * 3 + gy * 5 + seed) % n AS INTEGER) AS color_idx, (x1 - x0) * (y1 - y0) AS area, (x0 + x1) / 2.0::DOUBLE AS label_x, (y0 + y1) / 2.0::DOUBLE AS label_y, 13 AS font_size FROM e""")
def catalog_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Drawings of cells in the sizes, colours and seeds of the suppliers."""
    s = F.col("s_suppkey")
    images = table(spark, sf, "supplier").select(s.alias("image_id"), (120 + 12 * (s % 31)).alias("width"), (80 + 7 * (s % 23)).alias("height"), (3 + s % 5).alias("colors"), (s % 11).alias("seed"))
    return raster.catalog_grid(images)


@query(f"WITH {PX}, {_LABEL}, {PALETTE} SELECT image_id, p, coalesce({_channel(2)}, 255) AS r, coalesce({_channel(4)}, 255) AS g, coalesce({_channel(6)}, 255) AS b, 255 AS a FROM lb LEFT JOIN pal ON label > 0 AND idx = (label + CAST(image_id AS INTEGER)) % 9")
def fill_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Label grids painted; regions without a row and colours without a palette entry are white."""
    found = labels(spark, sf).withColumn("region_id", F.col("label").cast("long"))
    color = ((F.col("region_id") + F.col("image_id").cast("int")) % 9).cast("int")
    known = found.filter("label > 0").select("image_id", "region_id", color.alias("color_idx")).distinct()
    return raster.fill_pixels(found, known, catalog_palette(spark)).select("image_id", "p", "r", "g", "b", "a")


# ---- superpixels and palettes ----


SUPERPIXELS = 12
_CENTERS = f"""im AS (SELECT *, sqrt(w * h / {SUPERPIXELS}.0::DOUBLE) AS step FROM (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM lab GROUP BY image_id)),
gd AS (SELECT *, CAST(greatest(1, floor(w / step + .5)) AS BIGINT) AS nc, CAST(greatest(1, floor(h / step + .5)) AS BIGINT) AS nr FROM im), ck AS (SELECT *, unnest(range(nc * nr)) AS k FROM gd),
ce AS (SELECT image_id, w, h, step, CAST(k AS INTEGER) AS c, CAST(least(w - 1, floor((k % nc + .5) * (w / nc::DOUBLE) + .5)) AS INTEGER) AS cx, CAST(least(h - 1, floor((k // nc + .5) * (h / nr::DOUBLE) + .5)) AS INTEGER) AS cy FROM ck)"""


def _centers(spark: SparkSession, sf: str) -> DataFrame:
    """Centres of the superpixels of all images."""
    return superpixel.centers_of(raster.sizes(pixels(spark, sf)).withColumn("count", F.lit(SUPERPIXELS)))


@query(f"WITH {LAB}, {_CENTERS} SELECT image_id, c, cx, cy FROM ce")
def slic_centers(spark: SparkSession, sf: str) -> DataFrame:
    return _centers(spark, sf).select("image_id", "c", "cx", "cy")


_GRAD = f"""gq AS (SELECT image_id, x, y, lag("L") OVER h AS l, lead("L") OVER h AS r_, lag("L") OVER v AS u, lead("L") OVER v AS d FROM lab {_HV}), gr AS (SELECT image_id, x, y, coalesce((r_ - l) * (r_ - l) + (d - u) * (d - u), 0) AS g FROM gq)"""


@query(f"""WITH RECURSIVE {LAB}, {_CENTERS}, {_GRAD}, wk(image_id, c, w, h, k, x, y, g) AS (SELECT image_id, c, w, h, 0, cx, cy, CAST('inf' AS DOUBLE) FROM ce UNION ALL
  SELECT a.image_id, a.c, a.w, a.h, a.k + 1, CASE WHEN gr.g < a.g THEN gr.x ELSE a.x END, CASE WHEN gr.g < a.g THEN gr.y ELSE a.y END, CASE WHEN gr.g < a.g THEN gr.g ELSE a.g END
  FROM wk a LEFT JOIN gr ON gr.image_id = a.image_id AND gr.x = CAST(least(a.w - 1, greatest(0, a.x + a.k % 3 - 1)) AS INTEGER) AND gr.y = CAST(least(a.h - 1, greatest(0, a.y + a.k // 3 - 1)) AS INTEGER) WHERE a.k < 9)
SELECT image_id, c, x AS cx, y AS cy FROM wk WHERE k = 9""")
def slic_nudge(spark: SparkSession, sf: str) -> DataFrame:
    """Centres walked towards low gradients."""
    return superpixel.nudge(_centers(spark, sf), stencil.gradient(lab_pixels(spark, sf))).select("image_id", "c", "cx", "cy")


_SLIC = f"""{LAB}, {_CENTERS}, ch AS (SELECT e.*, "L" AS cl, a AS ca, bb AS cb FROM ce e JOIN lab l ON l.image_id = e.image_id AND l.x = cx AND l.y = cy),
s0 AS (SELECT l.image_id, l.p, arg_min(c, struct_pack(d, c)) AS sp FROM (SELECT l.image_id, l.p, c, round((l."L" - cl) ** 2 + (l.a - ca) ** 2 + (l.bb - cb) ** 2 + 0.01 * ((l.x - cx) ** 2 + (l.y - cy) ** 2), 9) AS d
  FROM lab l JOIN ch ON ch.image_id = l.image_id AND l.x BETWEEN floor(cx - step) AND ceil(cx + step) AND l.y BETWEEN floor(cy - step) AND ceil(cy + step)) l GROUP BY ALL),
sp AS (SELECT image_id, p, coalesce(last_value(sp IGNORE NULLS) OVER (PARTITION BY image_id ORDER BY p), 0) AS sp FROM lab LEFT JOIN s0 USING (image_id, p))"""


def _assigned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    points = _centers(spark, sf)
    return superpixel.assign(lab_pixels(spark, sf), points), points


@query(f"WITH {_SLIC} SELECT image_id, p, sp FROM sp")
def slic_assign(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf)[0].select("image_id", F.col("p").cast("long").alias("p"), "sp")


@query(f'WITH {_SLIC} SELECT ce.image_id, ce.c, coalesce(round(avg("L"), 6), 0) AS "L", coalesce(round(avg(a), 6), 0) AS a, coalesce(round(avg(bb), 6), 0) AS b, count(p) AS size FROM ce LEFT JOIN (SELECT * FROM sp JOIN lab USING (image_id, p)) m ON m.sp = ce.c AND m.image_id = ce.image_id GROUP BY ALL')
def superpixel_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(superpixel.means(*_assigned(spark, sf)))


_NEAREST = f"""near AS (SELECT vec_id, arg_min(idx, struct_pack(d, idx)) AS idx, min(d) AS d FROM (SELECT c.vec_id, p.idx, round((c."L" - p."L") ** 2 + (c.a - p.a) ** 2 + (c.b - p.b) ** 2, 9) AS d FROM colors c, pal p) GROUP BY vec_id)"""


def _coded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    palette = catalog_palette(spark).select(F.lit(0).alias("k"), "idx", "L", "a", "b", F.lit(0).alias("n"))
    return pal.nearest_color(colors(spark, sf).withColumn("k", F.lit(0)), palette, ["k"]), palette


@query(f'WITH {COLORS}, {PALETTE}, {_NEAREST} SELECT p.idx, round(coalesce(avg(c."L"), p."L"), 6) AS "L", round(coalesce(avg(c.a), p.a), 6) AS a, round(coalesce(avg(c.b), p.b), 6) AS b, count(c.vec_id) AS n FROM pal p LEFT JOIN near n ON n.idx = p.idx LEFT JOIN colors c ON c.vec_id = n.vec_id GROUP BY p.idx, p."L", p.a, p.b')
def kmeans_step(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pal.kmeans_step(*_coded(spark, sf), ["k"]).drop("k"))


@query(f"WITH {COLORS}, {PALETTE}, {_NEAREST} SELECT idx, arg_min(vec_id, struct_pack(d, vec_id)) AS medoid, count(*) AS n FROM near GROUP BY idx")
def medoid(spark: SparkSession, sf: str) -> DataFrame:
    return pal.medoids(_coded(spark, sf)[0].withColumnRenamed("vec_id", "i"), ["k"]).drop("k")


@query("""WITH e AS (SELECT CAST(l_suppkey % 7 AS VARCHAR) AS image_id, l_linenumber * 2 AS k, round(sum(l_extendedprice) / 1e6, 6) AS sse FROM lineitem GROUP BY ALL),
w AS (SELECT *, first(k) OVER w AS x0, last(k) OVER w AS x1, first(sse) OVER w AS y0, last(sse) OVER w AS y1, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY image_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
o AS (SELECT *, round(abs((y1 - y0) * k - (x1 - x0) * sse + x1 * y0 - y1 * x0) / sqrt((y1 - y0) ** 2 + (x1 - x0) ** 2), 6) AS off FROM w)
SELECT image_id, CASE WHEN max(n) < 3 THEN min(k) ELSE arg_min(k, struct_pack(o := -off, k := k)) END AS k FROM o GROUP BY image_id""")
def elbow_select(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 7).cast("string").alias("image_id"), (F.col("l_linenumber") * 2).alias("k")).agg(F.round(F.sum("l_extendedprice") / 1e6, 6).alias("sse"))
    return pal.elbow(e)


@query(f"WITH {COLORS}, {PALETTE}, {_NEAREST} SELECT label, round(sum(d), 4) AS sse, count(*) AS n, sum(CAST(d <= 400 AS INTEGER)) AS near FROM near JOIN colors USING (vec_id) GROUP BY label")
def sse_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return _coded(spark, sf)[0].groupBy("label").agg(F.round(F.sum("d"), 4).alias("sse"), F.count(F.lit(1)).alias("n"), F.sum((F.col("d") <= 400).cast("int")).alias("near"))


@query()
def palette_fit(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings, as images of ``FITTED`` superpixels, with every k of the conversion."""
    points = colors(spark, sf).select(F.floor(F.col("vec_id") / FITTED).cast("string").alias("image_id"), F.col("vec_id").alias("i"), "L", "a", "b")
    return rounded(pal.fit_palettes(points, list(range(pal.K_MIN, pal.K_MAX + 1)), 1))


@query()
def palette_refine(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings, as palettes of ``REFINED`` colours; more than ``MAX_COLORS``, so that clusters are joined too."""
    at = F.col("vec_id")
    palette = colors(spark, sf).select(F.floor(at / REFINED).cast("string").alias("image_id"), F.pmod(at, F.lit(REFINED)).cast("int").alias("idx"), "L", "a", "b", (1 + at % 9).alias("n"))
    return rounded(pal.refine(palette, 5.0))


# ---- regions and outlines ----


_REG = f"{PX}, {_LABEL}, {_REGION}"


@query(f"WITH RECURSIVE {_REG} SELECT image_id, p, label, region_id FROM reg")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return found_regions(spark, sf).select("image_id", "p", "label", "region_id")


@query(f"WITH RECURSIVE {_REG} SELECT image_id, region_id, label, count(*) AS area, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM reg GROUP BY ALL")
def region_stats(spark: SparkSession, sf: str) -> DataFrame:
    return regions.stats(found_regions(spark, sf))


@query(f"WITH RECURSIVE {_REG} SELECT DISTINCT nb.image_id, a.region_id AS src, b.region_id AS dst FROM nb JOIN reg a ON a.image_id = nb.image_id AND a.p = nb.p JOIN reg b ON b.image_id = nb.image_id AND b.p = nb.q WHERE NOT same")
def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return regions.adjacency(found_regions(spark, sf))


@query(f"WITH RECURSIVE {_REG} SELECT image_id, region_id, count(*) AS area FROM reg GROUP BY ALL HAVING count(*) < 9")
def small_region_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return regions.small_regions(regions.stats(found_regions(spark, sf)), 0, least=9).select("image_id", "region_id", "area")


@query()
def region_merge(spark: SparkSession, sf: str) -> DataFrame:
    found = regions.settle(regions.components(labels(spark, sf)), "found")
    nodes = regions.stats(found).withColumns({"L": F.lit(50.0) + F.col("label") * 6, "a": F.lit(0.0), "b": F.lit(0.0)})
    return regions.compact(found, regions.merge(nodes.select("image_id", "region_id", "area", "L", "a", "b"), regions.adjacency(found), 9)).select("image_id", "p", "label", "region_id")


_GRAPH = """n AS (SELECT p_partkey // 50 AS image_id, p_partkey AS region_id, p_size AS area, 20 + (p_partkey * 37 % 61)::DOUBLE AS l FROM part),
e AS (SELECT a.image_id, a.region_id AS src, b.region_id AS dst FROM n a JOIN n b ON a.image_id = b.image_id AND abs(a.region_id - b.region_id) IN (1, 7))"""


@query(f"""WITH {_GRAPH}, d AS (SELECT s.image_id, s.region_id, t.region_id AS other, round(abs(s.l - t.l) / (1 + .015 * ((s.l + t.l) / 2 - 50) ** 2 / sqrt(20 + ((s.l + t.l) / 2 - 50) ** 2)), 6) AS de
  FROM n s JOIN e ON e.src = s.region_id JOIN n t ON t.region_id = e.dst WHERE s.area < 12)
SELECT image_id, region_id, arg_min(other, struct_pack(de, other)) AS into_id, min(de) AS de, max(de) AS contrast, max(de) < 12 AS absorbed FROM d GROUP BY ALL""")
def merge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """One step of the merge: where small regions would go, and which ones the contrast guard holds back."""
    at = F.col("p_partkey")
    nodes = table(spark, sf, "part").select(F.expr("p_partkey div 50").alias("image_id"), at.alias("region_id"), F.col("p_size").alias("area"), (20.0 + (at * 37) % 61).alias("L"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    near = nodes.select("image_id", F.col("region_id").alias("src"), F.explode(F.array(*[F.col("region_id") + k for k in (-7, -1, 1, 7)])).alias("dst"))
    edges = near.join(nodes.select("image_id", F.col("region_id").alias("dst")), ["image_id", "dst"])
    return regions.absorbers(nodes, edges, 12)


@query("""WITH RECURSIVE t(id, into_) AS (SELECT o_orderkey, o_orderkey // 2 FROM orders WHERE o_orderkey > 1), r(id, top) AS (SELECT id, into_ FROM t UNION ALL SELECT r.id, t.into_ FROM r JOIN t ON t.id = r.top)
SELECT id, min(top) AS final FROM r GROUP BY id""")
def absorber_closure(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "orders").filter("o_orderkey > 1").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 2).alias("into"))
    return regions.closure(pairs)


_FAR = """bo AS (SELECT r.*, (SELECT count(*) FROM nb WHERE nb.image_id = r.image_id AND nb.p = r.p AND same) < 4 AS edge FROM reg r),
bfs(image_id, p, d) AS (SELECT image_id, p, 0 FROM bo WHERE edge UNION SELECT nb.image_id, nb.q, b.d + 1 FROM bfs b JOIN nb ON nb.image_id = b.image_id AND nb.p = b.p AND same WHERE b.d < 12),
far AS (SELECT image_id, p, min(d) AS d FROM bfs GROUP BY ALL),
best AS (SELECT image_id, region_id, arg_max(struct_pack(x, y), struct_pack(d, q := -p)) AS s, max(d) AS d FROM far JOIN reg USING (image_id, p) GROUP BY ALL),
st AS (SELECT image_id, region_id, label, count(*) AS area, floor(avg(x) + .5) AS mx, floor(avg(y) + .5) AS my FROM reg GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_REG}, {_FAR}
SELECT image_id, region_id, label, area, CAST(CASE WHEN d > 0 THEN s.x ELSE mx END + .5 AS DOUBLE) AS label_x, CAST(CASE WHEN d > 0 THEN s.y ELSE my END + .5 AS DOUBLE) AS label_y, {_FONT_OF} AS font_size FROM st JOIN best USING (image_id, region_id)""")
def label_points(spark: SparkSession, sf: str) -> DataFrame:
    found = regions.label_points(found_regions(spark, sf))
    return found.withColumns({"label_x": F.col("label_x").cast("double"), "label_y": F.col("label_y").cast("double")})


_EDGES = f"""g AS (SELECT *, {_NEAR.format('region_id')} FROM reg {_HV}), e AS (
SELECT image_id, region_id, p * 4 AS seq, x + 1 AS x1, y + 1 AS y1, x + 1 AS x2, y AS y2 FROM g WHERE coalesce(r_ != region_id, true) UNION ALL SELECT image_id, region_id, p * 4 + 1, x, y, x, y + 1 FROM g WHERE coalesce(l != region_id, true)
UNION ALL SELECT image_id, region_id, p * 4 + 2, x, y + 1, x + 1, y + 1 FROM g WHERE coalesce(d != region_id, true) UNION ALL SELECT image_id, region_id, p * 4 + 3, x + 1, y, x, y FROM g WHERE coalesce(u != region_id, true))"""


@query(f"WITH RECURSIVE {_REG}, {_EDGES} SELECT image_id, region_id, x1, y1, x2, y2 FROM e")
def boundary_edges(spark: SparkSession, sf: str) -> DataFrame:
    return vector.boundary_edges(found_regions(spark, sf)).select("image_id", "region_id", "x1", "y1", "x2", "y2")


def _loops(spark: SparkSession, sf: str) -> DataFrame:
    return vector.trace_loops(vector.boundary_edges(regions.settle(found_regions(spark, sf), "regions")))


@query(f"""WITH RECURSIVE {_REG}, {_EDGES} SELECT image_id, region_id, count(*) AS edges, CAST(sum(x1 * y2 - x2 * y1) AS DOUBLE) / 2 AS area, min(x1) AS min_x, max(y1) AS max_y FROM e GROUP BY ALL""")
def trace_loops(spark: SparkSession, sf: str) -> DataFrame:
    """What the loops of each region enclose: they use each of its edges once, and their area, by the shoelace sum, is its pixels."""
    side = _loops(spark, sf).select("image_id", "region_id", F.explode(F.arrays_zip(F.expr("slice(points, 1, size(points) - 1)").alias("p"), F.expr("slice(points, 2, size(points) - 1)").alias("q"))).alias("s"))
    cross = F.col("s.p.x") * F.col("s.q.y") - F.col("s.q.x") * F.col("s.p.y")
    return side.groupBy("image_id", "region_id").agg(F.count(F.lit(1)).alias("edges"), (F.sum(cross) / 2).alias("area"), F.min("s.p.x").cast("int").alias("min_x"), F.max("s.p.y").cast("int").alias("max_y"))


@query()
def region_paths(spark: SparkSession, sf: str) -> DataFrame:
    return vector.paths(vector.chaikin(vector.simplified(_loops(spark, sf))))


@query("""WITH q AS (SELECT o_custkey, o_orderkey, o_totalprice AS x, o_orderkey % 97 AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
c1 AS (SELECT a.o_custkey, a.i * 2 + k AS i, a.n * 2 AS n, CASE k WHEN 0 THEN a.x * .75 + b.x * .25 ELSE a.x * .25 + b.x * .75 END AS x, CASE k WHEN 0 THEN a.y * .75 + b.y * .25 ELSE a.y * .25 + b.y * .75 END AS y
  FROM q a JOIN q b ON a.o_custkey = b.o_custkey AND b.i = (a.i + 1) % a.n, (VALUES (0), (1)) v(k)),
c AS (SELECT a.o_custkey, a.i * 2 + k AS i, CASE k WHEN 0 THEN a.x * .75 + b.x * .25 ELSE a.x * .25 + b.x * .75 END AS x, CASE k WHEN 0 THEN a.y * .75 + b.y * .25 ELSE a.y * .25 + b.y * .75 END AS y
  FROM c1 a JOIN c1 b ON a.o_custkey = b.o_custkey AND b.i = (a.i + 1) % a.n, (VALUES (0), (1)) v(k)) SELECT o_custkey, CAST(i AS INTEGER) AS i, round(x, 6) AS x, round(CAST(y AS DOUBLE), 6) AS y FROM c""")
def chaikin(spark: SparkSession, sf: str) -> DataFrame:
    points = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_totalprice").alias("x"), (F.col("o_orderkey") % 97).cast("double").alias("y")))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    lines = table(spark, sf, "orders").groupBy("o_custkey").agg(points.alias("ps"))
    return rounded(vector.chaikin(lines, 2, "ps").select("o_custkey", F.posexplode("ps").alias("i", "q")).select("o_custkey", "i", "q.x", "q.y"))


# ---- paint log and projects ----


@query(f"WITH {LOG} SELECT project_id, seq, tool FROM log QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY seq DESC) <= 50")
def last_50_actions(spark: SparkSession, sf: str) -> DataFrame:
    return paint.last_actions(log(spark, sf)).select("project_id", "seq", "tool")


@query(f"""WITH {LOG}, p AS (SELECT project_id, seq, size AS x, CAST(event_id % 53 AS DOUBLE) AS y FROM log), w AS (SELECT *, lag(x) OVER o AS x1, lag(x, 2) OVER o AS x2, lag(y) OVER o AS y1, lag(y, 2) OVER o AS y2 FROM p WINDOW o AS (PARTITION BY project_id ORDER BY seq))
SELECT project_id, seq, round(coalesce((x2 + x1) / 2, x1), 6) AS from_x, round(coalesce((y2 + y1) / 2, y1), 6) AS from_y, round(x1, 6) AS via_x, y1 AS via_y, round((x1 + x) / 2, 6) AS to_x, (y1 + y) / 2 AS to_y FROM w WHERE x1 IS NOT NULL""")
def stroke_segments(spark: SparkSession, sf: str) -> DataFrame:
    points = log(spark, sf).select("project_id", "seq", F.col("size").alias("x"), (F.col("event_id") % 53).cast("double").alias("y"))
    return rounded(paint.segments(points, ["project_id"]))


@query(f"""WITH RECURSIVE {LOG}, f(project_id, seq, done, redo) AS (SELECT DISTINCT project_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM log
UNION ALL SELECT l.project_id, l.seq,
  CASE l.tool WHEN 'undo' THEN f.done[:-2] WHEN 'redo' THEN CASE WHEN len(f.redo) > 0 THEN f.done || f.redo[-1:] ELSE f.done END ELSE (f.done || [l.seq])[-50:] END,
  CASE l.tool WHEN 'undo' THEN CASE WHEN len(f.done) > 0 THEN f.redo || f.done[-1:] ELSE f.redo END WHEN 'redo' THEN f.redo[:-2] ELSE []::BIGINT[] END
  FROM f JOIN log l ON l.project_id = f.project_id AND l.seq = f.seq + 1)
SELECT project_id, CAST(len(done) AS INTEGER) AS done, CAST(len(redo) AS INTEGER) AS redo, array_to_string(done, ',') AS actions FROM f QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY seq DESC) = 1""")
def undo_redo_state(spark: SparkSession, sf: str) -> DataFrame:
    return paint.undo_redo(log(spark, sf)).select("project_id", F.size("done").alias("done"), F.size("redo").alias("redo"), F.array_join(F.transform("done", lambda s: s.cast("string")), ",").alias("actions"))


@query(f"""WITH {LOG}, m AS (SELECT project_id, seq, CAST(floor(size) AS BIGINT) % 64 AS cell, CASE tool WHEN 'undo' THEN 'eraser' WHEN 'redo' THEN 'fill-all' ELSE 'brush' END AS tool, event_id % 36 AS color FROM log),
l AS (SELECT project_id, cell, max(seq) AS last_seq, arg_max(CASE WHEN tool = 'brush' THEN color ELSE -1 END, seq) AS top FROM m WHERE tool != 'fill-all' GROUP BY ALL),
f AS (SELECT m.project_id, m.cell, arg_min(color, seq) AS under FROM m LEFT JOIN l USING (project_id, cell) WHERE tool = 'fill-all' AND (last_seq IS NULL OR (top = -1 AND seq > last_seq)) GROUP BY ALL)
SELECT c.project_id, c.cell, coalesce(nullif(top, -1), under) AS color FROM (SELECT DISTINCT project_id, cell FROM m) c LEFT JOIN l USING (project_id, cell) LEFT JOIN f USING (project_id, cell)""")
def pixel_last_writer(spark: SparkSession, sf: str) -> DataFrame:
    tool = F.when(F.col("tool") == "undo", "eraser").when(F.col("tool") == "redo", "fill-all").otherwise("brush")
    marks = log(spark, sf).select("project_id", "seq", (F.floor("size") % 64).alias("cell"), tool.alias("tool"), (F.col("event_id") % 36).alias("color"))
    return paint.replay(marks, ["project_id", "cell"])


@query(f"""WITH RECURSIVE {LOG}, o AS (SELECT project_id, seq, round(size, 1) AS x FROM log),
s(project_id, seq, x, kept) AS (SELECT project_id, seq, x, 1 FROM o WHERE seq = 1 UNION ALL SELECT o.project_id, o.seq, CASE WHEN abs(o.x - s.x) < .01 THEN s.x ELSE o.x END, s.kept + CASE WHEN abs(o.x - s.x) < .01 THEN 0 ELSE 1 END FROM s JOIN o ON o.project_id = s.project_id AND o.seq = s.seq + 1)
SELECT project_id, CAST(max(seq) AS INTEGER) AS before, CAST(max(kept) AS INTEGER) AS after FROM s GROUP BY project_id""")
def stroke_points(spark: SparkSession, sf: str) -> DataFrame:
    points = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.round("size", 1).alias("x")))), lambda s: F.struct(s["x"].alias("x"), F.lit(0.0).alias("y"), F.lit(0.5).alias("pressure")))
    return log(spark, sf).groupBy("project_id").agg(points.alias("ps")).select("project_id", F.size("ps").alias("before"), F.size(paint.dedupe_points(F.col("ps"))).alias("after"))


def _store(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders")
    store = o.filter("o_orderkey % 5 != 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("name"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))
    changes = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") + 1).alias("name"), F.lit(None).cast("timestamp").alias("created_at"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("updated_at"))
    return store, changes.select("id", "name", "created_at", "updated_at")


_STORE = """store AS (SELECT o_orderkey AS id, o_custkey AS name, o_orderdate AS created_at, o_orderdate AS updated_at FROM orders WHERE o_orderkey % 5 != 0),
changes AS (SELECT o_orderkey AS id, o_custkey + 1 AS name, o_orderdate + INTERVAL 1 DAY AS updated_at FROM orders WHERE o_orderkey % 3 = 0)"""


@query(f"WITH {_STORE} SELECT coalesce(c.id, s.id) AS id, coalesce(c.name, s.name) AS name, coalesce(s.created_at, c.updated_at) AS created_at, coalesce(c.updated_at, s.updated_at) AS updated_at FROM store s FULL JOIN changes c ON s.id = c.id")
def project_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return projects.upsert(*_store(spark, sf))


@query(f"WITH {_STORE} SELECT * FROM store WHERE id NOT IN (SELECT id FROM changes)")
def project_delete(spark: SparkSession, sf: str) -> DataFrame:
    store, changes = _store(spark, sf)
    return projects.delete(store, changes)


@query(f"WITH {_STORE} SELECT id, name, updated_at FROM store ORDER BY updated_at DESC, id")
def project_list(spark: SparkSession, sf: str) -> DataFrame:
    return projects.listing(_store(spark, sf)[0]).select("id", "name", "updated_at")


@query(f"WITH {_STORE} SELECT * FROM store WHERE id = 7")
def project_get(spark: SparkSession, sf: str) -> DataFrame:
    return projects.get(_store(spark, sf)[0], 7)


@query("SELECT c_custkey, replace(coalesce(CASE WHEN c_nationkey % 3 = 0 THEN 'Привет, {name}' END, CASE WHEN c_nationkey % 3 < 2 THEN 'Hello, {name}' END, c_mktsegment), '{name}', c_name) AS text, CASE WHEN c_mktsegment LIKE 'B%' THEN 'ru' ELSE 'en' END AS lang FROM customer")
def i18n_lookup(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("c_nationkey") % 3
    text = C.translate(F.when(kind == 0, "Привет, {name}"), F.when(kind < 2, "Hello, {name}"), F.col("c_mktsegment"), {"name": F.col("c_name")})
    browser = F.when(F.col("c_mktsegment").startswith("B"), "RU-ru").otherwise("de")
    return table(spark, sf, "customer").select("c_custkey", text.alias("text"), C.detect_language(F.lit(None).cast("string"), browser).alias("lang"))


@query("SELECT event_id, CAST(coalesce(json_extract(props, '$.k'), '-1') AS BIGINT) AS k, CAST(0.5 AS DOUBLE) AS scale FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", *projects.preferences("props", {"k": -1, "scale": 0.5}, "k long, scale double"))


@query(f"WITH {LOG} SELECT project_id, CAST(event_id % 36 AS BIGINT) AS color, min(seq) AS seq FROM log GROUP BY ALL")
def custom_colors(spark: SparkSession, sf: str) -> DataFrame:
    return projects.first_of_each(log(spark, sf).withColumn("color", F.col("event_id") % 36), "project_id")


@query()
def photo_to_template(spark: SparkSession, sf: str) -> DataFrame:
    """The whole conversion of all images, reduced to 16 pixels first: where the numbers of their regions go."""
    made = template.convert(pixels(spark, sf).select("image_id", "x", "y", "r", "g", "b"), least_area=9, max_side=16)
    return made.points


@query()
def photos_to_templates(spark: SparkSession, sf: str) -> DataFrame:
    """The whole conversion of all images of the table, of many sizes: their palettes."""
    return rounded(template.convert(pixels(spark, sf).select("image_id", "x", "y", "r", "g", "b"), least_area=9).palette)


# ---- layers of a template: the label grid, whose regions are named by image, label and colour ----

_RG = "rg AS (SELECT image_id, CAST(label AS BIGINT) AS region_id, CAST((label + CAST(image_id AS INTEGER)) % 7 AS INTEGER) AS color_idx, count(*) AS area, min(x) + .5 AS label_x, max(y) + .5 AS label_y FROM lb GROUP BY ALL)"
_FONT = _FONT_OF


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    return labels(spark, sf).withColumn("region_id", F.col("label").cast("long"))


def _grid_regions(spark: SparkSession, sf: str) -> DataFrame:
    color = ((F.col("region_id") + F.col("image_id").cast("int")) % 7).cast("int").alias("color_idx")
    found = _grid(spark, sf).groupBy("image_id", "region_id", color).agg(F.count(F.lit(1)).alias("area"), (F.min("x") + 0.5).alias("label_x"), (F.max("y") + 0.5).alias("label_y"))
    return found.withColumn("font_size", C.font_size(F.col("area")))


def _chosen(regions_: DataFrame) -> DataFrame:
    """The active colour of each image."""
    return regions_.select("image_id", (F.col("image_id").cast("int") % 5).alias("color_idx")).distinct()


@query(f"WITH {PX}, {_LABEL}, {_RG} SELECT image_id, color_idx, array_to_string(list(region_id ORDER BY region_id), ',') AS ids FROM rg GROUP BY ALL")
def region_ids_by_color(spark: SparkSession, sf: str) -> DataFrame:
    found = regions.ids_by_color(_grid_regions(spark, sf))
    return found.select("image_id", "color_idx", F.array_join(F.transform("region_ids", lambda v: v.cast("string")), ",").alias("ids"))


@query(f"WITH {PX}, {_LABEL}, {_RG} SELECT image_id, color_idx, region_id, 'M' || image_id || ' ' || region_id || 'Z' AS path FROM rg WHERE color_idx = CAST(image_id AS INTEGER) % 5 AND region_id = CAST(image_id AS INTEGER) % 2")
def highlight_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of the active colour; one region of each image has an outline here."""
    found = _grid_regions(spark, sf)
    outlines = found.filter("region_id = CAST(image_id AS INT) % 2").select("image_id", "region_id", F.concat(F.lit("M"), "image_id", F.lit(" "), F.col("region_id").cast("string"), F.lit("Z")).alias("path"))
    return regions.paths_of_color(found, outlines, _chosen(found)).select("image_id", "color_idx", "region_id", "path")


@query(f"WITH {PX}, {_LABEL}, {_RG}, i AS (SELECT *, color_idx AS idx FROM rg) SELECT image_id, region_id, {SYMBOL} AS symbol, label_x AS x, label_y AS y, {_FONT} AS font_size FROM i")
def label_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return regions.numbers(_grid_regions(spark, sf)).select("image_id", "region_id", "symbol", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "font_size")


_MASK = f"q AS (SELECT image_id, x, y, label, {_NEAR.format('label')} FROM lb {_HV}), mask AS MATERIALIZED (SELECT DISTINCT image_id, x + dx AS x, y + dy AS y FROM (SELECT * FROM q WHERE l != label OR r_ != label OR u != label OR d != label), (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy))"


def _mask(spark: SparkSession, sf: str) -> DataFrame:
    return stencil.dilate2(stencil.contour_mask(labels(spark, sf)))


@query(f"""WITH {PX}, {_LABEL}, {_MASK} SELECT p.image_id, p.x, p.y, {', '.join(f"CASE WHEN m.x IS NOT NULL THEN 0 ELSE CAST(floor({c} * (p.n * 255 // 7) / 255.0::DOUBLE + 255 * (1 - (p.n * 255 // 7) / 255.0::DOUBLE) + .5) AS INTEGER) END AS {c}" for c in 'rgb')}, 255 AS a
FROM px p LEFT JOIN mask m ON m.image_id = p.image_id AND m.x = p.x AND m.y = p.y""")
def compose_export(spark: SparkSession, sf: str) -> DataFrame:
    """The pixels as translucent paint over white, with the contours of the label grid."""
    painted = pixels(spark, sf).select("image_id", "x", "y", "r", "g", "b", F.expr("CAST(n * 255 div 7 AS INT)").alias("a"))
    return raster.compose(painted, _mask(spark, sf))


@query(f"WITH {PX}, {_LABEL}, {_RG}, {PALETTE} SELECT b.image_id, b.x, b.y, {_channel(2)} AS r, {_channel(4)} AS g, {_channel(6)} AS b, 89 AS a FROM lb b JOIN rg ON rg.image_id = b.image_id AND rg.region_id = b.label JOIN pal ON idx = color_idx WHERE color_idx = CAST(b.image_id AS INTEGER) % 5")
def highlight_color(spark: SparkSession, sf: str) -> DataFrame:
    found = _grid_regions(spark, sf)
    palette = catalog_palette(spark).select(F.col("idx").alias("color_idx"), "hex")
    return raster.highlight(_grid(spark, sf), found, palette, _chosen(found))


@query(f"""WITH {PX}, {_LABEL}, {_RG}, {PALETTE}, {_MASK} SELECT b.image_id, b.x, b.y, {', '.join(f"CASE WHEN m.x IS NOT NULL THEN 0 ELSE {_channel(at)} END AS {c}" for c, at in zip('rgb', (2, 4, 6)))}, 255 AS a
FROM lb b JOIN rg ON rg.image_id = b.image_id AND rg.region_id = b.label JOIN pal ON idx = color_idx LEFT JOIN mask m ON m.image_id = b.image_id AND m.x = b.x AND m.y = b.y""")
def fill_preview(spark: SparkSession, sf: str) -> DataFrame:
    colored = _grid(spark, sf).join(_grid_regions(spark, sf).select("image_id", "region_id", "color_idx"), ["image_id", "region_id"]).join(catalog_palette(spark).select(F.col("idx").alias("color_idx"), "hex"), "color_idx", "left")
    r, g, b = C.fill_hex(F.col("hex"))
    return raster.preview(colored.select("image_id", "x", "y", r.alias("r"), g.alias("g"), b.alias("b"), F.lit(255).alias("a")), _mask(spark, sf))


# ---- palettes by label ----

_CP = "cp AS (SELECT vec_id // 24 AS g, CAST(vec_id % 24 AS INTEGER) AS idx, * EXCLUDE (label) FROM colors)"


def _palettes(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings, as palettes of 24 colours."""
    return colors(spark, sf).select(F.expr("vec_id div 24").alias("g"), (F.col("vec_id") % 24).cast("int").alias("idx"), "vec_id", "L", "a", "b")


_DE_CP = _DE.replace("FROM colors p JOIN colors q ON q.vec_id = p.vec_id + 1", "FROM cp p JOIN cp q ON q.g = p.g AND p.idx < q.idx")


@query(f"WITH {COLORS}, {_CP}, {_DE_CP}, e AS (SELECT p_id // 24 AS g, CAST(p_id % 24 AS INTEGER) AS i, CAST(q_id % 24 AS INTEGER) AS j, round(sqrt(greatest(0.0, dl * dl + dc * dc + dd * dd + rt * dc * dd)), 6) AS d FROM s7) SELECT g, arg_min(i, struct_pack(d, i, j)) AS i, arg_min(j, struct_pack(d, i, j)) AS j, min(d) AS d FROM e GROUP BY g")
def closest_pair(spark: SparkSession, sf: str) -> DataFrame:
    return pal.closest_pair(_palettes(spark, sf), ["g"])


@query(f"""WITH {COLORS}, {PALETTE}, {_NEAREST}, pairs AS (SELECT c.label AS p_id, c.vec_id AS q_id, c."L" AS l1, c.a AS a1, c.b AS b1, p."L" AS l2, p.a AS a2, p.b AS b2 FROM colors c JOIN near USING (vec_id) JOIN pal p USING (idx)),
{_DE.split('),', 1)[1].lstrip()} SELECT p_id AS label, round(avg(CAST(sqrt(greatest(0.0, dl * dl + dc * dc + dd * dd + rt * dc * dd)) <= 10 AS DOUBLE)), 6) AS share FROM s7 GROUP BY p_id""")
def coverage_share(spark: SparkSession, sf: str) -> DataFrame:
    """What part of the colours of each label is within a difference of 10 of its palette colour."""
    coded, palette = _coded(spark, sf)
    each = palette.drop("k", "n").join(coded.select("label").distinct())
    return rounded(pal.coverage(coded.select("label", "vec_id", "idx", "L", "a", "b"), each, ["label"]))


@query("""WITH s AS (SELECT CAST(l_suppkey AS VARCHAR) AS image_id, l_linenumber + 9 AS k, avg(CAST(l_quantity > 5 AS DOUBLE)) AS share FROM lineitem GROUP BY ALL)
SELECT image_id, CAST(coalesce(min(CASE WHEN share >= .9 THEN k END), 36) AS INTEGER) AS k FROM s GROUP BY image_id""")
def coverage_floor(spark: SparkSession, sf: str) -> DataFrame:
    shares = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("image_id"), (F.col("l_linenumber") + 9).cast("int").alias("k")).agg(F.avg((F.col("l_quantity") > 5).cast("double")).alias("share"))
    return pal.least_covering(shares)


@query(f"WITH {PX}, s AS (SELECT *, greatest(1, ceil(count(*) OVER (PARTITION BY image_id) / 50.0)) AS stride FROM px) SELECT image_id, p FROM s WHERE p % stride = 0")
def stride_sample(spark: SparkSession, sf: str) -> DataFrame:
    return pal.stride_sample(pixels(spark, sf).select("image_id", F.col("p").cast("long").alias("i")), ["image_id"], 50).select("image_id", F.col("i").alias("p"))


_F = "CASE WHEN {0} > 0.206897 THEN ({0}) ** 3 ELSE (({0}) - 4.0::DOUBLE / 29) / 7.787::DOUBLE END"
_XYZ = ", ".join(f"{_F.format(u)} * {w}::DOUBLE AS {n}" for n, u, w in zip("xyz", ("fy + a / 500", "fy", "fy - b / 200"), C.WHITE, strict=True))
_RGB = ", ".join("{} AS {}".format(" + ".join(f"({m}::DOUBLE * {n})" for m, n in zip(row, "xyz", strict=True)), c) for row, c in zip(C.FROM_XYZ, "rgb", strict=True))
_BYTE = "CAST(greatest(0, least(255, floor((CASE WHEN {0} <= 0.0031308 THEN {0} * 12.92 ELSE 1.055 * greatest({0}, 0) ** (1 / 2.4::DOUBLE) - 0.055 END) * 255 + .5))) AS INTEGER)"


@query(f'WITH {COLORS}, f AS (SELECT vec_id, ("L" + 16) / 116 AS fy, a, b FROM colors), t AS (SELECT vec_id, {_XYZ} FROM f), u AS (SELECT vec_id, {_RGB} FROM t) SELECT vec_id, \'#\' || printf(\'%02x%02x%02x\', {_BYTE.format("r")}, {_BYTE.format("g")}, {_BYTE.format("b")}) AS hex FROM u')
def refined_hex(spark: SparkSession, sf: str) -> DataFrame:
    return colors(spark, sf).select("vec_id", C.refined_hex(F.col("L"), F.col("a"), F.col("b")).alias("hex"))


@query("""WITH v AS (SELECT o_orderkey, 0.05 + (o_orderkey % 240) / 20.0::DOUBLE AS s, (o_custkey % 300)::DOUBLE AS tx, (o_orderkey % 170)::DOUBLE AS ty, 0.25 + (o_custkey % 16) / 4.0::DOUBLE AS f FROM orders),
z AS (SELECT *, least(12.0::DOUBLE, greatest(0.05::DOUBLE, s * f)) AS z, least(12.0::DOUBLE, greatest(0.05::DOUBLE, s * (40 * f) / greatest(1.0, tx))) AS w FROM v)
SELECT o_orderkey, round(z, 6) AS zoom_scale, round(100 - (100 - tx) / s * z, 6) + 0.0 AS zoom_tx, round(50 - (50 - ty) / s * z, 6) + 0.0 AS zoom_ty, round(w, 6) AS pinch_scale, round(10 - tx * w, 6) + 0.0 AS pinch_tx, round(20 - ty * w, 6) + 0.0 AS pinch_ty FROM z""")
def view_gestures(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", (0.05 + (F.col("o_orderkey") % 240) / 20.0).alias("s"), (F.col("o_custkey") % 300).cast("double").alias("tx"), (F.col("o_orderkey") % 170).cast("double").alias("ty"), (0.25 + (F.col("o_custkey") % 16) / 4.0).alias("f"))
    s, tx, ty, f = (F.col(c) for c in ("s", "tx", "ty", "f"))
    zoom = C.zoom_at(F.lit(100.0), F.lit(50.0), f, s, tx, ty)
    pinch = C.pinch(s, tx, tx, ty, f * 40, F.lit(10.0), F.lit(20.0))
    return rounded(o.select("o_orderkey", *[c.alias(f"{k}_{n}") for k, cs in (("zoom", zoom), ("pinch", pinch)) for n, c in zip(("scale", "tx", "ty"), cs, strict=True)]))


# ---- pointers and sessions ----

_EVENT = "e AS (SELECT event_id, user_id AS stroke_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value AS x, (event_id % 53)::DOUBLE AS y, CASE event_id % 4 WHEN 0 THEN 0.0 ELSE (event_id % 4) / 4.0::DOUBLE END AS pressure, event_id % 3 AS n FROM events)"


def _pointer_events(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("stroke_id"), seq.alias("seq"), F.col("value").alias("x"), (F.col("event_id") % 53).cast("double").alias("y"), ((F.col("event_id") % 4) / 4.0).alias("pressure"), (F.col("event_id") % 3).alias("n"))
    sample = lambda k: F.struct((F.col("x") + k).alias("x"), F.col("y"), F.col("pressure"))
    several = F.when(F.col("n") == 2, F.array(sample(0), sample(1))).when(F.col("n") == 1, F.array(sample(0)).cast(paint.POINTS)).otherwise(F.lit(None))
    return e.withColumns({"coalesced": several, "scale": F.lit(2.0), "tx": F.lit(10.0), "ty": F.lit(-4.0)})


_POINTS = f"{_EVENT}, pts AS (SELECT stroke_id, seq, k AS part, (x + k - 10) / 2 AS x, (y + 4) / 2 AS y, CASE WHEN pressure > 0 THEN pressure ELSE .5::DOUBLE END AS pressure FROM e, (VALUES (0), (1)) v(k) WHERE k = 0 OR n = 2)"


@query(f"WITH {_POINTS} SELECT stroke_id, seq, part, round(x, 6) AS x, round(y, 6) AS y, pressure FROM pts")
def pointer_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(paint.pointer_points(_pointer_events(spark, sf)))


@query(f"""WITH RECURSIVE {_POINTS}, o AS (SELECT *, row_number() OVER (PARTITION BY stroke_id ORDER BY seq, part) AS i FROM pts),
s(stroke_id, i, x, y, kept) AS (SELECT stroke_id, i, x, y, 1 FROM o WHERE i = 1
  UNION ALL SELECT o.stroke_id, o.i, CASE WHEN abs(o.x - s.x) < .01 AND abs(o.y - s.y) < .01 THEN s.x ELSE o.x END, CASE WHEN abs(o.x - s.x) < .01 AND abs(o.y - s.y) < .01 THEN s.y ELSE o.y END, s.kept + CASE WHEN abs(o.x - s.x) < .01 AND abs(o.y - s.y) < .01 THEN 0 ELSE 1 END
  FROM s JOIN o ON o.stroke_id = s.stroke_id AND o.i = s.i + 1)
SELECT stroke_id, CAST(max(kept) AS INTEGER) AS points FROM s WHERE stroke_id % 3 = 0 AND stroke_id % 7 != 0 GROUP BY stroke_id""")
def stroke_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Strokes that are committed and not aborted, with their points."""
    events = _pointer_events(spark, sf)
    kind = F.when(F.col("stroke_id") % 7 == 0, "abort").when(F.col("stroke_id") % 3 == 0, "commit").otherwise("extend")
    committed = events.select("stroke_id", F.lit("commit").alias("kind")).filter("stroke_id % 3 = 0").distinct()
    ends = events.select("stroke_id", kind.alias("kind")).unionByName(committed)
    return paint.strokes(paint.pointer_points(events), ends).select("stroke_id", F.size("points").alias("points"))


@query(f"WITH {LOG} SELECT project_id, seq, tool FROM log UNION ALL SELECT project_id, max(seq) + 1, 'fill-all' FROM log GROUP BY project_id")
def finish_for_me(spark: SparkSession, sf: str) -> DataFrame:
    return paint.finish(log(spark, sf).select("project_id", "seq", "tool"))


@query("""WITH v AS (SELECT * FROM (VALUES {}) v(place, id, title, category, difficulty, minutes)), o AS (SELECT o_custkey % 19 AS place, count(*) AS projects, max(o_orderdate) AS latest FROM orders GROUP BY 1)
SELECT v.*, coalesce(projects, 0) AS projects, latest FROM v LEFT JOIN o USING (place)""".format(", ".join(f"({k}, '{i}', '{t}', '{c}', '{d}', {m})" for k, (i, t, c, d, m) in enumerate(catalog.ROWS))))
def catalog_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog, with how many projects (orders, by customer) were begun from each picture and when the latest one was."""
    begun = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 19).cast("int").alias("place")).agg(F.count(F.lit(1)).alias("projects"), F.max("o_orderdate").alias("latest"))
    return catalog.artworks(spark).join(begun, "place", "left").na.fill(0, ["projects"])
