"""Colour and scalar functions as column expressions (no UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# sRGB (D65) to XYZ and back, white point, and the two Lab constants.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.969266, 1.8760108, 0.041556), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
EPSILON, KAPPA = 0.008856, 7.787


def half_up(c: Column) -> Column:
    """Rounding with halves upwards, also below zero."""
    return F.floor(c + 0.5)


def rgb_to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    """L, a, b of 8-bit sRGB channels."""
    linear = [F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    scaled = [sum(w * c for w, c in zip(row, linear, strict=True)) / white for row, white in zip(TO_XYZ, WHITE, strict=True)]
    x, y, z = (F.when(t > EPSILON, F.cbrt(t)).otherwise(KAPPA * t + 16.0 / 116.0) for t in scaled)
    return [116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)]


def lab_to_rgb(L: Column, a: Column, b: Column) -> list[Column]:
    """8-bit sRGB channels of Lab, rounded half up and clamped."""
    y = (L + 16.0) / 116.0
    roots = (y + a / 500.0, y, y - b / 200.0)
    xyz = [F.when(u * u * u > EPSILON, u * u * u).otherwise((u - 16.0 / 116.0) / KAPPA) * w for u, w in zip(roots, WHITE, strict=True)]
    out = []
    for row in FROM_XYZ:
        c = sum(m * v for m, v in zip(row, xyz, strict=True))
        v = F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
        out.append(F.least(F.lit(255), F.greatest(F.lit(0), half_up(v * 255.0))).cast("int"))
    return out


def refined_hex(L: Column, a: Column, b: Column) -> Column:
    """#rrggbb of a refined palette colour.

    Against ``lab_to_hex`` the threshold is on the root, just below that of the cube, and channels are
    clamped after rounding; null for null or NaN.
    """
    y = (L + 16.0) / 116.0
    roots = (y + a / 500.0, y, y - b / 200.0)
    xyz = [F.when(u > 0.206897, u * u * u).otherwise((u - 4.0 / 29.0) / KAPPA) * w for u, w in zip(roots, WHITE, strict=True)]
    channels = []
    for row in FROM_XYZ:
        c = sum(m * v for m, v in zip(row, xyz, strict=True))
        v = F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
        channels.append(F.greatest(F.lit(0), F.least(F.lit(255), half_up(v * 255.0))).cast("int"))
    bad = F.isnan(L + a + b) | (L + a + b).isNull()
    return F.when(~bad, hex_of(*channels))


def cie76(p: list[Column], q: list[Column]) -> Column:
    """Euclidean distance in Lab."""
    return F.sqrt(sum((u - v) * (u - v) for u, v in zip(p, q, strict=True)))


def ciede2000(p: list[Column], q: list[Column]) -> Column:
    """CIEDE2000 colour difference."""
    (l1, a1, b1), (l2, a2, b2) = p, q
    rad, big = math.pi / 180, 25.0**7
    seventh = lambda c: F.pow(c, F.lit(7.0))
    mean = (F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2
    grow = 1.5 - 0.5 * F.sqrt(seventh(mean) / (seventh(mean) + big))
    x1, x2 = grow * a1, grow * a2
    c1, c2 = F.sqrt(x1 * x1 + b1 * b1), F.sqrt(x2 * x2 + b2 * b2)

    def hue(x: Column, y: Column) -> Column:
        deg = F.degrees(F.atan2(y, x))
        return F.when((x == 0) & (y == 0), 0.0).when(deg < 0, deg + 360).otherwise(deg)

    h1, h2 = hue(x1, b1), hue(x2, b2)
    grey = c1 * c2 == 0
    turn = h2 - h1
    dh = F.when(grey, 0.0).when(F.abs(turn) <= 180, turn).when(turn > 180, turn - 360).otherwise(turn + 360)
    mid = F.when(grey, h1 + h2).when(F.abs(turn) <= 180, (h1 + h2) / 2).when(h1 + h2 < 360, (h1 + h2 + 360) / 2).otherwise((h1 + h2 - 360) / 2)
    lightness, chroma = (l1 + l2) / 2 - 50, (c1 + c2) / 2
    cos = lambda deg: F.cos(deg * rad)
    t = 1 - 0.17 * cos(mid - 30) + 0.24 * cos(2 * mid) + 0.32 * cos(3 * mid + 6) - 0.2 * cos(4 * mid - 63)
    spread = 30 * F.exp(-((mid - 275) / 25) * ((mid - 275) / 25))
    rotation = -F.sin(2 * spread * rad) * 2 * F.sqrt(seventh(chroma) / (seventh(chroma) + big))
    dl = (l2 - l1) / (1 + 0.015 * lightness * lightness / F.sqrt(20 + lightness * lightness))
    dc = (c2 - c1) / (1 + 0.045 * chroma)
    dd = 2 * F.sqrt(c1 * c2) * F.sin(dh / 2 * rad) / (1 + 0.015 * chroma * t)
    return F.sqrt(F.greatest(F.lit(0.0), dl * dl + dc * dc + dd * dd + rotation * dc * dd))


def with_ciede2000(df: DataFrame, p: list[str], q: list[str], out: str = "de") -> DataFrame:
    """``df`` with the difference of the colours in columns ``p`` and ``q``.

    Its stages are columns of their own, so that none is computed twice: written as one expression
    they are repeated within each other many times.
    """
    (l1, a1, b1), (l2, a2, b2) = ([F.col(c) for c in cs] for cs in (p, q))
    col, big = F.col, 25.0**7
    seventh = lambda c: F.pow(c, F.lit(7.0))
    hue = lambda x, y: F.when((x == 0) & (y == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0)))
    cos = lambda k, off: F.cos(F.radians(k * col("_mid") + off))
    stages = [
        {"_m7": seventh((F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2)},
        {"_g": 1.5 - 0.5 * F.sqrt(col("_m7") / (col("_m7") + big))},
        {"_x1": col("_g") * a1, "_x2": col("_g") * a2},
        {"_c1": F.sqrt(col("_x1") * col("_x1") + b1 * b1), "_c2": F.sqrt(col("_x2") * col("_x2") + b2 * b2), "_h1": hue(col("_x1"), b1), "_h2": hue(col("_x2"), b2)},
        {"_grey": col("_c1") * col("_c2") == 0, "_turn": col("_h2") - col("_h1"), "_both": col("_h1") + col("_h2"), "_chroma": (col("_c1") + col("_c2")) / 2, "_light": (l1 + l2) / 2 - 50},
        {
            "_dh": F.when(col("_grey"), 0.0).when(F.abs("_turn") <= 180, col("_turn")).otherwise(col("_turn") - 360 * F.signum("_turn")),
            "_mid": F.when(col("_grey"), col("_both")).when(F.abs("_turn") <= 180, col("_both") / 2).otherwise((col("_both") + F.when(col("_both") < 360, 360).otherwise(-360)) / 2),
            "_c7": seventh(col("_chroma")),
        },
        {
            "_t": 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.2 * cos(4, -63),
            "_rot": -F.sin(F.radians(60 * F.exp(-((col("_mid") - 275) / 25) * ((col("_mid") - 275) / 25)))) * 2 * F.sqrt(col("_c7") / (col("_c7") + big)),
            "_dl": (l2 - l1) / (1 + 0.015 * col("_light") * col("_light") / F.sqrt(20 + col("_light") * col("_light"))),
            "_dc": (col("_c2") - col("_c1")) / (1 + 0.045 * col("_chroma")),
        },
        {"_dd": 2 * F.sqrt(col("_c1") * col("_c2")) * F.sin(F.radians(col("_dh") / 2)) / (1 + 0.015 * col("_chroma") * col("_t"))},
    ]
    work = df
    for stage in stages:
        work = work.withColumns(stage)
    square = col("_dl") * col("_dl") + col("_dc") * col("_dc") + col("_dd") * col("_dd") + col("_rot") * col("_dc") * col("_dd")
    return work.withColumn(out, F.sqrt(F.greatest(F.lit(0.0), square))).drop(*[name for stage in stages for name in stage])


def hex_of(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb in lower case."""
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(c.cast("int"))), 2, "0") for c in (r, g, b)])


def lab_to_hex(L: Column, a: Column, b: Column) -> Column:
    """#rrggbb of Lab; null for null or NaN."""
    bad = F.isnan(L + a + b) | (L + a + b).isNull()
    return F.when(~bad, hex_of(*lab_to_rgb(L, a, b)))


def parse_hex(text: Column) -> list[Column]:
    """Channels of 3 or 6 hex digits with or without #, trimmed; null if it is none."""
    body = F.regexp_extract(F.trim(text), "^#?([0-9a-fA-F]{6}|[0-9a-fA-F]{3})$", 1)
    full = F.when(F.length(body) == 3, F.regexp_replace(body, "(.)", "$1$1")).when(F.length(body) == 6, body)
    return [F.conv(F.substring(full, at, 2), 16, 10).cast("int") for at in (1, 3, 5)]


def fill_hex(text: Column) -> list[Column]:
    """Channels of exactly 6 hex digits with or without #; white if it is none."""
    body = F.regexp_extract(text, "^#?([0-9a-fA-F]{6})$", 1)
    return [F.coalesce(F.when(body != "", F.conv(F.substring(body, at, 2), 16, 10).cast("int")), F.lit(255)) for at in (1, 3, 5)]


def yiq_luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def digit_color(text: Column) -> Column:
    """Colour of a digit on a colour: dark on light ones; white on what is no colour."""
    r, g, b = parse_hex(text)
    return F.when(yiq_luma(r, g, b) >= 128, "#1c1917").otherwise("#ffffff")


def symbol_for(i: Column) -> Column:
    """1..9, 0, A..Z for 0..35, else ?."""
    return F.when(i.between(0, 8), (i + 1).cast("string")).when(i == 9, "0").when(i.between(10, 35), F.char(F.lit(55) + i)).otherwise("?")


def index_for_symbol(s: Column) -> Column:
    """Inverse of ``symbol_for``; of a longer text that begins with a letter the first one counts; null if unknown."""
    first = F.ascii(F.upper(s))
    return F.when(s == "0", 9).when(s.rlike("^[1-9]$"), F.ascii(s) - 49).when(first.between(65, 90), first - 55)


def font_size(area: Column) -> Column:
    return F.least(F.lit(48), F.greatest(F.lit(10), half_up(F.sqrt(area) / 3))).cast("int")


def stroke_width(size: Column, pressure: Column) -> Column:
    return size * (0.25 + 0.75 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), pressure)))


def to_canvas(sx: Column, sy: Column, scale: Column, tx: Column, ty: Column) -> list[Column]:
    """Screen to canvas."""
    return [(sx - tx) / scale, (sy - ty) / scale]


def _within(scale: Column) -> Column:
    return F.least(F.lit(12.0), F.greatest(F.lit(0.05), scale))


def fit_to(width: Column, height: Column, view_width: float, view_height: float, padding: float = 24.0) -> list[Column]:
    """Scale (0.05 to 12) and offsets that show the whole canvas in the middle of the view, ``padding`` left free of each of its sides."""
    scale = _within(F.least((view_width - padding) / width, (view_height - padding) / height))
    return [scale, (view_width - width * scale) / 2, (view_height - height * scale) / 2]


def zoom_at(sx: Column, sy: Column, factor: Column, scale: Column, tx: Column, ty: Column) -> list[Column]:
    """Scale and offsets after a zoom that keeps the canvas point under (sx, sy) where it is."""
    new = _within(scale * factor)
    x, y = to_canvas(sx, sy, scale, tx, ty)
    return [new, sx - x * new, sy - y * new]


def pinch(start_scale: Column, start_distance: Column, canvas_x: Column, canvas_y: Column, distance: Column, sx: Column, sy: Column) -> list[Column]:
    """Scale and offsets of a two-finger gesture: the canvas point of its start follows the midpoint (sx, sy)."""
    new = _within(start_scale * distance / F.greatest(F.lit(1.0), start_distance))
    return [new, sx - canvas_x * new, sy - canvas_y * new]


def translate(own: Column, english: Column, key: Column, args: dict[str, Column]) -> Column:
    """The text of a key, in English or as the key itself where missing, with {name} replaced."""
    out = F.coalesce(own, english, key)
    for name, value in args.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def detect_language(saved: Column, browser: Column) -> Column:
    return F.coalesce(F.when(saved.isin("ru", "en"), saved), F.when(F.startswith(F.lower(browser), F.lit("ru")), "ru").otherwise("en"))
