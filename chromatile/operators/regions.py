"""Regions of equal labels: components over runs, statistics, adjacency, merging, label points."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import font_size, half_up, symbol_for, with_ciede2000
from .palette import deltas
from .settling import settle
from .stencil import border, column_window, neighbours4

CONTRAST = 12.0
#: More than any picture is wide: names of runs of pixels rise in raster order.
ROW = 1 << 24


def least_of_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least vertex of the component of each of the vertices 0 to n - 1 under edges (a, b): hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        p, q = root[a], root[b]
        if (p == q).all():
            return root
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root != root[root]).any():
            root = root[root]


def closure(pairs: DataFrame) -> DataFrame:
    """(id, final) of pairs (id, into): where chains of absorption end, by pointer jumping.

    An id that is absorbed by itself ends there. A chain that never ends is a fault of the pairs:
    jumps double in length, so ids that still move after 64 rounds raise ValueError.
    """
    pairs = pairs.select("id", F.col("into").alias("final"))
    still = pairs.filter("id = final")
    now = settle(pairs.filter("id != final"), "closure")
    for _ in range(64):
        step = now.select(F.col("id").alias("final"), F.col("final").alias("further"))
        moved = settle(now.join(step, "final", "left").select("id", F.coalesce("further", "final").alias("final"), F.col("further").isNotNull().alias("_moved")), "closure")
        now = moved.drop("_moved")
        if not moved.filter("_moved").take(1):
            return now.unionByName(still)
    raise ValueError("pairs hold a cycle")


def components(pixels: DataFrame, column: str = "label") -> DataFrame:
    """pixels(image_id, x, y, label) with region_id: 4-connected components, numbered by first pixel.

    Rows are cut into runs of one label. Edges between runs are seen by their pixels, each of which
    looks at the one below: no join, and linear in the pixels however short the runs are. The edges of
    an image, whose size bounds them, meet in one kernel, which numbers the components. Runs may be as many as
    pixels, whatever Spark takes the kernel's output for, so they are never broadcast. Pixels with their runs are
    written down, as two steps read them: what makes the labels is done once.
    """
    row = Window.partitionBy("image_id", "y").orderBy("x")
    starts = pixels.withColumn("_new", F.coalesce(F.lag(column).over(row) != F.col(column), F.lit(True)))
    marked = starts.withColumn("_x0", F.last(F.when(F.col("_new"), F.col("x")), True).over(row.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    marked = settle(marked.withColumn("_run", F.col("y").cast("long") * ROW + F.col("_x0")).drop("_x0"), "runs")
    down = column_window()
    same = (F.lead("y").over(down) == F.col("y") + 1) & (F.lead(column).over(down) == F.col(column))
    edges = marked.select("image_id", F.col("_run").alias("v"), F.coalesce(F.when(same, F.lead("_run").over(down)), F.col("_run")).alias("w")).distinct()

    def number(edges: pa.Table) -> pa.Table:
        runs, ends = np.unique(np.concatenate([edges["v"].to_numpy(), edges["w"].to_numpy()]), return_inverse=True)
        a, b = ends.reshape(2, -1)
        ids = np.unique(least_of_components(a, b, len(runs)), return_inverse=True)[1]
        return pa.table({"image_id": edges["image_id"].combine_chunks().take(pa.array(np.zeros(len(runs), np.int64))), "_run": runs, "region_id": ids.astype(np.int64)})

    kind = pixels.schema["image_id"].dataType.simpleString()
    named = edges.groupBy("image_id").applyInArrow(number, f"image_id {kind}, _run long, region_id long")
    return marked.join(named.hint("merge"), ["image_id", "_run"]).drop("_run")


def stats(labelled: DataFrame, column: str = "label") -> DataFrame:
    """Area, bounding box and label of each region."""
    return labelled.groupBy("image_id", "region_id").agg(F.first(column).alias(column), F.count(F.lit(1)).alias("area"), *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")])


def adjacency(labelled: DataFrame) -> DataFrame:
    """Distinct pairs (src, dst) of regions that touch, in both directions."""
    near = neighbours4(labelled, "region_id").select("image_id", F.col("region_id").alias("src"), F.explode(F.array("_right", "_down")).alias("dst")).filter("dst IS NOT NULL AND dst != src")
    return near.unionByName(near.select("image_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def ids_by_color(regions: DataFrame, color: str = "color_idx") -> DataFrame:
    """(image_id, color, region_ids): the regions of each colour, by rising id."""
    return regions.groupBy("image_id", color).agg(F.sort_array(F.collect_list("region_id")).alias("region_ids"))


def paths_of_color(regions: DataFrame, paths: DataFrame, chosen: DataFrame, color: str = "color_idx") -> DataFrame:
    """(image_id, color, region_id, path): outlines of the regions of the ``chosen`` colour (image_id, color) of each image.

    A colour without regions, and regions without an outline, give no row.
    """
    return regions.select("image_id", color, "region_id").join(chosen, ["image_id", color], "left_semi").join(paths, ["image_id", "region_id"])


def numbers(regions: DataFrame, color: str = "color_idx") -> DataFrame:
    """What is written where on the regions: symbol, x, y, font size."""
    return regions.select("image_id", "region_id", symbol_for(F.col(color)).alias("symbol"), F.col("label_x").alias("x"), F.col("label_y").alias("y"), "font_size")


def small_regions(regions: DataFrame, pixels: int, least: int | None = None) -> DataFrame:
    """Regions below the least area: by default 350 pixels or a 4000th of the picture."""
    least = max(350, int(pixels / 4000 + 0.5)) if least is None else least
    return regions.filter(F.col("area") < least)


def absorbers(regions: DataFrame, edges: DataFrame, least: int, contrast: float = CONTRAST) -> DataFrame:
    """One step of ``merge`` as joins: for each small region the neighbour of least difference, and whether it may go there.

    (image_id, region_id, into_id, de, contrast, absorbed); ties go to the lower id. A region that stands
    out by ``contrast`` against any neighbour stays.
    """
    colors = [F.col(c).alias(f"_{c}") for c in ("L", "a", "b")]
    small = regions.filter(F.col("area") < least).select("image_id", "region_id", "L", "a", "b")
    met = small.join(edges.select("image_id", F.col("src").alias("region_id"), F.col("dst").alias("_other")), ["image_id", "region_id"])
    met = met.join(regions.select("image_id", F.col("region_id").alias("_other"), *colors), ["image_id", "_other"])
    apart = with_ciede2000(met, ["L", "a", "b"], ["_L", "_a", "_b"], "_de").withColumn("_de", F.round("_de", 6))
    each = apart.groupBy("image_id", "region_id").agg(F.min(F.struct("_de", "_other")).alias("_s"), F.max("_de").alias("contrast"))
    return each.select("image_id", "region_id", F.col("_s._other").alias("into_id"), F.col("_s._de").alias("de"), "contrast", (F.col("contrast") < contrast).alias("absorbed"))


def merge(regions: DataFrame, edges: DataFrame, least: int | None, contrast: float = CONTRAST, every: bool = False) -> DataFrame:
    """(image_id, region_id, into): which region finally holds each, as small regions are absorbed.

    regions: image_id, region_id, area, L, a, b, and ``least`` where it differs by image (then the
    argument is None). In the order of ids, and again when still small, a
    region below ``least`` goes to its nearest neighbour by colour, unless it stands out by
    ``contrast`` against any neighbour (``every``: against all). Images are independent; one needs
    its region graph only, never its pixels; images without a small region are not grouped at all.
    Colours are those of the palette, so differences are a table made once for an image.
    """

    def run(key: tuple, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("region_id")
        ids = nodes["region_id"].tolist()
        least = int(nodes["least"].iloc[0])
        colors, code = np.unique(nodes[["L", "a", "b"]].to_numpy(float), axis=0, return_inverse=True)
        code = dict(zip(ids, code.ravel(), strict=True))
        apart: dict[int, np.ndarray] = {}

        def difference(i: int, j: int) -> float:
            if code[i] not in apart:
                apart[code[i]] = deltas(colors[code[i]], colors)
            return float(apart[code[i]][code[j]])

        area = dict(zip(ids, nodes["area"], strict=True))
        near: dict[int, dict[int, None]] = {i: {} for i in ids}  # dicts keep the order in which neighbours came
        for s, d in links.sort_values(["src", "dst"])[["src", "dst"]].itertuples(index=False):
            near[s][d] = None
        into = {i: i for i in ids}
        queue = deque(i for i in ids if area[i] < least) if least > 0 else deque()
        while queue:
            i = queue.popleft()
            if into[i] != i or area[i] >= least or not near[i]:
                continue
            far = {j: difference(i, j) for j in near[i]}
            if (min if every else max)(far.values()) >= contrast:
                continue
            j = min(far, key=far.get)
            for k in near[i]:
                if k != j:
                    del near[k][i]
                    near[k][j] = None
                    near[j][k] = None
            del near[j][i]
            near[i], into[i] = {}, j
            area[j] += area[i]
            if area[j] < least:
                queue.append(j)

        def end(i: int) -> int:
            while into[i] != i:
                i = into[i]
            return i

        return pd.DataFrame({"image_id": key[0], "region_id": ids, "into": [end(i) for i in ids]})

    regions = regions if least is None else regions.withColumn("least", F.lit(least))
    small = settle(regions.filter("area < least").select("image_id").distinct(), "small")
    rest = regions.join(small, "image_id", "left_anti").select("image_id", "region_id", F.col("region_id").alias("into"))
    # New names for both sides: they often come from one table.
    nodes, links = (df.select(*[F.col(c).alias(c) for c in df.columns]).join(small, "image_id", "left_semi") for df in (regions, edges))
    schema = ", ".join(f"{name} {regions.schema[of].dataType.simpleString()}" for name, of in (("image_id", "image_id"), ("region_id", "region_id"), ("into", "region_id")))
    return rest.unionByName(nodes.groupBy("image_id").cogroup(links.groupBy("image_id")).applyInPandas(run, schema))


def compact(labelled: DataFrame, merged: DataFrame, column: str = "label") -> DataFrame:
    """Pixels with their final region, renumbered by the old ids of what survives, and that region's label."""
    order = Window.partitionBy("image_id").orderBy("into")
    ids = merged.select("image_id", "into").distinct().withColumn("new_id", F.row_number().over(order) - 1)
    label = labelled.groupBy("image_id", F.col("region_id").alias("into")).agg(F.first(column).alias("_label"))
    table = merged.join(ids.hint("merge"), ["image_id", "into"]).join(label.hint("merge"), ["image_id", "into"])
    return labelled.drop(column).join(table.hint("merge"), ["image_id", "region_id"]).drop("region_id", "into").withColumnsRenamed({"new_id": "region_id", "_label": column})


def _city_distance(df: DataFrame, keys: list[str], along: str, start: str, out: str) -> DataFrame:
    """min over the line of (start + steps)."""
    line = Window.partitionBy(*keys).orderBy(along)
    before, after = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(0, Window.unboundedFollowing)
    up, down = F.min(F.col(start) - F.col(along)).over(before) + F.col(along), F.min(F.col(start) + F.col(along)).over(after) - F.col(along)
    return df.withColumn(out, F.least(up, down))


def _first_popped(pixels: DataFrame) -> DataFrame:
    """(image_id, region_id, y, x): the pixel that a queue fed with the border in raster order pops first of the most distant ones.

    pixels(image_id, region_id, x, y, border). The frontier of a region is held in the order of the queue: its
    neighbours by parent and then by direction (left, right, up, down), each at its first place. A group is one region.
    """

    def run(key: tuple, held: pa.Table) -> pa.Table:
        x, y = held["x"].to_numpy().astype(np.int64), held["y"].to_numpy().astype(np.int64)
        left, top, wide = x.min() - 1, y.min() - 1, int(x.max() - x.min()) + 3
        places = (y - top) * wide + x - left
        free = np.zeros(wide * (int(y.max() - y.min()) + 3), bool)
        free[places] = True
        frontier = np.sort(places[held["border"].to_numpy() == 1])
        free[frontier] = False
        first = frontier[0]
        while len(frontier):
            first = frontier[0]
            near = (frontier[:, None] + np.array([-1, 1, -wide, wide])).ravel()
            near = near[free[near]]
            frontier = near[np.sort(np.unique(near, return_index=True)[1])]
            free[frontier] = False
        return pa.table({"image_id": pa.array([key[0].as_py()], held.schema.field("image_id").type), "region_id": pa.array([key[1].as_py()], held.schema.field("region_id").type), "y": pa.array([first // wide + top], pa.int32()), "x": pa.array([first % wide + left], pa.int32())})

    kinds = [pixels.schema[c].dataType.simpleString() for c in ("image_id", "region_id")]
    return pixels.select("image_id", "region_id", "x", "y", "border").groupBy("image_id", "region_id").applyInArrow(run, f"image_id {kinds[0]}, region_id {kinds[1]}, y int, x int")


def label_points(labelled: DataFrame, column: str = "label", tie: str = "raster") -> DataFrame:
    """Where the number of each region goes: its pixel furthest from the border, else its centroid.

    The distance within a region is the city-block distance along runs of its rows, then of its
    columns. Of equally distant pixels the first in raster order is taken; with ``tie="reference"`` the one a
    breadth-first search from the border reaches first. Only regions with such ties are searched. Points are centres of pixels.
    """
    if tie not in ("raster", "reference"):
        raise ValueError(f"tie {tie!r} is neither raster nor reference")
    marked = border(labelled).withColumn("_d0", F.when(F.col("border") == 1, F.lit(0)).otherwise(F.lit(1 << 20)))
    runs = lambda df, axis, other, name: df.withColumn(name, F.col(axis) - F.row_number().over(Window.partitionBy("image_id", "region_id", other).orderBy(axis)))
    rows = _city_distance(runs(marked, "x", "y", "_rx"), ["image_id", "region_id", "y", "_rx"], "x", "_d0", "_d1")
    both = _city_distance(runs(rows, "y", "x", "_ry"), ["image_id", "region_id", "x", "_ry"], "y", "_d1", "_d")
    if tie == "reference":
        both = settle(both.select("image_id", "region_id", column, "x", "y", "border", "_d"), "distances")
    best = both.groupBy("image_id", "region_id").agg(F.first(column).alias(column), F.count(F.lit(1)).alias("area"), F.min(F.struct((-F.col("_d")).alias("far"), "y", "x")).alias("s"), half_up(F.avg("x")).alias("mx"), half_up(F.avg("y")).alias("my"))
    inside = F.col("s.far") < 0
    at = {c: F.col(f"s.{c}") for c in ("x", "y")}
    if tie == "reference":
        best = settle(best, "furthest")
        furthest = both.join(best.filter(inside).select("image_id", "region_id", F.col("s.far").alias("_far")), ["image_id", "region_id"]).filter(F.col("_d") == -F.col("_far"))
        tied = furthest.groupBy("image_id", "region_id").count().filter("count > 1").select("image_id", "region_id")
        first = _first_popped(both.join(tied, ["image_id", "region_id"], "left_semi")).withColumnsRenamed({"x": "_tx", "y": "_ty"})
        best = best.join(first, ["image_id", "region_id"], "left")
        at = {c: F.coalesce(f"_t{c}", f"s.{c}") for c in ("x", "y")}
    return best.select("image_id", "region_id", column, "area", (F.when(inside, at["x"]).otherwise(F.col("mx")) + 0.5).alias("label_x"), (F.when(inside, at["y"]).otherwise(F.col("my")) + 0.5).alias("label_y"), font_size(F.col("area")).alias("font_size"))
