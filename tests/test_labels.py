import math
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromatile.operators import palette as pal
from chromatile.operators import regions


def plain_points(grid):
    """{first pixel of a region: label point} by a queue fed with the region's border in raster order."""
    h, w = len(grid), len(grid[0])
    region, order = {}, []
    for p in range(h * w):
        if p in region:
            continue
        region[p], todo, members = p, [p], [p]
        while todo:
            q = todo.pop()
            for r in ([q - 1] if q % w else []) + ([q + 1] if q % w < w - 1 else []) + [q - w, q + w]:
                if 0 <= r < h * w and r not in region and grid[r // w][r % w] == grid[p // w][p % w]:
                    region[r] = p
                    todo.append(r)
                    members.append(r)
        order.append((p, sorted(members)))
    out = {}
    for first, members in order:
        inside = lambda q, x, y: 0 <= x < w and 0 <= y < h and region[q] == first
        near = lambda q: [(q - 1, q % w - 1, q // w), (q + 1, q % w + 1, q // w), (q - w, q % w, q // w - 1), (q + w, q % w, q // w + 1)]
        queue, dist = deque(), {}
        for q in members:
            if not all(0 <= x < w and 0 <= y < h and region[r] == first for r, x, y in near(q)):
                dist[q] = 0
                queue.append(q)
        top, at = -1, members[0]
        while queue:
            q = queue.popleft()
            if dist[q] > top:
                top, at = dist[q], q
            for r, x, y in near(q):
                if 0 <= x < w and 0 <= y < h and region[r] == first and r not in dist:
                    dist[r] = dist[q] + 1
                    queue.append(r)
        x, y = at % w, at // w
        if top <= 0:
            x, y = (math.floor(sum(v) / len(members) + 0.5) for v in ([q % w for q in members], [q // w for q in members]))
        out[first] = (x + 0.5, y + 0.5)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_points_equal_a_plain_queue(spark, seed):
    rng = np.random.default_rng(seed)
    images = {}
    for image in range(6):
        h, w = (int(v) for v in rng.integers(3, 26, 2))
        block = int(rng.integers(1, 7))
        small = rng.integers(0, 3, (h // block + 1, w // block + 1))
        images[image] = np.kron(small, np.ones((block, block), int))[:h, :w].tolist()
    rows = [(k, x, y, label) for k, g in images.items() for y, line in enumerate(g) for x, label in enumerate(line)]
    found = regions.components(spark.createDataFrame(rows, "image_id int, x int, y int, label int")).cache()
    points = regions.label_points(found, tie="reference")
    first = {(r.image_id, r.region_id): r.p for r in found.join(found.groupBy("image_id").agg((F.max("x") + 1).alias("w")), "image_id").groupBy("image_id", "region_id").agg(F.min(F.col("y") * F.col("w") + F.col("x")).alias("p")).collect()}
    got = {(r.image_id, first[r.image_id, r.region_id]): (r.label_x, r.label_y) for r in points.collect()}
    want = {(k, p): at for k, g in images.items() for p, at in plain_points(g).items()}
    assert got == want
    raster = {(r.image_id, first[r.image_id, r.region_id]): (r.label_x, r.label_y) for r in regions.label_points(found).collect()}
    assert raster.keys() == want.keys()
    found.unpersist()
    with pytest.raises(ValueError):
        regions.label_points(found, tie="other")


def test_ties_of_raster_order_and_of_the_queue_differ(spark):
    grid = [[1, 1, 1, 1, 1, 0, 0, 0]] * 3 + [[0, 0, 1, 1, 1, 1, 1, 1]] + [[1] * 8] * 3 + [[0, 0, 1, 1, 1, 1, 1, 1]] * 2
    found = regions.components(spark.createDataFrame([(7, x, y, v) for y, line in enumerate(grid) for x, v in enumerate(line)], "image_id int, x int, y int, label int"))
    at = lambda tie: {(r.label_x, r.label_y) for r in regions.label_points(found, tie=tie).filter("label = 1").collect()}
    assert at("raster") == {(3.5, 5.5)} and at("reference") == {(4.5, 5.5)} == {plain_points(grid)[0]}


def test_clusters_without_weight_attract_nothing(spark):
    table = lambda rows: spark.createDataFrame([(1, i, *lab, n) for i, (lab, n) in enumerate(rows)], "image_id int, idx int, L double, a double, b double, n long")
    rows = pal.refine(table([((50.0, 60.0, 10.0), 0), ((2.0, 0.0, 0.0), 5), ((50.0, 60.0, 10.0), 3)])).orderBy("idx").collect()
    assert [(r.new_idx, r.n) for r in rows] == [(2, 0), (0, 5), (1, 3)]
    assert rows[0].L is None and rows[0].a is None and rows[0].b is None and rows[2].L == 50.0
    # a colour of weight 0 near a cluster with weight joins it
    rows = pal.refine(table([((50.0, 60.0, 10.0), 3), ((50.0, 60.5, 10.0), 0)])).collect()
    assert {(r.new_idx, r.n, r.L) for r in rows} == {(0, 3, 50.0)}
    # beyond the limit, clusters without weight are joined only when no others can be
    far = [((20.0 * i, 0.0, 0.0), 10 * (i % 2)) for i in range(5)]
    rows = pal.refine(table(far), max_colors=4).orderBy("idx").collect()
    assert rows[1].new_idx == rows[3].new_idx and len({r.new_idx for r in rows}) == 4
    rows = pal.refine(table([((20.0 * i, 0.0, 0.0), 0) for i in range(3)]), max_colors=2).orderBy("idx").collect()
    assert rows[0].new_idx == rows[1].new_idx != rows[2].new_idx


def test_nearest_by_ciede2000_equals_the_column_formula(spark):
    from chromatile.functions.color import with_ciede2000

    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(int(i), int(i % 3), *map(float, rng.uniform(-60, 90, 3))) for i in range(200)] + [(900, 0, None, 1.0, 1.0)], "p long, g int, L double, a double, b double")
    palette = spark.createDataFrame([(g, i, *map(float, rng.uniform(-60, 90, 3))) for g in range(3) for i in range(5 + g)] + [(0, 70, 1.0, 2.0, 3.0), (0, 71, 1.0, 2.0, 3.0)], "g int, idx int, L double, a double, b double")
    got = {r.p: (r.idx, r.d) for r in pal.nearest_color(points, palette, ["g"], "ciede2000").collect()}
    pairs = with_ciede2000(points.join(palette.select("g", "idx", *[F.col(c).alias(f"q{c}") for c in ("L", "a", "b")]), "g"), ["L", "a", "b"], ["qL", "qa", "qb"], "de")
    want = {r.p: r.s for r in pairs.groupBy("p").agg(F.min(F.struct(F.round("de", 9).alias("d"), "idx")).alias("s")).collect()}
    assert got.keys() == want.keys() and got[900] == (None, None)
    for p, s in want.items():
        assert p == 900 or (got[p][0] == s.idx and abs(got[p][1] - s.d) < 1e-8)


def plain_refine(rows, least, most):
    """Leader clustering and joining of the closest clusters, step by step; rows: (L, a, b, n)."""
    clusters = []
    mean = lambda c: [v / c["n"] for v in c["lab"]] if c["n"] else None
    apart = lambda p, q: pal.delta(p, q) if p is not None and q is not None else math.inf
    for i, (*lab, n) in enumerate(rows):
        near = min(((apart(lab, mean(c)), k) for k, c in enumerate(clusters)), default=(math.inf, -1))
        if near[0] < least:
            c = clusters[near[1]]
            c["lab"], c["n"] = [s + v * n for s, v in zip(c["lab"], lab)], c["n"] + n
            c["has"].append(i)
        else:
            clusters.append({"lab": [v * n for v in lab], "n": n, "has": [i]})
    while len(clusters) > most:
        best, pair = math.inf, (0, 1)
        for i in range(len(clusters)):
            for j in range(i + 1, len(clusters)):
                d = apart(mean(clusters[i]), mean(clusters[j]))
                if d < best:
                    best, pair = d, (i, j)
        one, two = clusters[pair[0]], clusters.pop(pair[1])
        one["lab"], one["n"] = [s + v for s, v in zip(one["lab"], two["lab"])], one["n"] + two["n"]
        one["has"] += two["has"]
    ranked = sorted(range(len(clusters)), key=lambda k: (-clusters[k]["n"], k))
    return {i: (place, clusters[k]["n"], mean(clusters[k])) for place, k in enumerate(ranked) for i in clusters[k]["has"]}


@pytest.mark.parametrize("least,most", [(5.0, 36), (12.0, 36), (2.0, 8), (0.0, 3)])
def test_refined_palettes_of_the_table_equal_plain_ones(spark, least, most):
    colors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.expr("vec_id div 40").alias("image_id"), (F.col("vec_id") % 40).cast("int").alias("idx"), (50 + 100 * F.col("embedding")[0]).cast("double").alias("L"), (200 * F.col("embedding")[1]).cast("double").alias("a"), (200 * F.col("embedding")[2]).cast("double").alias("b"), (F.col("vec_id") % 7).alias("n"))
    images = {}
    for r in colors.orderBy("image_id", "idx").collect():
        images.setdefault(r.image_id, []).append((r.L, r.a, r.b, r.n))
    got = {(r.image_id, r.idx): r for r in pal.refine(colors, least, most).collect()}
    assert len(got) == sum(map(len, images.values()))
    for image, rows in images.items():
        for i, (place, n, lab) in plain_refine(rows, least, most).items():
            r = got[image, i]
            assert (r.new_idx, r.n) == (place, n) and ((r.L is None) if lab is None else np.allclose((r.L, r.a, r.b), lab))


def plain_merge(areas, colors, near, least, contrast):
    """Small regions go to their nearest neighbour by colour, one by one; areas and near are changed."""
    into, queue = {i: i for i in areas}, deque(sorted(i for i in areas if areas[i] < least))
    while queue:
        i = queue.popleft()
        if into[i] != i or areas[i] >= least or not near[i]:
            continue
        far = [(pal.delta(colors[i], colors[j]), k, j) for k, j in enumerate(near[i])]
        if max(far)[0] >= contrast:
            continue
        j = min(far)[2]
        areas[j] += areas[i]
        for k in near[i]:
            if k != j:
                near[k] = [x for x in near[k] if x != i]
                if j not in near[k]:
                    near[k].append(j)
                if k not in near[j]:
                    near[j].append(k)
        near[j] = [x for x in near[j] if x != i]
        near[i], into[i] = [], j
        if areas[j] < least:
            queue.append(j)
    end = lambda i: i if into[i] == i else end(into[i])
    return {i: end(i) for i in into}


def test_merges_of_table_images_equal_plain_ones(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("l_suppkey AS image_id", "l_linenumber AS n", "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS p")
    cells = rows.select("image_id", (F.col("p") % 20).cast("int").alias("x"), F.floor(F.col("p") / 20).cast("int").alias("y"), F.least(F.floor((F.col("n") - 1) / 2), F.lit(2)).cast("int").alias("label"))
    found = regions.components(cells).cache()
    nodes = regions.stats(found).select("image_id", "region_id", "area", (F.lit(50.0) + F.col("label") * 9).alias("L"), (F.col("label") * 3.0).alias("a"), F.lit(0.0).alias("b"))
    edges = regions.adjacency(found)
    got = {(r.image_id, r.region_id): r.into for r in regions.merge(nodes, edges, 6).collect()}
    by, links = {}, {}
    for r in nodes.collect():
        by.setdefault(r.image_id, []).append(r)
    for r in edges.orderBy("image_id", "src", "dst").collect():
        links.setdefault(r.image_id, {}).setdefault(r.src, []).append(r.dst)
    for image, own in by.items():
        want = plain_merge({r.region_id: r.area for r in own}, {r.region_id: (r.L, r.a, r.b) for r in own}, {r.region_id: links[image].get(r.region_id, []) for r in own}, 6, regions.CONTRAST)
        assert {i: got[image, i] for i in want} == want
    final = regions.compact(found, regions.merge(nodes, edges, 6))
    assert final.count() == found.count() and final.select("image_id", "region_id").distinct().count() == len({(k[0], v) for k, v in got.items()})
    found.unpersist()
