import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromatile.operators import paint, raster, regions, stencil, vector
from chromatile.plans.convert import convert
from chromatile.sources import images, projects


def labels(spark, rows):
    return spark.createDataFrame([("i", x, y, v) for y, row in enumerate(rows) for x, v in enumerate(row)], "image_id string, x int, y int, label int")


def square(n, at, size, value=1):
    return [[value if at <= x < at + size and at <= y < at + size else 0 for x in range(n)] for y in range(n)]


def merged(spark, rows, lab, least):
    found = regions.settle(regions.components(labels(spark, rows)), "t")
    colors = spark.createDataFrame([(k, *map(float, v)) for k, v in lab.items()], "label int, L double, a double, b double")
    nodes = regions.stats(found).join(colors, "label").select("image_id", "region_id", "area", "L", "a", "b")
    done = regions.compact(found, regions.merge(nodes, regions.adjacency(found), least))
    return sorted(r.area for r in regions.stats(done).collect())


def kept_by_hand(points, epsilon):
    """Vertices that stay, one span at a time."""
    n = len(points)
    xs = [p[0] for p in points]
    left, right = xs.index(min(xs)), xs.index(max(xs))
    if n < 5 or left == right:
        return list(range(n))
    kept = set()

    def split(chain):
        kept.update((chain[0], chain[-1]))
        (ax, ay), (bx, by) = points[chain[0]], points[chain[-1]]
        length = math.hypot(bx - ax, by - ay) or 1.0
        off = [abs((points[k][0] - ax) * (by - ay) - (points[k][1] - ay) * (bx - ax)) / length for k in chain[1:-1]]
        if off and max(off) > epsilon:
            at = 1 + off.index(max(off))
            split(chain[: at + 1])
            split(chain[at:])

    for first, last in ((left, right), (right, left)):
        split([(first + k) % n for k in range((last - first) % n + 1)])
    return sorted(kept)


def test_components(spark):
    found = regions.components(labels(spark, square(10, 4, 2)))
    rows = {r.region_id: r for r in regions.stats(found).collect()}
    assert rows[0].area == 96 and rows[1].area == 4 and (rows[1].min_x, rows[1].max_y) == (4, 5)
    assert {(r.src, r.dst) for r in regions.adjacency(found).collect()} == {(0, 1), (1, 0)}
    diagonal = [[1 if x == y and x < 2 else 0 for x in range(10)] for y in range(10)]
    assert regions.stats(regions.components(labels(spark, diagonal))).filter("label = 1").count() == 2
    snake = [[1] * 9, [0] * 8 + [1], [1] * 9, [1] + [0] * 8, [1] * 9]
    assert regions.stats(regions.components(labels(spark, snake))).filter("label = 1").count() == 1


@pytest.mark.parametrize(
    ("rows", "lab", "least", "areas"),
    [
        (square(10, 4, 2), {0: (70, 5, 5), 1: (71, 5, 5)}, 10, [100]),
        (square(10, 4, 2), {0: (70, 5, 5), 1: (30, 40, 50)}, 10, [4, 96]),
        (square(10, 4, 2), {0: (70, 5, 5), 1: (30, 40, 50)}, 0, [4, 96]),
        ([[0, 1, 2, 0]], {0: (50, -4, -6), 1: (52, -2, -4), 2: (51, -3, -8)}, 3, [4]),
        (square(16, 7, 2), {0: (70, 0, 0), 1: (68, 0, 0)}, 100, [256]),
    ],
)
def test_merge(spark, rows, lab, least, areas):
    assert merged(spark, rows, lab, least) == areas


def test_contour_and_labels(spark):
    mask = stencil.contour_mask(labels(spark, [[0] * 4] * 2 + [[1] * 4] * 2)).filter("contour = 1").select("y").distinct().collect()
    assert {r.y for r in mask} == {1, 2}
    point = regions.label_points(regions.components(labels(spark, [[0] * 7] * 7))).first()
    assert (point.label_x, point.label_y, point.area) == (3.5, 3.5, 49)


def test_box_mean_replicates_edges(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0]
    df = spark.createDataFrame([("i", x, 0, v) for x, v in enumerate(values)], "image_id string, x int, y int, v double")
    got = [r.v for r in stencil.box_mean(df, ["v"], 3).orderBy("x").collect()]
    padded = values[:1] * 3 + values + values[-1:] * 3
    assert got == pytest.approx([sum(padded[x : x + 7]) / 7 for x in range(5)])


def test_outlines(spark):
    loops = vector.trace_loops(vector.boundary_edges(regions.components(labels(spark, square(6, 2, 2)))))
    rows = {(r.region_id, r.loop_id): r.points for r in loops.collect()}
    assert len(rows[(1, 0)]) == 9 and rows[(1, 0)][0] == rows[(1, 0)][-1] and len([k for k in rows if k[0] == 0]) == 2
    assert vector.simplify(np.array([(float(i), float(i)) for i in range(41)]), 1.2).sum() <= 3
    rng = np.random.default_rng(0)
    for _ in range(30):
        points = rng.integers(0, 12, (int(rng.integers(1, 60)), 2)).astype(float)
        assert np.flatnonzero(vector.simplify(points, 1.2)).tolist() == kept_by_hand(points.tolist(), 1.2)
    corners = spark.createDataFrame([([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)],)], "ps array<struct<x: double, y: double>>")
    smooth = vector.chaikin(corners, 2, "ps").first().ps
    long = corners.select(F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.struct(i.cast("double").alias("x"), (i % 7).cast("double").alias("y"))).alias("ps"))
    assert vector.chaikin(long, 2, "ps").select(F.size("ps").alias("n")).first().n == 80_000
    assert len(smooth) == 16 and all(0 <= p.x <= 10 and 0 <= p.y <= 10 for p in smooth)


def test_undo_redo(spark):
    log = spark.createDataFrame([(1, i, t) for i, t in enumerate(["brush", "brush", "undo", "redo", "undo", "brush", "redo", "undo", "undo", "undo"])], "project_id int, seq long, tool string")
    row = paint.undo_redo(log).first()
    assert (row.done, row.redo) == ([], [5, 0])
    row = paint.undo_redo(log.filter("seq < 7"), most=1).first()
    assert (row.done, row.redo) == ([5], [])


def test_dedupe_points(spark):
    df = spark.createDataFrame([([(0.0, 0.0, 0.5), (0.005, 0.0, 0.5), (0.009, 0.0, 0.5), (0.011, 0.0, 0.5), (5.0, 5.0, 1.0)],), (None,), ([],)], f"ps {paint.POINTS}")
    assert [p.x for p in df.select(paint.dedupe_points(F.col("ps")).alias("ps")).first().ps] == [0.0, 0.011, 5.0]
    assert [r.ps for r in df.select(paint.dedupe_points(F.col("ps")).alias("ps")).collect()][1:] == [None, []]


def test_images_and_store(spark, tmp_path):
    px = raster.scene(spark, 12).withColumn("a", F.lit(255))
    data = images.to_png(px, raster.sizes(px)).first().png
    (tmp_path / "scene.png").write_bytes(data)
    (tmp_path / "notes.txt").write_text("no image")
    back = images.read_images(spark, str(tmp_path))
    assert back.join(px.select("p", "r", "g", "b"), ["p", "r", "g", "b"]).count() == 144
    blobs = images.labels_to_blob(px.select("image_id", "p", F.col("part").alias("label")))
    assert images.blob_to_labels(blobs).join(px.select("p", F.col("part").cast("long").alias("label")), ["p", "label"]).count() == 144
    store = spark.createDataFrame([(1, 10, 10), (2, 20, 20)], "id int, created_at int, updated_at int")
    saved = projects.upsert(store, spark.createDataFrame([(2, None, 30), (3, None, 31)], "id int, created_at int, updated_at int"))
    assert [tuple(r) for r in projects.listing(saved).collect()] == [(3, 31, 31), (2, 20, 30), (1, 10, 10)]


def test_convert_stripes(spark):
    two = raster.grid(spark, 60, 40).withColumn("image_id", F.explode(F.array(F.lit("u"), F.lit("v"))))
    stripe = (F.col("x") / 20).cast("int")
    pick = lambda *v: F.element_at(F.array(*[F.lit(c) for c in v]), stripe + 1)
    made = convert(two.withColumns({"r": pick(200, 60, 70), "g": pick(60, 160, 90), "b": pick(60, 80, 210)}), least_area=20)
    areas = made.labels.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("region_id").alias("k")).collect()
    assert {r.image_id for r in areas} == {"u", "v"} and all(r.n == 2400 and r.k >= 3 for r in areas)
    assert made.palette.agg(F.sum("pixel_count")).first()[0] == 4800


def test_convert_of_several_sizes(spark):
    """Images of two sizes, one of which is reduced and translucent; pixels keep the clusters of the fit."""
    big = raster.grid(spark, 48, 40, "big").withColumns({"r": F.lit(0), "g": (F.col("x") * 5).cast("int"), "b": F.lit(40), "a": F.lit(0)})
    low = raster.grid(spark, 20, 16, "low").withColumns({"r": F.when(F.col("y") < 8, 220).otherwise(20), "g": F.lit(30), "b": F.lit(90), "a": F.lit(255)})
    made = convert(big.unionByName(low), least_area=4, max_side=24)
    assert {tuple(r) for r in made.images.collect()} == {("big", 24, 20), ("low", 20, 16)}
    assert {r.image_id: r["count"] for r in made.labels.groupBy("image_id").count().collect()} == {"big": 480, "low": 320}
    palette = made.palette.filter("pixel_count > 0").collect()
    assert {r.hex for r in palette if r.image_id == "big"} == {"#ffffff"} and len([r for r in palette if r.image_id == "low"]) >= 2


def test_downscale_against_plain_sampling(spark):
    rng = np.random.default_rng(1)
    for w, h, most in ((7, 5, 4), (11, 30, 9), (6, 6, 6), (1, 9, 2)):
        values = rng.integers(0, 255, (h, w)).astype(float)
        df = spark.createDataFrame([("i", x, y, float(values[y, x])) for y in range(h) for x in range(w)], "image_id string, x int, y int, v double")
        scale = min(1.0, most / max(w, h))
        nw, nh = max(1, math.floor(w * scale + 0.5)), max(1, math.floor(h * scale + 0.5))
        got = {(r.x, r.y): r.v for r in raster.downscale(df, most, ("v",)).collect()}
        assert len(got) == nw * nh
        for (x, y), v in got.items():
            sx, sy = min(w - 1, (x + 0.5) * (w / nw) - 0.5), min(h - 1, (y + 0.5) * (h / nh) - 0.5)
            x0, y0 = max(0, math.floor(sx)), max(0, math.floor(sy))
            x1, y1, fx, fy = min(w - 1, x0 + 1), min(h - 1, y0 + 1), max(0.0, sx - x0), max(0.0, sy - y0)
            top, bottom = (values[k, x0] * (1 - fx) + values[k, x1] * fx for k in (y0, y1))
            assert v == pytest.approx(top * (1 - fy) + bottom * fy)


def test_closure_of_odd_pairs(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 4), (5, 4)], "id int, into int")
    assert {tuple(r) for r in regions.closure(pairs).collect()} == {(1, 3), (2, 3), (4, 4), (5, 4)}


def test_store_of_repeated_changes(spark):
    schema = "id string, created_at int, updated_at int, palette array<string>, color_count int"
    store = spark.createDataFrame([("a", 1, 1, ["#fff"], 1)], schema)
    changes = spark.createDataFrame([("a", None, 5, ["#000", "#111"], None), ("a", None, 7, [], None), (None, None, 8, ["#222"], None)], schema)
    saved = projects.upsert(store, projects.with_ids(changes)).collect()
    assert {(r.id, r.created_at, r.updated_at, r.color_count) for r in saved if r.id == "a"} == {("a", 1, 7, 0)}
    assert [len(r.id) for r in saved if r.id != "a"] == [36] and projects.upsert(store, changes.limit(0)).count() == 1


def test_layers(spark):
    paint_ = spark.createDataFrame([("i", 0, 0, 200, 100, 0, 255), ("i", 1, 0, 200, 100, 0, 51), ("i", 2, 0, None, None, None, None)], "image_id string, x int, y int, r int, g int, b int, a int")
    mask = spark.createDataFrame([("i", 0, 0), ("i", 9, 9)], "image_id string, x int, y int")
    rows = {r.x: (r.r, r.g, r.b, r.a) for r in raster.compose(paint_, mask).collect()}
    assert rows == {0: (0, 0, 0, 255), 1: (244, 224, 204, 255), 2: (255, 255, 255, 255)}
    assert raster.compose(paint_.limit(0)).count() == 0


def test_thumbnails(spark):
    scene = raster.scene(spark, 120).withColumn("a", F.lit(255))
    broken = spark.createDataFrame([("none", None, None, 1, 2, 3, 255)], "image_id string, x int, y int, r int, g int, b int, a int")
    rows = {r.image_id: r.png for r in images.thumbnails(scene.select("image_id", "x", "y", "r", "g", "b", "a").unionByName(broken)).collect()}
    assert rows["none"] is None and rows["scene"][:4] == b"\x89PNG" and rows["scene"][16:24] == (96).to_bytes(4, "big") * 2


def test_undo_redo_stream(spark, tmp_path):
    from chromatile.streaming import paint as stream

    kinds = ["brush", "brush", "undo", "redo", "undo", "brush", "redo", "undo"]
    log = spark.createDataFrame([(p, i, t) for p in (1, 2) for i, t in enumerate(kinds) if p == 1 or i < 5], "project_id int, seq long, tool string")
    for k, (low, high) in enumerate(((0, 3), (3, 8))):
        log.filter((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = stream.undo_redo(source).writeStream.outputMode("update").format("memory").queryName("stacks").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {}
    for r in spark.table("stacks").collect():
        last[r.project_id] = (r.done, r.redo)
    assert last == {r.project_id: (r.done, r.redo) for r in paint.undo_redo(log).collect()}


def test_runs_and_regions_are_not_broadcast(spark):
    """Files and kernels with a row a run or region look small to Spark, however many rows they hold."""
    plain = regions.settle(labels(spark, square(12, 3, 5)).withColumn("region_id", F.col("label").cast("long")), "plain")
    merged = regions.settle(plain.select("image_id", "region_id", F.col("region_id").alias("into")).distinct(), "into")
    for made in (regions.components(plain.drop("region_id")), regions.compact(plain, merged)):
        assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()


def test_superpixels_are_not_broadcast(spark, monkeypatch):
    """In a conversion the tables with a row a superpixel meet in shuffle joins."""
    plans = {}

    def noted(df, name, settle=regions.settle):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return settle(df, name)

    monkeypatch.setattr(regions, "settle", noted)
    rng = np.random.default_rng(3)
    rows = [("i", x, y, *map(int, rng.integers(0, 256, 3))) for x in range(10) for y in range(8)]
    made = convert(spark.createDataFrame(rows, "image_id string, x int, y int, r int, g int, b int"), least_area=2)
    assert made.labels.count() == 80
    assert plans["superpixels"].count("SortMergeJoin") >= 2
    assert "BroadcastHashJoin" not in plans["labels"] and plans["labels"].count("SortMergeJoin") == 2


def test_labels_are_made_once_for_their_components(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    pixels = labels(spark, square(12, 3, 5)).repartition("image_id", "x")
    found = regions.components(pixels.mapInArrow(counted, pixels.schema))
    assert {(r.label, r.region_id) for r in found.collect()} == {(0, 0), (1, 1)} and made.value == 144


def test_settled_tables_leave_no_shuffle_files(spark):
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = held()
    table = regions.settle(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    assert table.count() == 100
    regions.settle(spark.range(5000).repartition(3, "id"), "dealt")
    assert held() <= before + 2  # of the count above, which nothing has written down
