import numpy as np
import pytest
from pyspark.sql import functions as F

from chromatile.functions import color as C
from chromatile.operators import palette as P

# Published CIEDE2000 pairs (a part of the table).
PAIRS = [
    (50, 2.6772, -79.7751, 50, 0, -82.7485, 2.0425),
    (50, -1.3802, -84.2814, 50, 0, -82.7485, 1.0),
    (50, 2.5, 0, 73, 25, -18, 27.1492),
    (50, 2.5, 0, 56, -27, -3, 31.903),
    (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
    (22.7233, 20.0904, -46.694, 23.0331, 14.973, -42.5619, 2.0373),
    (90.9257, -0.5406, -0.9208, 88.6381, -0.8985, -0.7239, 1.5381),
    (2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514, 0.9082),
]


def test_ciede2000(spark):
    df = spark.createDataFrame([tuple(map(float, p)) for p in PAIRS], "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, e double")
    p, q = [F.col(c) for c in ("l1", "a1", "b1")], [F.col(c) for c in ("l2", "a2", "b2")]
    for row in df.select(C.ciede2000(p, q).alias("d"), C.ciede2000(q, p).alias("r"), C.ciede2000(p, p).alias("z"), "e").collect():
        assert row.d == pytest.approx(row.e, abs=0.0002) and row.r == pytest.approx(row.d) and row.z == 0
    for *v, e in PAIRS:
        assert P.delta(np.array(v[:3]), np.array(v[3:])) == pytest.approx(e, abs=0.0002)


def test_round_trip_and_hex(spark):
    rgb = [(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128), (255, 128, 0), (30, 200, 150), (17, 4, 201)]
    df = spark.createDataFrame(rgb, "r int, g int, b int")
    lab = df.select("r", "g", "b", *[c.alias(k) for c, k in zip(C.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")), ("lL", "la", "lb"), strict=True)])
    for row in lab.select("*", F.array(*C.lab_to_rgb(F.col("lL"), F.col("la"), F.col("lb"))).alias("back"), C.lab_to_hex(F.col("lL"), F.col("la"), F.col("lb")).alias("hex")).collect():
        assert tuple(row.back) == (row.r, row.g, row.b) and row.hex == f"#{row.r:02x}{row.g:02x}{row.b:02x}"
    texts = spark.createDataFrame([(t,) for t in ("abc", " #A0b1C2 ", "nope", "#12345", None)], "t string")
    got = [tuple(r) for r in texts.select(F.array(*C.parse_hex(F.col("t"))), F.array(*C.fill_hex(F.col("t")))).collect()]
    assert got == [([170, 187, 204], [255] * 3), ([160, 177, 194], [255] * 3), ([None] * 3, [255] * 3), ([None] * 3, [255] * 3), ([None] * 3, [255] * 3)]


def test_symbols(spark):
    rows = spark.range(38).select(C.symbol_for(F.col("id")).alias("s")).withColumn("i", C.index_for_symbol(F.col("s"))).collect()
    assert "".join(r.s for r in rows) == "1234567890ABCDEFGHIJKLMNOPQRSTUVWXYZ??" and [r.i for r in rows] == [*range(36), None, None]


def test_kmeans_kernel():
    three = np.array([(50, 60, 40), (65, -50, 40), (40, 20, -70)] * 100, float)
    colors, labels, counts = P.quantize(three, 3, 42)
    assert sorted(map(tuple, colors)) == sorted({tuple(t) for t in three}) and list(counts) == [100] * 3 and len(set(labels)) == 3
    assert len(P.quantize(np.zeros((0, 3)), 3, 1)[0]) == 0
    flat = np.full((40, 3), 5.0)
    assert (P.quantize(flat, 4, 1)[0] == 5).all()


def test_refine(spark):
    rows = [("i", 0, 70.0, 5.0, 5.0, 500), ("i", 1, 69.0, 6.0, 4.0, 300), ("i", 2, 30.0, 40.0, 50.0, 200)]
    got = {r.idx: r for r in P.refine(spark.createDataFrame(rows, "image_id string, idx int, L double, a double, b double, n long"), 12.0).collect()}
    assert got[0].new_idx == got[1].new_idx == 0 and got[0].n == 800 and got[2].new_idx == 1 and got[2].n == 200
    many = [("i", i, 2.0 * i, i % 2 * 80.0 - 40, 13 * i % 4 * 40.0 - 60, 10) for i in range(50)]
    assert P.refine(spark.createDataFrame(many, "image_id string, idx int, L double, a double, b double, n long"), 2.0).agg(F.max("new_idx")).first()[0] < 36


def test_palette_refine_takes_every_embedding(spark):
    from chromatile.plans import queries as Q

    sf = "/root/testdata/sf0.1"
    rows = Q.palette_refine(spark, sf).collect()
    ids = sorted(int(r.image_id) * Q.REFINED + r.idx for r in rows)
    assert ids == sorted(r.vec_id for r in Q.colors(spark, sf).select("vec_id").collect()) and len(ids) == 2000
    clusters = {(r.image_id, r.new_idx): r.n for r in rows}
    assert sum(clusters.values()) == sum(1 + i % 9 for i in ids) and max(r.new_idx for r in rows) == P.MAX_COLORS - 1
