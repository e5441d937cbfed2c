import hashlib

import numpy as np
import pytest

from chromatile.llm import ball_kmeans


def plain(rows, k=16, rounds=3, dim=64):
    """(id, cluster, distance, cluster_inertia, inertia, sha) of every kept row, by comparing everything with everything."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(max(-ball_kmeans.LIMIT, min(ball_kmeans.LIMIT, np.floor(64.0 * x)))) for x in v]))
    seed = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=seed)[:k]]
    d = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for step in range(rounds + 1):
        own = [min(range(len(centres)), key=lambda j, v=v: (d(v, centres[j]), j)) for _, v in kept]
        if step < rounds:
            for j in range(len(centres)):
                members = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
                if members:
                    centres[j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    near = [d(v, centres[o]) for (_, v), o in zip(kept, own, strict=True)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, o, n, sum(x for x, p in zip(near, own, strict=True) if p == o), sum(near), sha[o]) for (i, _), o, n in zip(kept, own, near, strict=True)]


def rows_of(spark, rows, **more):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("_id", "_v", "_cluster", "cluster", "n"):
        table = table.selectExpr("*", f"'x' AS {name}")
    return sorted(map(tuple, ball_kmeans.cluster(table.repartition(3), **more).collect()), key=str)


def cloud(n, seed=0, spread=0.2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(7, 64))
    return [(int(i), [float(np.float32(x)) for x in centre[i % 7] + spread * rng.normal(size=64)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 0.4, 2.0])
def test_rounds_equal_plain_ones(spark, spread):
    rows = cloud(300, spread=spread)
    assert rows_of(spark, rows) == sorted(plain(rows), key=str)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    some = cloud(40)
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [nan] + [1.0] * 63), (906, [-inf] + [1.0] * 63)]
    repeats = [some[0], some[0], (None, some[1][1]), (None, some[2][1]), (700, [0.0] * 64), (701, [0.0] * 64), (702, [3e38] + [0.0] * 63), (702, [-3e38] + [0.0] * 63)]
    assert rows_of(spark, some + bad + repeats) == sorted(plain(some + bad + repeats), key=str)
    assert rows_of(spark, some[:5]) == sorted(plain(some[:5]), key=str)  # fewer vectors than centroids
    same = [(i, [0.5] * 64) for i in range(50)]  # a hot vector; all but one centroid end up empty
    assert rows_of(spark, same) == sorted(plain(same), key=str)
    assert rows_of(spark, []) == [] and rows_of(spark, bad) == []


def test_ties_go_to_the_smaller_number(spark):
    grid = [(i, [float((i >> b) & 1) / 64 if b < 6 else 0.0 for b in range(64)]) for i in range(64)]  # corners of a cube: many equal distances
    assert rows_of(spark, grid) == sorted(plain(grid), key=str)


def test_balls_save_comparisons():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (16, 64)).astype(np.int64)
    x = np.concatenate([c + rng.integers(-40, 40, (200, 64)) for c in centres]).astype(np.int32)
    own, held = ball_kmeans.first_assignment(x, centres)
    radii = [int(held[own == i].max()) for i in range(16)]
    moved = np.array([x[own == i].sum(axis=0) // (own == i).sum() for i in range(16)])
    balls = ball_kmeans.Balls.of(moved, centres, radii)
    cluster, distance, computed = ball_kmeans.assign(x, balls, own, held)
    again, far = ball_kmeans.first_assignment(x, moved)
    assert (cluster == again).all() and (distance == far).all() and computed == len(x)  # no neighbours: own centroid only
    still = ball_kmeans.Balls.of(moved, moved, [int(far[again == i].max()) for i in range(16)])
    assert ball_kmeans.assign(x, still, cluster, distance)[2] == 0


@pytest.mark.parametrize("seed", range(5))
def test_assignment_is_exact_on_crowded_balls(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-4, 5, (500, 4)).astype(np.int32)
    centres = x[:12].astype(np.int64)
    own, held = ball_kmeans.first_assignment(x, centres)
    for _ in range(4):
        moved = np.array([x[own == i].sum(axis=0, dtype=np.int64) // max(1, (own == i).sum()) if (own == i).any() else centres[i] for i in range(12)])
        radii = [int(held[own == i].max()) if (own == i).any() else 0 for i in range(12)]
        own, held, _ = ball_kmeans.assign(x, ball_kmeans.Balls.of(moved, centres, radii), own, held)
        again, far = ball_kmeans.first_assignment(x, moved)
        assert (own == again).all() and (held == far).all()
        centres = moved
