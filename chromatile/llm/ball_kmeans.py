"""Ball k-means: exact Lloyd rounds that compare a vector only with the centroids that could win it.

A cluster is a ball: its centroid and a radius no member lies beyond. A centroid whose distance from
the ball's own is over twice the radius cannot win a member, so only the others are its neighbours.
Members nearer to their centroid than half the way to the closest neighbour are the stable core and
are compared with nothing; the rest lie in annuli, one for each further neighbour whose half way they
pass, and are compared with just the neighbours of their annulus and those inside it. Balls that have
neither moved nor have a neighbour that did are left alone.

Vectors are whole numbers and all comparisons are exact. The driver holds centroids and balls only
(``k`` times the number of components); vectors with their cluster and distance are a table, written
once a round, and sums are made by task and cluster before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise

#: Components stay within this bound, so that squared distances fit 64 bits for up to 64 components.
LIMIT = (1 << 27) - 1
#: Vectors compared at once in a task.
STEP = 4096


def whole_vectors(vectors: DataFrame, dim: int = 64, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """_id, _v: of each vector with exactly ``dim`` components, none null or not finite, floor(scale * component).

    Components are taken as double. What lies beyond ``LIMIT`` is set to it.
    """
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), c * scale))).cast("int"))
    return vectors.filter((F.size(vector_col) == dim) & F.coalesce(finite, F.lit(False))).select(F.col(id_col).alias("_id"), whole.alias("_v"))


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of whole vectors x (n, dim) from one centre, exact."""
    gap = x.astype(np.int64) - centre
    return np.einsum("ij,ij->i", gap, gap)


@dataclass(frozen=True)
class Balls:
    """Centroids, which of them moved in the last round, and each ball's neighbours, closest first."""

    centres: np.ndarray
    moved: np.ndarray
    neighbours: list[list[tuple[int, int]]]  # (squared distance of the centroids, number)

    @classmethod
    def of(cls, centres: np.ndarray, before: np.ndarray, radii: list[int]) -> Balls:
        """radii: squared, of the balls around the centroids ``before``; members have not changed since."""
        shift = [int(d) for d in ((centres - before) ** 2).sum(axis=1)]
        neighbours = []
        for i, (radius, by) in enumerate(zip(radii, shift, strict=True)):
            reach = isqrt(radius) + 1 + (isqrt(by) + 1 if by else 0)  # a whole number that is no smaller than the new radius
            gaps = [int(d) for d in ((centres - centres[i]) ** 2).sum(axis=1)]
            neighbours.append(sorted((gap, j) for j, gap in enumerate(gaps) if j != i and gap <= 4 * reach * reach))
        return cls(centres, np.array([by > 0 for by in shift]), neighbours)


def assign(x: np.ndarray, balls: Balls, own: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (of equally near ones the smallest number), squared distance, and how many distances were computed.

    own, held: each vector's cluster and its distance from that centroid before it moved.
    """
    cluster, distance, computed = own.copy(), held.copy(), 0
    for i in np.unique(own):
        near = balls.neighbours[i]
        if not balls.moved[i] and not any(balls.moved[j] for _, j in near):
            continue
        at = np.flatnonzero(own == i)
        if balls.moved[i]:
            distance[at] = distances(x[at], balls.centres[i])
            computed += len(at)
        half = 4 * distance[at]  # compared with squared distances of centroids
        order = np.argsort(half, kind="stable")
        at, half = at[order], half[order]
        best, winner = distance[at].copy(), np.full(len(at), i, own.dtype)
        for gap, j in near:
            first = np.searchsorted(half, gap)  # from here on a vector may be as near to j: the annuli from j outwards
            if first == len(at):
                break
            other = distances(x[at[first:]], balls.centres[j])
            computed += len(other)
            wins = (other < best[first:]) | ((other == best[first:]) & (j < winner[first:]))
            best[first:][wins], winner[first:][wins] = other[wins], j
        cluster[at], distance[at] = winner, best
    return cluster, distance, computed


def first_assignment(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance where there are no balls yet: all centroids are compared."""
    cluster, distance = np.zeros(len(x), np.int32), distances(x, centres[0])
    for j in range(1, len(centres)):
        other = distances(x, centres[j])
        wins = other < distance
        cluster[wins], distance[wins] = j, other[wins]
    return cluster, distance


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _assigned(rows: DataFrame, dim: int, centres: np.ndarray, balls: Balls | None) -> DataFrame:
    """_id, _v, _cluster, _distance of ``rows``; with balls, from the clusters and distances they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                x = _matrix(part.column(1), dim)
                if balls is None:
                    cluster, distance = first_assignment(x, centres)
                else:
                    cluster, distance, _ = assign(x, balls, part.column(2).to_numpy(), part.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["_id", "_v", "_cluster", "_distance"])

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _v array<int>, _cluster int, _distance long")


def _sums(rows: DataFrame, dim: int, k: int) -> dict[int, tuple[int, int, int, list[int]]]:
    """By cluster: size, squared radius, sum of distances, sums of components. Tasks send one row a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, radius, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        inertia = [0] * k
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                x, cluster, distance = _matrix(part.column(0), dim), part.column(1).to_numpy(), part.column(2).to_numpy()
                for i in np.unique(cluster):
                    at = cluster == i
                    n[i] += at.sum()
                    radius[i] = max(radius[i], distance[at].max())
                    sums[i] += x[at].sum(axis=0, dtype=np.int64)
                    inertia[i] += sum(distance[at].tolist())
        some = np.flatnonzero(n)
        arrays = [pa.array(some, pa.int32()), pa.array(n[some]), pa.array(radius[some]), pa.array([str(inertia[i]) for i in some], pa.string()), pa.array(list(sums[some]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["_cluster", "n", "radius", "inertia", "sums"])

    parts = rows.select("_v", "_cluster", "_distance").mapInArrow(run, "_cluster int, n long, radius long, inertia string, sums array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    each = parts.select("_cluster", "n", "radius", "inertia", F.posexplode("sums").alias("at", "sum"))
    first = F.col("at") == 0
    by_place = each.groupBy("_cluster", "at").agg(exact("sum").alias("sum"), F.sum(F.when(first, F.col("n"))).alias("n"), F.max("radius").alias("radius"), F.sum(F.when(first, F.col("inertia").cast("decimal(38,0)"))).alias("inertia"))
    found: dict[int, tuple[int, int, int, list[int]]] = {}
    for r in sorted(by_place.collect(), key=lambda r: (r["_cluster"], r["at"])):  # k times the number of components
        if r["at"] == 0:
            found[r["_cluster"]] = (r["n"], r["radius"], int(r["inertia"]), [])
        found[r["_cluster"]][3].append(int(r["sum"]))
    return found


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dim: int = 64, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector taken in: its id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors are those of ``whole_vectors``; others take no part. Centroids start as the ``k`` vectors
    with the smallest sha256 of ``<seed>:<id>`` (all of them, if fewer), ties by components; null ids
    come last. Each round assigns every vector to its nearest centroid, the smallest number among
    equally near ones, and sets each centroid with vectors to the floor of their mean; a last
    assignment follows. Repeated rows count one by one. An inertia that does not fit 64 bits is null. An
    empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, dim, scale, id_col, vector_col)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    seeds = rows.orderBy(order.asc_nulls_last(), "_v").limit(k).select("_v").collect()
    out = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not seeds:
        return spark.createDataFrame([], out)
    centres = np.array([r["_v"] for r in seeds], np.int64)
    held, balls = materialise(_assigned(rows, dim, centres, None), "balls"), None
    for step in range(rounds + 1):
        found = _sums(held, dim, len(centres))
        if step == rounds:
            break
        moved = centres.copy()
        for i, (n, _, _, sums) in found.items():
            moved[i] = [s // n for s in sums]
        balls = Balls.of(moved, centres, [found[i][1] if i in found else 0 for i in range(len(centres))])
        before, centres = held, moved
        held = materialise(_assigned(before, dim, centres, balls), "balls")
        discard(before)
    digest = [sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    fits = lambda n: n if n < 1 << 63 else None
    total = fits(sum(f[2] for f in found.values()))
    facts = spark.createDataFrame([(i, fits(f[2]), total, digest[i]) for i, f in found.items()], "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return held.join(F.broadcast(facts), "_cluster").select(F.col("_id").alias(id_col), F.col("_cluster").alias("cluster"), F.col("_distance").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def _op12_sql(k: int = 16, rounds: int = 3) -> str:
    parts = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(CAST(x AS DOUBLE))]) = 64
),
x AS MATERIALIZED (SELECT r, p, v[p] AS x FROM v, range(1, 65) AS t(p)),
c0 AS MATERIALIZED (
  SELECT cluster, p, v[p] AS c
  FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v FROM v) AS s, range(1, 65) AS t(p)
  WHERE cluster < {k}
)"""]
    for i in range(rounds + 1):
        parts.append(f"""
d{i} AS MATERIALIZED (SELECT r, cluster, sum((x - c) * (x - c)) AS d FROM x JOIN c{i} USING (p) GROUP BY r, cluster),
a{i} AS MATERIALIZED (SELECT r, cluster, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)""")
        if i < rounds:
            parts.append(f"""
m{i} AS MATERIALIZED (SELECT cluster, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY cluster, p),
c{i + 1} AS MATERIALIZED (
  SELECT cluster, p, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster, p)
)""")
    return f"""WITH {','.join(parts)},
h AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN h USING (cluster)
"""


OP12_SQL = _op12_sql()
