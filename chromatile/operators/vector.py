"""Outlines of regions: edges, loops, simplification, smoothing, paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stencil import neighbours4

POINTS = "array<struct<x: double, y: double>>"


def boundary_edges(labelled: DataFrame) -> DataFrame:
    """Directed unit edges around each region, its inside on one side: x1, y1, x2, y2 and ``seq`` (raster order, then side)."""
    x, y, here = F.col("x"), F.col("y"), F.col("region_id")
    sides = (("_right", (x + 1, y + 1, x + 1, y)), ("_left", (x, y, x, y + 1)), ("_down", (x, y + 1, x + 1, y + 1)), ("_up", (x + 1, y, x, y)))
    edge = lambda k, near, ends: F.when(F.coalesce(F.col(near) != here, F.lit(True)), F.struct(F.lit(k).alias("side"), *[e.alias(n) for n, e in zip(("x1", "y1", "x2", "y2"), ends, strict=True)]))
    found = neighbours4(labelled, "region_id").select("image_id", "region_id", x, y, F.explode(F.array(*[edge(k, n, e) for k, (n, e) in enumerate(sides)])).alias("e"))
    return found.filter("e IS NOT NULL").select("image_id", "region_id", F.struct("y", "x", "e.side").alias("seq"), "e.x1", "e.y1", "e.x2", "e.y2")


def _loops(starts: list[tuple], ends: list[tuple]) -> list[list[tuple]]:
    waiting: dict[tuple, list[int]] = {}
    for k in range(len(starts) - 1, -1, -1):
        waiting.setdefault(starts[k], []).append(k)  # the first edge of a place is last in its list
    free, loops = [True] * len(starts), []
    for k in range(len(starts)):
        if not free[k]:
            continue
        loop, at = [starts[k]], k
        while at is not None:
            free[at] = False
            loop.append(ends[at])
            others = waiting.get(ends[at], [])
            while others and not free[others[-1]]:
                others.pop()
            at = others.pop() if others else None
        if len(loop) >= 4:
            loops.append(loop)
    return loops


def _runs(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys begin in a table that has rows."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in keys:
        codes = table[name].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def trace_loops(edges: DataFrame) -> DataFrame:
    """Closed loops of each region: loop_id and points (the first one again at the end).

    At a place where several edges go on, the first unused one in raster order is taken. Edges are sorted by
    region and streamed: a task holds the edges of one batch and of the region that goes on in the next one.
    """
    keys = ["image_id", "region_id"]

    def traced(table: pa.Table) -> pa.RecordBatch:
        starts = _runs(table, keys)
        corners = [list(zip(table[f"x{k}"].to_pylist(), table[f"y{k}"].to_pylist(), strict=True)) for k in (1, 2)]
        rows, ids, points = [], [], []
        for first, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            for k, loop in enumerate(_loops(corners[0][first:end], corners[1][first:end])):
                rows.append(first)
                ids.append(k)
                points.append(loop)
        flat = np.array([p for loop in points for p in loop], float).reshape(-1, 2)
        offsets = pa.array(np.cumsum([0, *map(len, points)]).astype(np.int32))
        vertices = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in (0, 1)], ["x", "y"]))
        named = [table[c].combine_chunks().take(pa.array(rows, pa.int64())) for c in keys]
        return pa.RecordBatch.from_arrays([*named, pa.array(ids, pa.int32()), vertices], [*keys, "loop_id", "points"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the region that is still open
        for batch in batches:
            if not batch.num_rows:
                continue
            lead = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            begins = _runs(pa.Table.from_batches([*lead, batch]), keys) - len(lead)
            cut = int(begins[-1])
            if held and cut < 0:
                held.append(batch)
                continue
            if held or cut:
                yield traced(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield traced(pa.Table.from_batches(held))

    flat = edges.select(*keys, (F.col("seq.y").cast("long") * (1 << 32) + F.col("seq.x").cast("long") * 4 + F.col("seq.side")).alias("seq"), "x1", "y1", "x2", "y2")
    kinds = [edges.schema[c].dataType.simpleString() for c in keys]
    return flat.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInArrow(run, f"image_id {kinds[0]}, region_id {kinds[1]}, loop_id int, points {POINTS}")


def simplify(points: np.ndarray, epsilon: float) -> np.ndarray:
    """Which vertices (n, 2) of a closed line stay: Douglas-Peucker on both ways between its leftmost and rightmost vertex.

    All spans that are still open are split at once: their largest offsets come from one pass over the
    vertices. Below five vertices all stay.
    """
    n = len(points)
    left, right = points[:, 0].argmin(), points[:, 0].argmax()
    if n < 5 or left == right:
        return np.ones(n, bool)
    ring = np.roll(np.arange(n), -left)  # from the leftmost vertex round to it again
    line = np.vstack([points[ring], points[left]])
    ends = np.array([0, (right - left) % n, n])
    open_ = np.ones(2, bool)  # spans between neighbouring ends
    while open_.any():
        starts, stops = ends[:-1][open_], ends[1:][open_]
        span = np.repeat(np.arange(len(starts)), np.maximum(stops - starts - 1, 0))
        first = np.cumsum(np.maximum(stops - starts - 1, 0)) - np.maximum(stops - starts - 1, 0)
        inner = starts[span] + 1 + np.arange(len(span)) - first[span]
        side = line[stops] - line[starts]
        length = np.hypot(side[:, 0], side[:, 1])
        length[length == 0] = 1.0
        off = line[inner] - line[starts][span]
        far = np.abs(off[:, 0] * side[span, 1] - off[:, 1] * side[span, 0]) / length[span]
        top = np.zeros(len(starts))
        np.maximum.at(top, span, far)
        splits = np.flatnonzero(top > epsilon)
        hit = np.full(len(starts), len(line))
        best = far == top[span]
        np.minimum.at(hit, span[best], inner[best])  # the first of equally far vertices
        new = hit[splits]
        known = np.flatnonzero(open_)[splits]
        fresh = np.zeros(len(ends) - 1, bool)
        fresh[known] = True
        ends, open_ = np.insert(ends, known + 1, new), np.repeat(fresh, np.where(fresh, 2, 1))
    kept = np.zeros(n, bool)
    kept[ring[ends[:-1]]] = True
    return kept


def _redrawn(lines: DataFrame, column: str, redraw: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``lines`` with the points of ``column`` redrawn: ``redraw`` takes all vertices of a batch (n, 2) and where each line ends, and gives both anew."""
    typed = lines.withColumn(column, F.col(column).cast(POINTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            held = batch.column(at)
            sizes = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = held.flatten()
            points = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1).astype(float) if len(flat) else np.zeros((0, 2))
            points, ends = redraw(points, np.cumsum(sizes))
            vertices = pa.StructArray.from_arrays([pa.array(points[:, k]) for k in (0, 1)], ["x", "y"])
            offsets = pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[held.is_null().to_numpy(zero_copy_only=False), False])
            yield batch.set_column(at, pa.field(column, batch.schema.field(at).type), pa.ListArray.from_arrays(offsets, vertices).cast(batch.schema.field(at).type))

    return typed.mapInArrow(run, typed.schema)


def simplified(loops: DataFrame, epsilon: float = 1.2) -> DataFrame:
    """Loops with their points simplified; those of fewer than three vertices go."""

    def redraw(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept = [simplify(points[start:end], epsilon) if end > start else np.zeros(0, bool) for start, end in zip(np.r_[0, ends[:-1]], ends, strict=True)]
        stays = np.concatenate(kept) if kept else np.zeros(0, bool)
        return points[stays], np.cumsum([k.sum() for k in kept]) if kept else ends

    return _redrawn(loops, "points", redraw).filter(F.size("points") >= 3)


def chaikin(lines: DataFrame, rounds: int = 2, column: str = "points") -> DataFrame:
    """Corner cutting of closed lines (array of x, y): two vertices at 1/4 and 3/4 of every side.

    All lines of a batch are cut at once, in time linear in the vertices made. As an array expression the
    optimiser would copy one round into the next one's lambda, where an explode asks for the size.
    """

    def redraw(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            following = np.arange(1, len(points) + 1)
            starts = np.r_[0, ends[:-1]]
            some = ends > starts
            following[ends[some] - 1] = starts[some]
            after = points[following] if len(points) else points
            points = np.stack([points * 0.75 + after * 0.25, points * 0.25 + after * 0.75], axis=1).reshape(-1, 2)
            ends = ends * 2
        return points, ends

    return _redrawn(lines, column, redraw)


def paths(loops: DataFrame) -> DataFrame:
    """An SVG path for each region."""
    number = lambda c: F.round(c, 4).cast("string")
    corner = F.transform("points", lambda p: F.concat_ws(" ", number(p["x"]), number(p["y"])))
    one = loops.select("image_id", "region_id", "loop_id", F.concat(F.lit("M"), F.array_join(corner, "L"), F.lit("Z")).alias("path"))
    return one.groupBy("image_id", "region_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("loop_id", "path"))), lambda s: s["path"]), "").alias("path"))
