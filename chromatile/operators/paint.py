"""The log of paint actions: geometry, undo and redo, replay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import half_up, to_canvas

POINTS = "array<struct<x: double, y: double, pressure: double>>"


def dedupe_points(points: Column, near: float = 0.01) -> Column:
    """Points (x, y, pressure) of a stroke without those as near as ``near`` in both axes to the last one kept.

    What is kept depends on what was kept before only where neighbours are near each other: strokes
    without such neighbours stay as they are, the others are passed through point by point, on flat arrays.
    """

    def run(strokes: pa.Array) -> pa.Array:
        sizes = strokes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends = strokes.flatten(), np.cumsum(sizes)
        at = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], axis=1) if len(flat) else np.zeros((0, 2))
        stroke = np.repeat(np.arange(len(sizes)), sizes)
        beside = (np.abs(np.diff(at, axis=0)) < near).all(axis=1) & (stroke[1:] == stroke[:-1]) if len(at) else np.zeros(0, bool)
        stays = np.ones(len(at), bool)
        for k in np.unique(stroke[1:][beside]).tolist():
            first, xy = ends[k] - sizes[k], at[ends[k] - sizes[k] : ends[k]].tolist()
            x, y = xy[0]
            for i, (u, v) in enumerate(xy[1:], 1):
                if abs(x - u) < near and abs(y - v) < near:
                    stays[first + i] = False
                else:
                    x, y = u, v
        offsets = pa.array(np.r_[0, np.r_[0, np.cumsum(stays)][ends]].astype(np.int32), mask=np.r_[strokes.is_null().to_numpy(zero_copy_only=False), False])
        return pa.ListArray.from_arrays(offsets, flat.filter(pa.array(stays)))

    return F.arrow_udf(run, POINTS)(points.cast(POINTS))


def pointer_points(events: DataFrame, scale: str = "scale", tx: str = "tx", ty: str = "ty") -> DataFrame:
    """events(stroke_id, seq, x, y, pressure, coalesced, ...) as points in canvas places, in order: seq, part.

    Where an event has coalesced samples (array of x, y, pressure), they stand for it; else it is one
    point itself. A pressure that is not above 0 is 0.5.
    """
    own = F.array(F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "pressure")]))
    several = F.col("coalesced").cast(POINTS)
    samples = F.when(F.coalesce(F.size(several), F.lit(0)) > 0, several).otherwise(own)
    flat = events.select("stroke_id", "seq", F.posexplode(samples).alias("part", "_p"), scale, tx, ty)
    x, y = to_canvas(F.col("_p.x"), F.col("_p.y"), F.col(scale), F.col(tx), F.col(ty))
    return flat.select("stroke_id", "seq", "part", x.alias("x"), y.alias("y"), pressure_or_half(F.col("_p.pressure")).alias("pressure"))


def strokes(points: DataFrame, ends: DataFrame) -> DataFrame:
    """(stroke_id, points) of finished strokes: those that ``ends`` (stroke_id, kind) commits and does not abort.

    points: stroke_id, seq, part, x, y, pressure; near repeats are left out. A stroke is one gesture.
    """
    ended = ends.groupBy("stroke_id").agg(F.bool_or(F.col("kind") == "commit").alias("_done"), F.bool_or(F.col("kind") == "abort").alias("_gone")).filter("_done AND NOT _gone").select("stroke_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "part", "x", "y", "pressure"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["pressure"].alias("pressure")))
    return points.join(ended, "stroke_id", "left_semi").groupBy("stroke_id").agg(ordered.alias("points")).select("stroke_id", dedupe_points(F.col("points")).alias("points"))


def finish(log: DataFrame, key: str = "project_id", order: str = "seq", kind: str = "tool") -> DataFrame:
    """``log`` with a ``fill-all`` after the last action of every project; other columns of it are null."""
    last = log.groupBy(key).agg((F.max(order) + 1).alias(order)).withColumn(kind, F.lit("fill-all"))
    return log.unionByName(last, allowMissingColumns=True)


def pressure_or_half(pressure: Column) -> Column:
    """The pressure where it is above 0, else 0.5."""
    return F.when(pressure > 0, pressure).otherwise(0.5)


def segments(points: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Quadratic pieces of a stroke: from the middle of the last two points to the middle of the next two.

    Where points have a ``pressure``, pieces have that of the point between the middles (via_pressure)
    and of their ends.
    """
    axes = [c for c in ("x", "y", "pressure") if c in points.columns]
    w = Window.partitionBy(*keys).orderBy(order)
    back = points.withColumns({f"{c}{k}": F.lag(c, k).over(w) for c in axes for k in (1, 2)})
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    start = {c: F.coalesce(middle(f"{c}2", f"{c}1"), F.col(f"{c}1")) for c in axes}
    ends = [e for c in axes for e in (start[c].alias(f"from_{c}"), F.col(f"{c}1").alias(f"via_{c}"), middle(f"{c}1", c).alias(f"to_{c}"))]
    return back.filter("x1 IS NOT NULL").select(*keys, order, *ends)


def last_actions(log: DataFrame, key: str = "project_id", order: str = "seq", most: int = 50) -> DataFrame:
    """The last ``most`` actions of every project; older ones are gone."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return log.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).drop("_rank")


def undo_redo(log: DataFrame, key: str = "project_id", order: str = "seq", kind: str = "tool", most: int = 50) -> DataFrame:
    """(key, done, redo) after folding a log in which ``undo`` and ``redo`` move the last action.

    A new action clears what could be redone and drops the oldest beyond ``most``. The log is sorted by
    project and order, and the fold streams over it: it holds two stacks of at most ``most`` actions,
    whatever the length of a project's log.
    """
    rows = log.select(F.col(key), F.col(order).cast("long").alias("_seq"), F.col(kind).alias("_kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, stacks = [], []  # finished projects of a batch; the last one is still open
        done: list[int] = []
        redo: list[int] = []
        at, begun = None, False

        def out() -> pa.RecordBatch:
            arrays = [pa.array(names, type_), *(pa.array([s[k] for s in stacks], pa.list_(pa.int64())) for k in (0, 1))]
            return pa.RecordBatch.from_arrays(arrays, [key, "done", "redo"])

        type_ = None
        for batch in batches:
            type_ = batch.column(0).type
            for name, seq, what in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or name != at:
                    if begun:
                        names.append(at)
                        stacks.append((done, redo))
                    at, begun, done, redo = name, True, [], []
                if what == "undo":
                    redo += [done.pop()] if done else []
                elif what == "redo":
                    done += [redo.pop()] if redo else []
                else:
                    done, redo = [*done, seq][-most:], []
            yield out()
            names, stacks = [], []
        if begun:
            names, stacks = [at], [(done, redo)]
            yield out()

    return rows.repartition(key).sortWithinPartitions(key, "_seq").mapInArrow(run, f"`{key}` {log.schema[key].dataType.simpleString()}, done array<long>, redo array<long>")


def replay(marks: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Colour of each painted pixel at full opacity: marks(keys, seq, tool, color).

    The last brush or eraser decides; a ``fill-all`` only colours what is transparent at its time.
    """
    last = marks.filter("tool != 'fill-all'").groupBy(*keys).agg(F.max(F.col(order)).alias("at"), F.max_by(F.when(F.col("tool") == "brush", F.col("color")), order).alias("top"))
    bare = F.col("at").isNull() | (F.col("top").isNull() & (F.col(order) > F.col("at")))
    clear = marks.join(last, keys, "left").filter((F.col("tool") == "fill-all") & bare)
    filled = clear.groupBy(*keys).agg(F.min_by("color", order).alias("under"))
    return marks.select(*keys).distinct().join(last, keys, "left").join(filled, keys, "left").select(*keys, F.coalesce("top", "under").alias("color"))


#: How many marks of one pixel, and how many maps, are folded in one row at most.
FOLD = 256


def _as_map(tool: Column, color: list[Column], opacity: Column) -> Column:
    """What a mark does to a premultiplied pixel: alpha becomes keep_a * alpha + add_a, a channel keep * channel + of_a * alpha + add.

    A brush lies over (source-over), an eraser takes away (destination-out), a ``fill-all`` goes under (destination-over).
    """
    eraser, under = tool == "eraser", tool == "fill-all"
    by = lambda over, out, below: F.when(eraser, out).when(under, below).otherwise(over)
    zero, one = F.lit(0.0), F.lit(1.0)
    parts = [by(1 - opacity, 1 - opacity, 1 - opacity).alias("keep_a"), by(opacity, zero, opacity).alias("add_a"), by(1 - opacity, 1 - opacity, one).alias("keep")]
    for c, value in zip("rgb", color, strict=True):
        parts += [by(zero, zero, -opacity * value).alias(f"of_a_{c}"), by(opacity * value, zero, opacity * value).alias(f"add_{c}")]
    return F.struct(*parts)


def _then(first: Column, second: Column) -> Column:
    """The map that does ``first`` and then ``second``. This is associative."""
    one, two = (lambda c: first[c]), (lambda c: second[c])
    parts = [(two("keep_a") * one("keep_a")).alias("keep_a"), (two("keep_a") * one("add_a") + two("add_a")).alias("add_a"), (two("keep") * one("keep")).alias("keep")]
    for c in "rgb":
        parts += [(two("keep") * one(f"of_a_{c}") + two(f"of_a_{c}") * one("keep_a")).alias(f"of_a_{c}"), (two("keep") * one(f"add_{c}") + two(f"of_a_{c}") * one("add_a") + two(f"add_{c}")).alias(f"add_{c}")]
    return F.struct(*parts)


def composite(marks: DataFrame, keys: list[str], fold: int = FOLD) -> DataFrame:
    """Colour and opacity of each painted pixel: keys, r, g, b, a (0 to 255), after all its marks in order.

    marks: keys, seq, part (whole numbers from 0: the action and its piece), tool, r, g, b (0 to 255) and opacity (0 to 1).
    Each mark is an affine map of (colour, alpha). Maps are composed in bounded ordered pieces: ``fold`` parts of an action at
    once, then ``fold`` pieces, until one is left, so that a pixel under all strokes is no single row or task. How many rounds
    there are follows from the largest seq and part. A null opacity is 1, a null colour makes a brush mark leave no trace. What
    stays fully transparent is given with a = 0 and colour 0. Values are rounded once, at the end.
    """
    color = [F.col(c).cast("double") for c in "rgb"]
    known = marks.filter("tool = 'eraser' OR (r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL)")
    pixels = marks.select(*keys).distinct()
    maps = known.select(*keys, F.col("seq").cast("long").alias("_s"), F.col("part").cast("long").alias("_p"), _as_map(F.coalesce("tool", F.lit("brush")), color, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("opacity").cast("double"), F.lit(1.0))))).alias("_m"))
    top = maps.agg(F.max("_s"), F.max("_p")).first()

    def folded(df: DataFrame, group: list[Column], order: list[str]) -> DataFrame:
        run = F.array_sort(F.collect_list(F.struct(*order, "_m")))
        rest = F.slice(run, 2, F.greatest(F.size(run) - 1, F.lit(0)))
        whole = df.groupBy(*keys, *group).agg(F.struct(run[0]["_m"].alias("head"), rest.alias("rest")).alias("_r"))
        return whole.withColumn("_m", F.aggregate(F.col("_r.rest"), F.col("_r.head"), lambda a, b: _then(a, b["_m"]))).drop("_r")

    parts, actions = (top[1] or 0), (top[0] or 0)
    maps = folded(maps, [F.col("_s"), F.floor(F.col("_p") / fold).alias("_p")], ["_p"])
    parts //= fold
    while parts:
        maps = folded(maps, [F.col("_s"), F.floor(F.col("_p") / fold).alias("_p")], ["_p"])
        parts //= fold
    maps = maps.drop("_p")
    while actions:
        maps = folded(maps, [F.floor(F.col("_s") / fold).alias("_s")], ["_s"])
        actions //= fold
    alpha = F.col("_m.add_a")  # on a pixel that was transparent
    channel = lambda c: F.coalesce(F.when(alpha > 0, half_up(F.least(F.lit(255.0), F.col(f"_m.add_{c}") / alpha))), F.lit(0)).cast("int").alias(c)
    done = maps.select(*keys, *[channel(c) for c in "rgb"], half_up(255 * alpha).cast("int").alias("a"))
    return pixels.join(done, keys, "left").na.fill(0, ["r", "g", "b", "a"])
