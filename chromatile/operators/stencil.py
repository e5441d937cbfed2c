"""Stencils over pixels(image_id, x, y, ...) with a dense grid: windows along rows and columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def row_window() -> WindowSpec:
    return Window.partitionBy("image_id", "y").orderBy("x")


def column_window() -> WindowSpec:
    return Window.partitionBy("image_id", "x").orderBy("y")


def _box(df: DataFrame, columns: Sequence[str], radius: int, keys: tuple[str, str], along: str) -> DataFrame:
    """Means of 2 * radius + 1 pixels along a row or column; the pixel at the edge stands for those beyond."""
    whole = Window.partitionBy(*keys)
    line = whole.orderBy(along)
    near = line.rowsBetween(-radius, radius)
    all_ = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.max(along).over(all_)
    before, after = F.greatest(F.lit(0), radius - F.col(along)), F.greatest(F.lit(0), F.col(along) + radius - last)
    mean = lambda c: (F.sum(c).over(near) + before * F.first(c).over(all_) + after * F.last(c).over(all_)) / (2 * radius + 1)
    return df.withColumns({c: mean(c) for c in columns})


def box_mean(df: DataFrame, columns: Sequence[str], radius: int) -> DataFrame:
    """Box means, edges replicated; all columns in two exchanges."""
    return _box(_box(df, columns, radius, ("image_id", "y"), "x"), columns, radius, ("image_id", "x"), "y")


def guided_filter(df: DataFrame, columns: Sequence[str], radius: int = 3, eps: float = 80.0) -> DataFrame:
    """Edge-preserving smoothing of each column by itself."""
    means, squares = {c: f"_m_{c}" for c in columns}, {c: f"_s_{c}" for c in columns}
    work = df.withColumns({means[c]: F.col(c) for c in columns} | {squares[c]: F.col(c) * F.col(c) for c in columns})
    work = box_mean(work, [*means.values(), *squares.values()], radius)
    gain = {}
    for c in columns:
        var = F.greatest(F.lit(0.0), F.col(squares[c]) - F.col(means[c]) * F.col(means[c]))
        gain[c] = var / (var + eps)
    work = work.withColumns({squares[c]: gain[c] for c in columns} | {means[c]: F.col(means[c]) * (1 - gain[c]) for c in columns})
    work = box_mean(work, [*means.values(), *squares.values()], radius)
    out = work.withColumns({c: F.col(squares[c]) * F.col(c) + F.col(means[c]) for c in columns})
    return out.drop(*means.values(), *squares.values())


def neighbours4(df: DataFrame, column: str) -> DataFrame:
    """Adds _left, _right, _up, _down of a column; null beyond the edge."""
    c = F.col(column)
    return df.withColumns({"_left": F.lag(c).over(row_window()), "_right": F.lead(c).over(row_window())}).withColumns({"_up": F.lag(c).over(column_window()), "_down": F.lead(c).over(column_window())})


def gradient(df: DataFrame, column: str = "L", out: str = "grad") -> DataFrame:
    """Squared central differences; 0 on the border of the image."""
    d = lambda p, q: (F.col(p) - F.col(q)) * (F.col(p) - F.col(q))
    return neighbours4(df, column).withColumn(out, F.coalesce(d("_right", "_left") + d("_down", "_up"), F.lit(0.0))).drop("_left", "_right", "_up", "_down")


def majority(df: DataFrame, column: str = "label", passes: int = 2, votes: int = 6) -> DataFrame:
    """Inner pixels take the label that at least ``votes`` of their 8 neighbours have."""
    for _ in range(passes):
        c = F.col(column)
        rows = df.withColumns({"_w": F.lag(c).over(row_window()), "_e": F.lead(c).over(row_window())})
        trio = F.array("_w", c, "_e")
        rows = rows.withColumns({"_n": F.lag(trio).over(column_window()), "_s": F.lead(trio).over(column_window())})
        ring = [F.col("_n")[0], F.col("_n")[1], F.col("_n")[2], F.col("_w"), F.col("_e"), F.col("_s")[0], F.col("_s")[1], F.col("_s")[2]]
        inner = _all([v.isNotNull() for v in ring])
        # A label with 6 of 8 votes is among any 3 of the neighbours.
        chosen = F.coalesce(*[F.when(_votes(ring, ring[k]) >= votes, ring[k]) for k in range(8 - votes + 1)])
        df = rows.withColumn(column, F.when(inner, F.coalesce(chosen, c)).otherwise(c)).drop("_w", "_e", "_n", "_s")
    return df


def contour_mask(df: DataFrame, column: str = "label", out: str = "contour") -> DataFrame:
    """1 where a neighbour has another label; the edge of the image is no contour."""
    c = F.col(column)
    differs = [F.coalesce(F.col(n) != c, F.lit(False)) for n in ("_left", "_right", "_up", "_down")]
    return neighbours4(df, column).withColumn(out, _any(differs).cast("int")).drop("_left", "_right", "_up", "_down")


def border(df: DataFrame, column: str = "region_id", out: str = "border") -> DataFrame:
    """1 on the edge of the image and where a neighbour is of another region."""
    c = F.col(column)
    differs = [F.coalesce(F.col(n) != c, F.lit(True)) for n in ("_left", "_right", "_up", "_down")]
    return neighbours4(df, column).withColumn(out, _any(differs).cast("int")).drop("_left", "_right", "_up", "_down")


def dilate2(df: DataFrame, mask: str = "contour") -> DataFrame:
    """(image_id, x, y) covered by 2 x 2 squares on the pixels of a mask."""
    square = F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx in (0, 1) for dy in (0, 1)])).alias("_p")
    return df.filter(F.col(mask) == 1).select("image_id", square).select("image_id", "_p.x", "_p.y").distinct()


def forward_fill(df: DataFrame, column: str) -> DataFrame:
    """Missing values from the left; in column 0 from above; else 0."""
    down = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    first = df.withColumn("_first", F.when(F.col("x") == 0, F.coalesce(F.last(column, True).over(down), F.lit(0))))
    return first.withColumn(column, F.last(F.coalesce(F.col(column), F.col("_first")), True).over(right)).drop("_first")


def _votes(ring: list[Column], label: Column) -> Column:
    """How many of ``ring`` are ``label``: a sum inside generated code, which a filter of an array is not."""
    return sum((v == label).cast("int") for v in ring)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
