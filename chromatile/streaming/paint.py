"""Paint logs as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def undo_redo(log: DataFrame, key: str = "project_id", order: str = "seq", kind: str = "tool", most: int = 50) -> DataFrame:
    """The stacks of every project after each micro-batch that touches it: key, done, redo.

    The same fold as for tables, on a stream of actions. A project's state is two stacks of at most
    ``most`` actions. Actions of a micro-batch are taken by their order; one that comes after later
    ones were folded counts as new, as a log gives its numbers in order.
    """

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, redo = (list(s) for s in state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values(order)
        for seq, what in rows[[order, kind]].itertuples(index=False):
            if what == "undo":
                redo += [done.pop()] if done else []
            elif what == "redo":
                done += [redo.pop()] if redo else []
            else:
                done, redo = [*done, int(seq)][-most:], []
        state.update((done, redo))
        yield pd.DataFrame({key: [name[0]], "done": [done], "redo": [redo]})

    stacks = "done array<long>, redo array<long>"
    own = f"`{key}` {log.schema[key].dataType.simpleString()}, {stacks}"
    return log.select(key, order, kind).groupBy(key).applyInPandasWithState(fold, own, stacks, "update", GroupStateTimeout.NoTimeout)


def strokes(events: DataFrame, key: str = "session_id", order: str = "seq", at: str = "ts", patience_ms: int = 30_000, near: float = 0.01) -> DataFrame:
    """Committed strokes of a stream of pointer events: key, stroke (from 0, by session), began, points (x, y, pressure).

    events: key, order, at (with a watermark), kind, x, y, pressure. ``begin`` opens a stroke (an open one is lost), ``extend``
    adds a point unless it is as near as ``near`` in both axes to the last one, ``commit`` gives the stroke out, ``abort`` drops it;
    what is not inside a stroke has no effect. A stroke that has not ended when the watermark passes its last event
    by ``patience_ms`` is dropped, and its state with it. Events of a micro-batch are taken by their order; a session's state
    is its open stroke and the number of its strokes. This goes beyond the batch form, ``operators.paint.strokes``.
    """

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, began, xs, ys, ps = state.get if state.exists else (0, None, [], [], [])
        xs, ys, ps, out = list(xs), list(ys), list(ps), []
        rows = pd.concat(list(batches)).sort_values(order)
        for seq, kind, x, y, pressure in rows[[order, "kind", "x", "y", "pressure"]].itertuples(index=False):
            if kind == "begin":
                began, xs, ys, ps = int(seq), [x], [y], [pressure]
            elif began is None:
                continue
            elif kind == "extend" and (abs(xs[-1] - x) >= near or abs(ys[-1] - y) >= near):
                xs.append(x)
                ys.append(y)
                ps.append(pressure)
            elif kind in ("commit", "abort"):
                if kind == "commit":
                    out.append((name[0], n, began, [{"x": a, "y": b, "pressure": c} for a, b, c in zip(xs, ys, ps, strict=True)]))
                    n += 1
                began, xs, ys, ps = None, [], [], []
        state.update((n, began, xs, ys, ps))
        if began is not None:
            last = int(rows[at].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last + patience_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "stroke", "began", "points"])

    held = "n long, began long, xs array<double>, ys array<double>, ps array<double>"
    own = f"`{key}` {events.schema[key].dataType.simpleString()}, stroke long, began long, points array<struct<x: double, y: double, pressure: double>>"
    numbers = [F.col(c).cast("double").alias(c) for c in ("x", "y", "pressure")]
    return events.select(key, order, at, "kind", *numbers).groupBy(key).applyInPandasWithState(fold, own, held, "append", GroupStateTimeout.EventTimeTimeout)
