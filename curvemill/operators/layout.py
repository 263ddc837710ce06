"""Screen arithmetic: grids of charts, side bar, scrolling and the view. Plain functions of a few numbers, and table forms where data decides."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.schema import X_MODES, View

#: Sizes in cells.
GUTTER, MIN_WIDTH, MIN_HEIGHT = 9, 40, 8
CELL_W, CELL_H, SIDE = 40, 9, 3
NARROW, WIDE, MARK = 24, 46, 6
LEGEND = 8
ZOOM, PAN, CURSOR, SMOOTH, LEAST_SPAN = 0.7, 0.15, 0.02, 0.05, 1e-4


def _clamp(v, lo, hi):
    return max(lo, min(v, hi))


def plot_size(width: int, height: int) -> tuple[int, int, int, int]:
    """(plot_w, plot_h, px_w, px_h) of a chart area: gutter, axis, title and labels taken off; 2 by 4 dots a cell."""
    w, h = max(0, width - GUTTER - 2), max(0, height - 2)
    return w, h, 2 * w, 4 * h


def fits(width: int, height: int) -> bool:
    """Whether anything but a message can be drawn."""
    return width >= MIN_WIDTH and height >= MIN_HEIGHT


def grid_shape(width: int, height: int, available: int) -> tuple[int, int, int]:
    """(columns, rows, charts): of the layouts that hold the charts the one with fewest empty cells, and of equals the widest."""
    columns, rows = _clamp(width // CELL_W, 1, SIDE), _clamp(height // CELL_H, 1, SIDE)
    n = _clamp(available, 1, columns * rows)
    shapes = [(c * -(-n // c) - n, -c) for c in range(1, columns + 1) if -(-n // c) <= rows]
    wide = -min(shapes)[1]
    return wide, -(-n // wide), n


def slot_spans(total: int, parts: int) -> list[tuple[int, int]]:
    """(start, size) of parts that share a length; the leading ones take what is left over."""
    size, more = divmod(total, parts)
    return [(i * size + min(i, more), size + (i < more)) for i in range(parts)]


def grid_page(tags: DataFrame, selected: int, n: int) -> DataFrame:
    """(tag, slot): the page of n tags, by name, that holds the selected one (counted from 0)."""
    first = selected // n * n
    return tags.orderBy("tag").offset(first).limit(n).withColumn("slot", F.monotonically_increasing_id())


def scroll_for(scroll: int, selected: int, visible: int) -> int:
    """The first row to show so that the selected one is in sight, moving as little as possible."""
    if visible <= 0:
        return 0
    return min(max(scroll, selected - visible + 1), selected)


def sidebar_width(runs: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """(width), one row: as wide as the longest name shown needs, within bounds and two fifths of the screen."""
    name = runs.agg(F.coalesce(F.max(F.char_length("run")), F.lit(0)).alias("n")).select((F.col("n") + MARK).alias("w"))
    row = 4 + 2 * F.col("depth") + F.char_length("label") + F.when(F.col("leaf"), 0).otherwise(5)
    tag = rows.agg(F.coalesce(F.max(row), F.lit(0)).alias("w"))
    ceiling = _clamp(total * 2 // 5, NARROW, WIDE)
    widest = name.unionByName(tag).agg(F.max("w").alias("w"))
    return widest.select(F.greatest(F.lit(NARROW), F.least("w", F.lit(ceiling))).cast("int").alias("width"))


def legend(as_of_rows: DataFrame) -> DataFrame:
    """The first drawn runs, by name, as many as a legend shows."""
    return as_of_rows.orderBy("run").limit(LEGEND)


def zoom(view: View, inward: bool) -> View:
    """A smaller or larger part of the domain around the cursor, or else its middle."""
    span = _clamp((view.hi - view.lo) * (ZOOM if inward else 1 / ZOOM), LEAST_SPAN, 1.0)
    at = 0.5 if view.cursor is None else view.cursor
    lo = _clamp(view.lo + (view.hi - view.lo) * at - span * at, 0.0, 1.0 - span)
    return replace(view, lo=lo, hi=lo + span)


def pan(view: View, right: bool) -> View:
    span = view.hi - view.lo
    lo = _clamp(view.lo + (PAN if right else -PAN) * span, 0.0, 1.0 - span)
    return replace(view, lo=lo, hi=lo + span)


def move_cursor(view: View, right: bool) -> View:
    """The cursor one step on; it appears in the middle."""
    at = 0.5 if view.cursor is None else _clamp(view.cursor + (CURSOR if right else -CURSOR), 0.0, 1.0)
    return replace(view, cursor=at)


def smoother(weight: float, more: bool) -> float:
    return _clamp(round(weight + (SMOOTH if more else -SMOOTH), 2), 0.0, 0.99)


def next_axis(mode: str) -> tuple[str, View]:
    """The next x axis; the view starts anew."""
    return X_MODES[(X_MODES.index(mode) + 1) % len(X_MODES)], View()
