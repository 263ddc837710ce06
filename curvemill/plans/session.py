"""A session over a log directory or any table of points: lists, charts and the text screen of one page.

The thinned points are kept once they are read (in memory and on disks), so lists and charts do not read the logs again; ``close`` lets them go.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill.functions import text, ticks
from curvemill.operators import catalog, chart, layout, raster, series, summary, thin, tree
from curvemill.schema import Chart, Options
from curvemill.sources import datasource
from curvemill.streaming.table import LiveTable

NO_DATA, NO_DRAWABLE, NO_SCALARS, NO_MATCH = "no data in enabled runs", "no drawable points", "no scalars found", "no tags match filter"


class Session:
    """Lazy queries over points; nothing is computed before a result is asked for."""

    def __init__(self, points: DataFrame, options: Options, files: DataFrame | None = None) -> None:
        self.options = options
        self.all_points = points
        self.points = (thin.thin(points, options.max_points) if options.max_points else points).persist(StorageLevel.MEMORY_AND_DISK)
        self.files = files if files is not None else points.select("run", F.split("path", "/").alias("path_parts")).distinct()
        self.table = catalog.cap_runs(self.files, options.max_runs)

    @classmethod
    def open(cls, spark: SparkSession, options: Options) -> Session:
        return cls(datasource.read(spark, options.logdir), options, datasource.read(spark, options.logdir, "listing"))

    def close(self) -> None:
        self.points.unpersist()

    def runs(self, part: str = "") -> DataFrame:
        return catalog.filter_runs(catalog.style(catalog.colours(self.files).select("run", "color_slot")).join(self.table, "run"), part).orderBy("run")

    def tags(self, part: str = "") -> DataFrame:
        return catalog.tags(self.points, self.table, part)

    def tag_rows(self, state: Mapping[str, bool] | None = None, part: str = "") -> DataFrame:
        return tree.visible_rows(self.tags(part), state, force_open=bool(part))

    def toggle(self, run: str) -> None:
        self.table = catalog.toggle(self.table, run)

    def solo(self, run: str) -> None:
        self.table = catalog.solo(self.table, run)

    def toggle_all(self, part: str = "") -> None:
        self.table = catalog.toggle_all(self.table, part)

    def header(self, part: str = "") -> DataFrame:
        return catalog.header(self.all_points, self.table, self.options.max_points, part)

    def first_walls(self) -> DataFrame:
        return series.first_walls(self.points)

    def _axis(self, what: Chart) -> DataFrame:
        own = catalog.enabled_points(self.points, self.table).where(F.col("tag") == what.tag)
        return series.with_x(own, what.x_mode, self.first_walls())

    def ranges(self, what: Chart) -> DataFrame:
        return series.view_range(series.domain(self._axis(what)), what.view)

    def curves(self, what: Chart) -> DataFrame:
        return chart.curves(catalog.enabled_points(self.points, self.table), what, self.first_walls())

    def drawn_runs(self, tag: str) -> DataFrame:
        return catalog.enabled_points(self.points, self.table).where(F.col("tag") == tag).select("run").distinct()

    def legend(self, what: Chart) -> DataFrame:
        """(run, label): the first drawn runs, with their values at the cursor where there is one."""
        shown = layout.legend(self.drawn_runs(what.tag))
        if what.view.cursor is None:
            return shown.withColumn("label", F.col("run"))
        at = F.broadcast(series.cursor_x(self.ranges(what), what.view.cursor, what.px_w).select("cursor_x"))
        last = series.as_of(self._axis(what).crossJoin(at), F.col("cursor_x"))
        label = F.concat_ws("", F.col("run"), F.lit("  "), text.number(F.col("value")), F.lit(" @ "), text.count(F.greatest("step", F.lit(0))))
        return shown.join(last.select("run", label.alias("at")), "run", "left").select("run", F.coalesce("at", "run").alias("label")).orderBy("run")

    def plot(self, what: Chart, width: int, height: int) -> list[str]:
        """The lines of one chart: title, plot with y labels, x labels. A message where there is nothing to draw."""
        plot_w, plot_h, px_w, px_h = layout.plot_size(width, height)
        if not plot_w or not plot_h:
            return []
        what = replace(what, px_w=px_w, px_h=px_h)
        drawn = self.curves(what).cache()
        try:
            if drawn.isEmpty():
                return [what.tag, NO_DRAWABLE if what.log_y else NO_DATA]
            lines = chart.segments(chart.pixels(drawn, px_h))
            dots = raster.dashed(raster.dots(lines), catalog.colours(self.files))
            rows = {r["row"]: r["line"] for r in raster.text_rows(raster.cells(dots, px_w, px_h), plot_w, plot_h).collect()}
            left = {r["row"]: r["label"] for r in ticks.y_ticks(chart.y_range(drawn), plot_h, what.log_y).collect()}
            axis = [" "] * (plot_w + 1)
            for r in ticks.x_labels(self.ranges(what), plot_w, what.x_mode).collect():
                axis[r["at"] : r["at"] + len(r["label"])] = list(r["label"])
        finally:
            drawn.unpersist()
        body = [f"{left.get(i, ''):>{layout.GUTTER}}{'┼' if i in left else '│'}{rows[i]}" for i in range(plot_h)]
        return [what.tag, *body, " " * layout.GUTTER + "└" + "".join(axis[:plot_w])]

    def screen(self, width: int, height: int, selected: int = 0, x_mode: str | None = None, part: str = "") -> list[str]:
        """The header and a grid of charts from the selected tag's page, as text lines."""
        if not layout.fits(width, height):
            return ["terminal too small"]
        h = self.header(part).first()
        stride = f" ÷{h['max_stride']}" if h["max_stride"] > 1 else ""
        head = f"runs {h['runs_on']}/{h['runs_total']}  tags {h['n_tags']}  points {h['total_points']}{stride}"
        if not h["n_tags"]:
            return [head, NO_MATCH if part else NO_SCALARS]
        columns, rows, n = layout.grid_shape(width, height - 1, h["n_tags"])
        shown = [r["tag"] for r in layout.grid_page(self.tags(part), selected, n).orderBy("slot").collect()]
        out = [head]
        spans = layout.slot_spans(width, columns)
        for k, (_, tall) in enumerate(layout.slot_spans(height - 1, rows)):
            row = shown[k * columns : (k + 1) * columns]
            plots = [self.plot(Chart(t, x_mode or self.options.x_mode, self.options.smoothing), w, tall) for t, (_, w) in zip(row, spans)]
            for i in range(tall):
                out.append("".join(f"{p[i] if i < len(p) else '':<{w}}" for p, (_, w) in zip(plots, spans)).rstrip())
        return out


class LiveSession(Session):
    """A session over a live table as it is now: lists, headers and ranges from the series' summaries, charts from the row groups of their tag and range."""

    def __init__(self, live: LiveTable, options: Options, files: DataFrame) -> None:
        known = live.manifest()
        self.options, self.files = options, files
        self.points = self.all_points = live.points(known)
        self.summaries = live.series(known)
        self.table = catalog.cap_runs(files, options.max_runs)

    def close(self) -> None:
        """Nothing is held."""

    def _enabled(self, tag: str) -> DataFrame:
        return catalog.enabled_points(self.summaries, self.table).where(F.col("tag") == tag)

    def tags(self, part: str = "") -> DataFrame:
        return summary.tags(self.summaries, self.table, part)

    def header(self, part: str = "") -> DataFrame:
        return summary.header(self.summaries, self.table, part).drop("stored_points")

    def first_walls(self) -> DataFrame:
        return summary.first_walls(self.summaries)

    def ranges(self, what: Chart) -> DataFrame:
        return series.view_range(summary.domain(self._enabled(what.tag), what.x_mode, self.first_walls()), what.view)

    def curves(self, what: Chart) -> DataFrame:
        shown = self.ranges(what).first()  # one row, from summaries
        own = catalog.enabled_points(self.points, self.table)
        return chart.curves(own, what, self.first_walls(), None if shown["lo"] is None else (shown["lo"], shown["hi"]))

    def drawn_runs(self, tag: str) -> DataFrame:
        return self._enabled(tag).select("run").distinct()
