"""The whole screen as text: header, side bar, charts with legend and cursor, footer and help, in colour where the terminal has it.

Spark computes what is shown, never more rows than the screen has cells; here they are put in their places.
"""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import functions as F

from curvemill.functions import text, ticks
from curvemill.functions.terminal import hue_colour
from curvemill.operators import catalog, chart, layout, raster, series, tree
from curvemill.plans.console import HELP, RUNS, TAGS, Console
from curvemill.plans.session import NO_DATA, NO_DRAWABLE, NO_MATCH, NO_SCALARS, Session

LOADING, TOO_SMALL = "loading", "terminal too small"
PLAIN, BOLD, DIM, REVERSED = "", "\x1b[1m", "\x1b[2m", "\x1b[7m"


class Grid:
    """Cells of characters with styles; what goes beyond the edges is cut off."""

    def __init__(self, width: int, height: int) -> None:
        self.width, self.height = width, height
        self.cells = [[(" ", PLAIN)] * width for _ in range(height)]

    def put(self, x: int, y: int, what: str, style: str = PLAIN) -> None:
        if 0 <= y < self.height:
            for k, c in enumerate(what):
                if 0 <= x + k < self.width:
                    self.cells[y][x + k] = (c, style)

    def lines(self, coloured: bool) -> list[str]:
        if not coloured:
            return ["".join(c for c, _ in row).rstrip() for row in self.cells]
        out = []
        for row in self.cells:
            line, now = "", PLAIN
            for c, style in row:
                line += ("\x1b[0m" + style if style != now else "") + c
                now = style
            out.append(line + ("\x1b[0m" if now else ""))
        return out


class Screen:
    """Draws a session as a console has it. ``depth`` is what the terminal shows of colours, None for none."""

    def __init__(self, session: Session, console: Console, width: int, height: int, depth: str | None = None, busy: bool = False) -> None:
        self.session, self.console, self.grid, self.depth, self.busy = session, console, Grid(width, height), depth, busy
        self.runs = [r["run"] for r in catalog.runs(session.files).collect()]
        self.now = time.time()
        self.console = console = console.admit(self.runs, self.now)
        spark = session.points.sparkSession
        session.table = spark.createDataFrame([(r, r not in console.hidden) for r in self.runs], "run string, enabled boolean")
        self.tags = session.tags(console.tag_part)
        self.rows: list = []
        self.styles: dict = {}

    def _hue(self, hue: int) -> str:
        return hue_colour(hue, self.depth) if self.depth else PLAIN

    def draw(self) -> list[str]:
        g, c = self.grid, self.console
        if not layout.fits(g.width, g.height):
            g.put(0, 0, TOO_SMALL)
            return g.lines(bool(self.depth))
        self.rows = tree.visible_rows(self.tags, c.opened, force_open=bool(c.tag_part)).collect()  # the rows of the tree that are open
        head = self.session.header(c.tag_part).first()
        self._header(head)
        self._footer()
        left = 0
        if c.sidebar:
            left = layout.sidebar_width(self.session.files.select("run").distinct(), tree.visible_rows(self.tags, c.opened, bool(c.tag_part)), g.width).first()["width"]
            self._sidebar(left, head["n_tags"])
        self._charts(left, head["n_tags"])
        if c.help:
            for i, (keys, what) in enumerate(HELP):
                g.put(4, 2 + i, f" {keys:<18}{what:<46} ", REVERSED if self.depth else PLAIN)
        return g.lines(bool(self.depth))

    def _header(self, head) -> None:
        c, g = self.console, self.grid
        points = text.labels([head["total_points"]])[0]
        stride = f" ÷{head['max_stride']}" if head["max_stride"] > 1 else ""
        state = ("live ●" if self.busy else "live ○") if c.follow else "paused"
        right = f" runs {head['runs_on']}/{head['runs_total']} │ tags {head['n_tags']} │ points {points}{stride} │ {state} │ x {c.x_mode} │ y {'log' if c.log_y else 'linear'} │ smooth {c.smoothing:.2f} "
        name = f" curvemill  {self.session.options.logdir} "
        g.put(0, 0, name + " " * max(1, g.width - len(name) - len(right)) + right, REVERSED)

    def _footer(self) -> None:
        c, g = self.console, self.grid
        if c.editing:
            line = f" filter {c.editing}: {c.run_part if c.editing == RUNS else c.tag_part}▏  (Enter keeps it, Esc takes it back)"
        elif self.now < c.message_until:
            line = f" {c.message}"
        else:
            line = "  Tab focus  Space on/off  Enter only/open  a all  / filter  s S smooth  + - [ ] zoom, pan  g grid  L log  x axis  f follow  ? help  q quit"
        g.put(0, g.height - 1, line, DIM)

    def _styles(self, names: list[str]) -> dict:
        """Colour and marker of some runs, no more than a screen shows."""
        unknown = [n for n in names if n not in self.styles]
        if unknown:
            self.styles |= {r["run"]: r for r in catalog.colours(self.session.files).where(F.col("run").isin(unknown)).collect()}
        return self.styles

    def _sidebar(self, width: int, n_tags: int) -> None:
        g = self.grid
        body = g.height - 2
        listed = self.console.listed(self.runs)
        tall = max(2, min(len(listed) + 1, body // 3))
        self.console = c = replace(self.console, run_at=max(0, min(self.console.run_at, len(listed) - 1)), tag_at=self.console.selected(self.rows)).scrolled(tall - 1, body - tall - 1)
        shown = f"{len(listed)}/{len(self.runs)}" if c.run_part else f"{len(listed)}"
        g.put(0, 1, f" RUNS ({shown})" + (f"  /{c.run_part}" if c.run_part or c.editing == RUNS else ""), BOLD)
        shown_runs = listed[c.run_scroll : c.run_scroll + tall - 1]
        styles = self._styles(shown_runs)
        for i, run in enumerate(shown_runs):
            on, mine = run not in c.hidden, c.focus == RUNS and c.run_scroll + i == c.run_at
            style = REVERSED if mine else PLAIN if on else DIM
            g.put(0, 2 + i, f" {'▣' if on else '☐'}   {run}"[: width - 1].ljust(width - 2), style)
            if run in styles:
                g.put(3, 2 + i, styles[run]["marker"], self._hue(styles[run]["hue"]))
        top = 1 + tall
        g.put(0, top, f" TAGS ({n_tags})" + (f"  /{c.tag_part}" if c.tag_part or c.editing == TAGS else ""), BOLD)
        for i, row in enumerate(self.rows[c.tag_scroll : c.tag_scroll + body - tall - 1]):
            mine = c.tag_scroll + i == c.tag_at
            lead = f" {'▶' if mine else ' '}{'  ' * row['depth']}{'  ' if row['leaf'] else '▾ ' if row['expanded'] else '▸ '}"
            more = "" if row["leaf"] else f" ({row['leaves']})"
            room = max(0, width - 2 - len(lead) - len(more))
            label = row["label"] if len(row["label"]) <= room else text.shortened(row["label"], room)
            g.put(0, top + 1 + i, (lead + label + more).ljust(width - 2), REVERSED if mine and c.focus == TAGS else PLAIN)
        for y in range(1, g.height - 1):
            g.put(width - 1, y, "│", DIM)

    def _message(self, left: int, what: str) -> None:
        g = self.grid
        g.put(left + max(0, (g.width - left - len(what)) // 2), 1 + (g.height - 2) // 2, what, DIM)

    def _charts(self, left: int, n_tags: int) -> None:
        c, g = self.console, self.grid
        if not n_tags:
            self._message(left, LOADING if self.busy else NO_MATCH if c.tag_part else NO_SCALARS)
            return
        row = self.rows[c.selected(self.rows)]
        tag = row["tag"] or tree.first_leaves(self.tags).where(F.col("path") == row["path"]).first()["first_tag"]
        if not c.grid:
            self._chart(c, tag, left, 1, g.width - left, g.height - 2, detailed=True)
            return
        columns, rows, n = layout.grid_shape(g.width - left, g.height - 2, n_tags)
        place = self.tags.where(F.col("tag") < tag).count()
        page = [r["tag"] for r in layout.grid_page(self.tags, place, n).orderBy("slot").collect()]
        spots = [(x, y, w, h) for y, h in layout.slot_spans(g.height - 2, rows) for x, w in layout.slot_spans(g.width - left, columns)]
        for name, (x, y, w, h) in zip(page, spots):
            self._chart(c, name, left + x, 1 + y, w, h, detailed=False, chosen=name == tag)

    def _chart(self, c: Console, tag: str, x: int, y: int, width: int, height: int, detailed: bool, chosen: bool = False) -> None:
        s, g = self.session, self.grid
        plot_w, plot_h, px_w, px_h = layout.plot_size(width, height)
        if not plot_w or not plot_h:
            return
        what = replace(c.chart(tag), px_w=px_w, px_h=px_h)
        g.put(x, y, tag[:width], REVERSED if chosen else BOLD)
        drawn = s.curves(what).cache()
        try:
            if drawn.isEmpty():
                g.put(x + layout.GUTTER + 2, y + height // 2, NO_DRAWABLE if what.log_y else NO_DATA, DIM)
                return
            dots = raster.dashed(raster.dots(chart.segments(chart.pixels(drawn, px_h))), catalog.colours(s.files))
            at = x + layout.GUTTER + 1
            for i in range(plot_h):
                g.put(at - 1, y + 1 + i, "│", DIM)
            for r in raster.cells(dots, px_w, px_h).collect():
                g.put(at + r["cell"], y + 1 + r["row"], r["char"], self._hue(r["color_slot"] % catalog.HUES))
            for r in ticks.y_ticks(chart.y_range(drawn), plot_h, what.log_y).collect():
                g.put(x, y + 1 + r["row"], f"{r['label']:>{layout.GUTTER}}┼", DIM)
            g.put(at - 1, y + 1 + plot_h, "└" + "─" * plot_w, DIM)
            for r in ticks.x_labels(s.ranges(what), plot_w, what.x_mode).collect():
                g.put(at + r["at"], y + 1 + plot_h, r["label"], DIM)
            if detailed:
                self._cursor_and_legend(what, at, y, plot_w, plot_h)
        finally:
            drawn.unpersist()

    def _cursor_and_legend(self, what, at: int, y: int, plot_w: int, plot_h: int) -> None:
        g = self.grid
        if what.view.cursor is not None:
            cell = round(what.view.cursor * (what.px_w - 1)) // 2
            for i in range(plot_h):
                if g.cells[y + 1 + i][at + cell][0] == " ":
                    g.put(at + cell, y + 1 + i, "│", DIM)
            x = series.cursor_x(self.session.ranges(what), what.view.cursor, what.px_w).select(text.x_value(F.col("cursor_x"), what.x_mode).alias("label")).first()["label"]
            g.put(at + plot_w - len(x) - 4, y, f"at {x}", DIM)
        legend = self.session.legend(what).collect()
        styles = self._styles([r["run"] for r in legend])
        for i, r in enumerate(legend):
            start = max(at, at + plot_w - len(r["label"]) - 3)
            style = styles.get(r["run"])
            if style:
                g.put(start, y + 1 + i, style["marker"], self._hue(style["hue"]))
            g.put(start + 2, y + 1 + i, r["label"])
