"""What a user has chosen on the screen, and what each key does to it: a value that changes by pressing keys, without a terminal or Spark.

Lists come from outside: ``runs`` are all run names in order, ``rows`` the shown rows of the tag tree (path, leaf, expanded, depth, tag).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from curvemill.operators import layout
from curvemill.schema import Chart, Options, View

RUNS, TAGS, CHART = FOCUS = ("runs", "tags", "chart")
#: Seconds that a message stays.
NOTICE = 2.5
#: Keys and what they do.
HELP = (
    ("Tab, Shift-Tab", "next or previous of runs, tags, chart"), ("arrows, h j k l", "move; open and close groups; move the cursor"), ("Home, End", "first or last row"),
    ("Space", "show or hide the run"), ("Enter", "only this run; open the group or the chart"), ("a", "show or hide all listed runs"), ("/", "filter runs or tags"), ("s, S", "less or more smoothing"),
    ("+, -, [, ], 0", "zoom, pan, whole range"), ("x", "step, relative time or wall time"), ("g, L, b", "grid, logarithmic y, side bar"), ("c, Esc", "take the cursor away"), ("f, r", "follow or pause, reload"), ("q", "quit"),
)


def key_name(char: str, ctrl: bool = False) -> str:
    """The name of a key; some terminals send Enter as a line feed, a carriage return, or Ctrl with J or M."""
    if char in ("\n", "\r") or (ctrl and char in ("j", "m")):
        return "enter"
    named = {"\t": "tab", "\x7f": "backspace", "\b": "backspace", "\x1b": "esc", " ": "space"}
    return f"ctrl-{char}" if ctrl else named.get(char, char)


@dataclass(frozen=True)
class Console:
    max_runs: int = 8
    smoothing: float = 0.6
    x_mode: str = "step"
    follow: bool = True
    focus: str = TAGS
    run_at: int = 0
    tag_at: int = 0
    run_scroll: int = 0
    tag_scroll: int = 0
    known: frozenset[str] = frozenset()
    hidden: frozenset[str] = frozenset()
    capped: int | None = None
    run_part: str = ""
    tag_part: str = ""
    editing: str | None = None
    former_part: str = ""
    opened: Mapping[str, bool] = field(default_factory=dict)
    grid: bool = False
    log_y: bool = False
    sidebar: bool = True
    view: View = field(default_factory=View)
    help: bool = False
    message: str = ""
    message_until: float = 0.0
    reload: bool = False
    quit: bool = False

    @classmethod
    def of(cls, options: Options) -> Console:
        return cls(options.max_runs, options.smoothing, options.x_mode, options.follow)

    def listed(self, runs: Sequence[str]) -> list[str]:
        """The runs that the filter shows."""
        return [r for r in runs if self.run_part.lower() in r.lower()]

    def say(self, message: str, now: float) -> Console:
        return replace(self, message=message, message_until=now + NOTICE)

    def admit(self, runs: Sequence[str], now: float = 0.0) -> Console:
        """Runs that were not there before are shown while fewer than max_runs are; nobody's choice is undone. The first that has to be hidden gives a notice."""
        new = [r for r in runs if r not in self.known]
        if not self.max_runs or not new:
            return self
        room = max(0, self.max_runs - sum(r in self.known and r not in self.hidden for r in runs))
        out = replace(self, known=self.known | {*new}, hidden=self.hidden | {*new[room:]})
        if len(new) > room and self.capped is None:
            out = replace(out, capped=len(runs)).say(f"{len(runs)} runs found, the first {self.max_runs} are shown: Shift-Tab and Space add others, / filters", now)
        return out

    def chart(self, tag: str) -> Chart:
        return Chart(tag, self.x_mode, self.smoothing, self.log_y, self.view)

    def selected(self, rows: Sequence) -> int:
        """The row of the tree that is selected."""
        return max(0, min(self.tag_at, len(rows) - 1))

    def scrolled(self, run_rows: int, tag_rows: int) -> Console:
        """Scrolled so that both selected rows are in sight of so many rows."""
        return replace(self, run_scroll=layout.scroll_for(self.run_scroll, self.run_at, run_rows), tag_scroll=layout.scroll_for(self.tag_scroll, self.tag_at, tag_rows))

    def press(self, key: str, runs: Sequence[str] = (), rows: Sequence = (), now: float = 0.0) -> Console:
        """What a key does. Any key closes the help; while a filter is edited all keys go there."""
        if self.help:
            return replace(self, help=False)
        if self.editing:
            return self._edit(key)
        act = _ANYWHERE.get(key) or _IN[self.focus].get(key)
        return act(self, runs, rows, now) if act else self

    def _edit(self, key: str) -> Console:
        part, at = ("run_part", "run_at") if self.editing == RUNS else ("tag_part", "tag_at")
        if key == "enter":
            return replace(self, editing=None, **{at: 0})
        if key == "esc":
            return replace(self, editing=None, **{part: self.former_part})
        if key == "backspace":
            return replace(self, **{part: getattr(self, part)[:-1]})
        char = " " if key == "space" else key
        return replace(self, **{part: getattr(self, part) + char, at: 0}) if len(char) == 1 else self

    def _turn_focus(self, by: int) -> Console:
        return replace(self, focus=FOCUS[(FOCUS.index(self.focus) + by) % len(FOCUS)])

    def _toggle_listed(self, runs: Sequence[str], now: float) -> Console:
        listed = {*self.listed(runs)}
        if listed & self.hidden:
            return replace(self, hidden=self.hidden - listed).say(f"{len(listed)} runs shown", now)
        return replace(self, hidden=self.hidden | listed).say(f"{len(listed)} runs hidden", now)

    def _filter(self) -> Console:
        runs = self.focus == RUNS
        return replace(self, editing=RUNS if runs else TAGS, former_part=self.run_part if runs else self.tag_part, focus=self.focus if runs else TAGS)

    def _run(self, runs: Sequence[str], act: Callable[[Console, list[str]], Console]) -> Console:
        listed = self.listed(runs)
        return act(replace(self, run_at=min(self.run_at, len(listed) - 1)), listed) if listed else self

    def _row(self, rows: Sequence, act: Callable[[Console, object], Console]) -> Console:
        return act(replace(self, tag_at=self.selected(rows)), rows[self.selected(rows)]) if rows else self

    def _open(self, row, wanted: bool) -> Console:
        return replace(self, opened={**self.opened, row["path"]: wanted})

    def _close(self, rows: Sequence) -> Console:
        """Closes an open group; from any other row goes to the group that holds it."""

        def act(c: Console, row) -> Console:
            if not row["leaf"] and row["expanded"]:
                return c._open(row, False)
            above = [i for i in range(c.tag_at) if rows[i]["depth"] < row["depth"]]
            return replace(c, tag_at=above[-1]) if above else c

        return self._row(rows, act)

    def _enter_row(self, rows: Sequence) -> Console:
        return self._row(rows, lambda c, row: replace(c, grid=False, focus=CHART) if row["leaf"] else c._open(row, not row["expanded"]))


def _moves(field_name: str, count: Callable[[Console, Sequence, Sequence], int], ends: bool = True) -> dict:
    def to(place: Callable[[int, int], int]):
        def act(c: Console, runs: Sequence, rows: Sequence, now: float) -> Console:
            n = count(c, runs, rows)
            return replace(c, **{field_name: max(0, min(place(getattr(c, field_name), n), n - 1))}) if n else c

        return act

    down, up = to(lambda i, n: i + 1), to(lambda i, n: min(i, n - 1) - 1 if i else 0)
    return {"j": down, "down": down, "k": up, "up": up, **({"home": to(lambda i, n: 0), "end": to(lambda i, n: n - 1)} if ends else {})}


def _axis(c: Console) -> Console:
    mode, view = layout.next_axis(c.x_mode)
    return replace(c, x_mode=mode, view=view)


_ANYWHERE: dict[str, Callable] = {
    **dict.fromkeys(("q", "Q", "ctrl-c"), lambda c, *_: replace(c, quit=True)),
    "?": lambda c, *_: replace(c, help=True),
    "tab": lambda c, *_: c._turn_focus(1),
    "backtab": lambda c, *_: c._turn_focus(-1),
    "b": lambda c, *_: replace(c, sidebar=not c.sidebar),
    "g": lambda c, *_: replace(c, grid=not c.grid),
    "L": lambda c, *_: replace(c, log_y=not c.log_y),
    "f": lambda c, runs, rows, now: replace(c, follow=not c.follow, reload=not c.follow).say("paused" if c.follow else "following", now),
    "r": lambda c, runs, rows, now: replace(c, reload=True).say("reloading", now),
    "x": lambda c, *_: _axis(c),
    "s": lambda c, *_: replace(c, smoothing=layout.smoother(c.smoothing, False)),
    "S": lambda c, *_: replace(c, smoothing=layout.smoother(c.smoothing, True)),
    "a": lambda c, runs, rows, now: c._toggle_listed(runs, now),
    **dict.fromkeys("+=", lambda c, *_: replace(c, view=layout.zoom(c.view, True))),
    **dict.fromkeys("-_", lambda c, *_: replace(c, view=layout.zoom(c.view, False))),
    "[": lambda c, *_: replace(c, view=layout.pan(c.view, False)),
    "]": lambda c, *_: replace(c, view=layout.pan(c.view, True)),
    "0": lambda c, *_: replace(c, view=View()),
    "/": lambda c, *_: c._filter(),
}
_IN: dict[str, dict[str, Callable]] = {
    RUNS: {
        **_moves("run_at", lambda c, runs, rows: len(c.listed(runs))),
        "space": lambda c, runs, rows, now: c._run(runs, lambda c, own: replace(c, hidden=c.hidden ^ {own[c.run_at]})),
        "enter": lambda c, runs, rows, now: c._run(runs, lambda c, own: replace(c, hidden=frozenset(runs) - {own[c.run_at]}).say(f"only {own[c.run_at]}", now)),
    },
    TAGS: {
        **_moves("tag_at", lambda c, runs, rows: len(rows)),
        **dict.fromkeys(("l", "right"), lambda c, runs, rows, now: c._row(rows, lambda c, row: c if row["leaf"] else c._open(row, True))),
        **dict.fromkeys(("h", "left"), lambda c, runs, rows, now: c._close(rows)),
        "enter": lambda c, runs, rows, now: c._enter_row(rows),
    },
    CHART: {
        **_moves("tag_at", lambda c, runs, rows: len(rows), ends=False),
        **dict.fromkeys(("h", "left"), lambda c, *_: replace(c, view=layout.move_cursor(c.view, False))),
        **dict.fromkeys(("l", "right"), lambda c, *_: replace(c, view=layout.move_cursor(c.view, True))),
        **dict.fromkeys(("c", "esc"), lambda c, *_: replace(c, view=replace(c.view, cursor=None))),
    },
}
