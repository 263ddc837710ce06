"""Keys, and the screen they lead to."""

import os
import subprocess
import sys

import pytest

from curvemill.functions.terminal import key_of
from curvemill.operators import catalog
from curvemill.plans.console import CHART, HELP, RUNS, TAGS, Console, key_name
from curvemill.plans.screen import Grid, Screen
from curvemill.plans.session import Session
from curvemill.schema import Options, View
from curvemill.sources import datasource, demo

RUN_NAMES = [f"run{i:03}" for i in range(20)]
ROWS = [
    {"path": "a", "leaf": False, "expanded": True, "depth": 0, "tag": None}, {"path": "a/x", "leaf": True, "expanded": False, "depth": 1, "tag": "a/x"},
    {"path": "a/y", "leaf": True, "expanded": False, "depth": 1, "tag": "a/y"}, {"path": "b", "leaf": True, "expanded": False, "depth": 0, "tag": "b"},
]


def typed(c, *keys, runs=RUN_NAMES, rows=ROWS):
    for k in keys:
        c = c.press(k, runs, rows, 1.0)
    return c


def test_names_of_keys():
    assert [key_name("\n"), key_name("\r"), key_name("j", True), key_name("m", True), key_name("j"), key_name(" "), key_name("\t")] == ["enter"] * 4 + ["j", "space", "tab"]
    assert [key_of(x) for x in ("\x1b[A", "\x1b[Z", "\x1b", "\x03", "\n", "\r", "q", "\x7f")] == ["up", "backtab", "esc", "ctrl-c", "enter", "enter", "q", "backspace"]
    assert typed(Console(), key_of("\x03")).quit and typed(Console(), "q").quit


def test_focus_and_plain_switches():
    c = Console()
    assert [typed(c, *["tab"] * k).focus for k in range(4)] == [TAGS, CHART, RUNS, TAGS] and typed(c, "backtab").focus == RUNS
    assert typed(c, "L").log_y and not typed(c, "b").sidebar and typed(c, "g").grid and not typed(c, "g", "g").grid
    assert typed(c, "?").help and not typed(c, "?", "q").help and not typed(c, "?", "q").quit and len(HELP) > 10
    assert typed(c, "s").smoothing == 0.55 and typed(c, *"S" * 20).smoothing == 0.99
    moved = typed(c, "+", "x")
    assert moved.x_mode == "reltime" and moved.view == View() and typed(c, "+").view.lo == pytest.approx(0.15) and typed(c, "+", "0").view == View()
    assert typed(c, "+", "]").view.hi == pytest.approx(0.955) and typed(c, "+", "[").view.lo == pytest.approx(0.045) and typed(c, "+", "-").view == View()


def test_pause_and_reload():
    c = typed(Console(), "f")
    assert not c.follow and not c.reload and c.message == "paused" and c.message_until == 3.5
    assert typed(c, "f").follow and typed(c, "f").reload and typed(Console(), "r").reload


def test_the_first_runs_are_shown_and_choices_stay():
    c = Console(max_runs=3).admit(RUN_NAMES, 5.0)
    assert sorted({*RUN_NAMES} - c.hidden) == RUN_NAMES[:3] and c.capped == 20 and "20 runs" in c.message
    more = typed(c, "backtab", *["j"] * 3, "space", "j", "space")
    assert {*RUN_NAMES} - more.hidden == {*RUN_NAMES[:5]}
    assert more.admit(RUN_NAMES) == more
    late = more.admit([*RUN_NAMES, "zzz"])
    assert late.hidden == more.hidden | {"zzz"} and late.capped == 20
    assert not Console(max_runs=0).admit(RUN_NAMES).hidden
    assert Console(max_runs=3).admit(RUN_NAMES[:2]).admit(RUN_NAMES).hidden == {*RUN_NAMES[3:]}


def test_runs_list():
    c = typed(Console(), "backtab", "end", "k", "enter")
    assert c.run_at == 18 and {*RUN_NAMES} - c.hidden == {"run018"} and c.message == "only run018"
    assert typed(c, "home").run_at == 0 and typed(c, "home", "up").run_at == 0
    grouped = typed(Console(), "backtab", "/", *"01", "enter", "a")  # all shown: the listed ones are hidden
    assert grouped.hidden == {r for r in RUN_NAMES if "01" in r} and typed(grouped, "a").hidden == frozenset()
    assert typed(Console(), "backtab", "space", runs=[]) == typed(Console(), "backtab")


def test_slash_filters_the_list_in_focus():
    c = typed(Console(), "/", *"Ab", "backspace")
    assert c.editing == TAGS and c.tag_part == "A" and typed(c, "esc").tag_part == "" and typed(c, "q").tag_part == "Aq" and typed(c, "space").tag_part == "A "
    assert typed(c, "enter").editing is None and typed(c, "enter").tag_part == "A" and typed(c, "tab").tag_part == "A"
    assert typed(typed(c, "enter"), "/", "x", "esc").tag_part == "A"
    r = typed(Console(), "backtab", "/", "7")
    assert r.editing == RUNS and r.run_part == "7" and r.listed(RUN_NAMES) == ["run007", "run017"] and r.run_at == 0
    assert typed(Console(), "tab", "/").focus == TAGS


def test_tag_tree():
    c = Console()
    assert typed(c, "left").opened == {"a": False} and typed(c, "enter").opened == {"a": False} and typed(c, "right").opened == {"a": True}
    assert typed(c, "j", "j", "h").tag_at == 0 and typed(c, "end").tag_at == 3 and typed(c, "end", "j").tag_at == 3
    leaf = typed(c, "g", "j", "enter")
    assert leaf.focus == CHART and not leaf.grid and typed(leaf, "j").tag_at == 2 and typed(leaf, "k").tag_at == 0
    at = typed(leaf, "l", "l")
    assert at.view.cursor == pytest.approx(0.52) and typed(leaf, "h").view.cursor == 0.5 and typed(at, "c").view.cursor is None and typed(at, "esc").view.cursor is None
    assert typed(c, "j", rows=[]) == c and typed(c, "z") == c
    assert Console(run_at=9, tag_at=2).scrolled(4, 4).run_scroll == 6


def test_grid_of_cells():
    g = Grid(5, 2)
    g.put(3, 0, "abc", "\x1b[1m")
    g.put(0, 9, "no")
    assert g.lines(False) == ["   ab", ""] and g.lines(True)[0] == "   \x1b[0m\x1b[1mab\x1b[0m"


def test_screen(spark, tmp_path):
    demo.append(str(tmp_path), 0, 60, 60, now=1.7e9)
    os.makedirs(tmp_path / "empty")
    open(tmp_path / "empty" / "events.out.tfevents.0", "w").close()
    session = Session.open(spark, Options(str(tmp_path), max_runs=2))
    shown = Screen(session, Console(max_runs=2), 120, 30)
    lines = shown.draw()
    assert shown.runs == ["baseline", "empty", "high_lr", "low_lr/warmup"] and "runs 2/4" in lines[0] and "live ○" in lines[0] and "4 runs found" in lines[-1]
    assert any("▣ ● baseline" in x for x in lines) and any("☐" in x and "high_lr" in x for x in lines) and any("▾ train (4)" in x for x in lines)
    assert any("⠀" < c <= "⣿" for x in lines for c in x)
    console = typed(shown.console, "tab", "l", runs=shown.runs, rows=shown.rows)
    coloured = Screen(session, console, 120, 30, depth="truecolor").draw()
    assert any("\x1b[38;2;" in x for x in coloured) and any("baseline  " in x and " @ " in x for x in coloured)
    grid = Screen(session, typed(console, "g"), 120, 30).draw()
    assert sum("train/" in x for x in grid) >= 2
    none = Screen(session, typed(console, "/", "z", "z"), 120, 30).draw()
    assert any("no tags match filter" in x for x in none) and "filter tags: zz" in none[-1]
    assert Screen(session, Console(), 20, 5).draw()[0] == "terminal too small"
    session.close()


def test_listing_opens_no_file(spark, tmp_path):
    (tmp_path / "r").mkdir()
    path = tmp_path / "r" / "events.out.tfevents.1"
    path.write_bytes(b"\0" * 40)
    row = datasource.read(spark, str(tmp_path), "listing").collect()
    assert [(r["run"], r["path_parts"], r["length"]) for r in row] == [("r", ["r", path.name], 40)]
    assert [r["run"] for r in catalog.runs(datasource.read(spark, str(tmp_path), "listing")).collect()] == ["r"]


def test_a_missing_folder_is_an_error(tmp_path):
    done = subprocess.run([sys.executable, "-m", "curvemill", str(tmp_path / "none")], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert done.returncode == 2 and "not a directory" in done.stderr
