"""Command line: ``python -m curvemill LOGDIR``, ``python -m curvemill bench LOGDIR`` and ``python -m curvemill gen-demo DIR``."""

from __future__ import annotations

import argparse
import os
import shutil
import sys
import time
from dataclasses import replace

from curvemill.schema import X_MODES, Chart, Options


#: Charts that the bench command takes the mean of.
REPEATS = 10


def parse(argv: list[str]) -> argparse.Namespace:
    if argv and argv[0] in ("bench", "gen-demo"):
        p = argparse.ArgumentParser(prog=f"curvemill {argv[0]}")
        p.add_argument("logdir")
        if argv[0] == "bench":
            p.add_argument("--max-points", type=int, default=0)
        else:
            p.add_argument("--steps", type=int, default=5000)
            p.add_argument("--live", action="store_true")
        out = p.parse_args(argv[1:])
        out.command = argv[0]
        return out
    p = argparse.ArgumentParser(prog="curvemill")
    p.add_argument("logdir")
    p.add_argument("--refresh", type=float, default=2.0)
    p.add_argument("--no-follow", action="store_true")
    p.add_argument("--smoothing", type=float, default=0.6)
    p.add_argument("--x", choices=X_MODES, default="step")
    p.add_argument("--max-runs", type=int, default=8)
    p.add_argument("--max-points", type=int, default=100_000)
    out = p.parse_args(argv)
    out.command = "view"
    return out


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("curvemill").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bench(logdir: str, max_points: int) -> dict:
    """Seconds of a cold load, of a refresh with nothing new, and of one chart of the longest series at 400 columns (a mean)."""
    from pyspark.sql import functions as F

    from curvemill.operators import summary
    from curvemill.plans import scratch
    from curvemill.plans.session import LiveSession
    from curvemill.sources import datasource
    from curvemill.streaming import live
    from curvemill.streaming.table import LiveTable

    spark = _spark()
    out, state = scratch.folder(spark, "bench"), scratch.folder(spark, "bench-state")
    options = Options(logdir, follow=False, max_points=max_points)
    times = {}
    for name in ("cold_load", "refresh_nothing_new"):
        began = time.perf_counter()
        live.follow(spark, options, out, state).awaitTermination()
        times[name] = time.perf_counter() - began
    session = LiveSession(LiveTable(spark, out, max_points), options, datasource.read(spark, logdir, "listing"))
    longest = summary.longest(session.summaries).first()
    session.table = session.table.withColumn("enabled", F.col("run") == longest["run"])
    times["chart_400"] = 0.0
    for _ in range(REPEATS):
        began = time.perf_counter()
        session.curves(Chart(longest["tag"], px_w=400)).collect()
        times["chart_400"] += (time.perf_counter() - began) / REPEATS
    head = session.header().first()
    return {"points": head["total_points"], "max_stride": head["max_stride"], **{k: round(v, 3) for k, v in times.items()}}


def main(argv: list[str] | None = None) -> int:
    args = parse(sys.argv[1:] if argv is None else argv)
    if args.command == "gen-demo":
        from curvemill.sources import demo

        demo.generate(args.logdir, args.steps, args.live)
        return 0
    if args.command == "bench":
        print(bench(args.logdir, args.max_points))
        return 0
    if "://" not in args.logdir and not os.path.isdir(args.logdir):
        print(f"curvemill: not a directory: {args.logdir}", file=sys.stderr)
        return 2
    options = Options(args.logdir, args.refresh, not args.no_follow, args.smoothing, args.x, args.max_runs, args.max_points)
    return watch(options) if options.follow else show(options)


def show(options: Options) -> int:
    """One screen of what is there now."""
    from curvemill.plans.console import Console
    from curvemill.plans.screen import Screen
    from curvemill.plans.session import Session

    session = Session.open(_spark(), options)
    print("\n".join(Screen(session, Console.of(options), *_size(), _depth()).draw()), flush=True)
    session.close()
    return 0


def _size() -> tuple[int, int]:
    size = shutil.get_terminal_size()
    return size.columns, size.lines - 1


def _depth() -> str | None:
    from curvemill.functions.terminal import colour_depth

    return colour_depth(os.environ) if sys.stdout.isatty() else None


def watch(options: Options) -> int:
    """Follows the logs by a stream and draws anew when points came, a key was pressed, or a message ends; keys are read where there is a terminal."""
    from curvemill.functions.terminal import keys
    from curvemill.plans import scratch
    from curvemill.plans.console import Console
    from curvemill.plans.screen import Screen
    from curvemill.plans.session import LiveSession
    from curvemill.sources import datasource
    from curvemill.streaming import live
    from curvemill.streaming.table import LiveTable

    spark, console, depth = _spark(), Console.of(options), _depth()
    out, state = (scratch.folder(spark, x) for x in ("live", "state"))
    changes = live.Changes()
    spark.streams.addListener(changes)
    changed = changes.wake
    start = lambda: live.follow(spark, options, out, state, maxFilesPerTrigger=64)
    listing = datasource.read(spark, options.logdir, "listing")  # the runs are there before anything is read
    query, session, screen = start(), None, None
    changed.set()
    with keys(sys.stdin) as pressed:
        while not console.quit:
            if changed.is_set() or session is None:
                changed.clear()
                if session:
                    session.close()
                session = LiveSession(LiveTable(spark, out, options.max_points), options, listing)
                screen = None
            if screen is None:
                screen = Screen(session, console, *_size(), depth, query is not None and query.isActive and query.status["isTriggerActive"])
                lines = screen.draw()
                console = screen.console
                print(("\x1b[H\x1b[2J" if depth else "") + "\n".join(lines), flush=True)
            key = pressed(options.refresh if not depth else 0.15)
            if key:
                console, screen = console.press(key, screen.runs, screen.rows, time.time()), None
                if not console.follow and query:
                    query.stop()
                    query = None
                elif console.follow and query is None:
                    query = start()
                if console.reload:
                    console = replace(console, reload=False)
                    changed.set()
            if query and query.exception():
                raise query.exception()
    if query:
        query.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
