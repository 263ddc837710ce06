"""Runs and tags: lists, filters, the default cap, colours, toggles and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HUES = 8
#: The marker of a run by how its line is dashed, and the dash patterns (on, period).
MARKERS = ("●", "◆", "▪")
DASHES = ((1, 1), (6, 9), (2, 6))


def runs(files: DataFrame) -> DataFrame:
    """All runs by name; a run is there as soon as one of its files is, points or not."""
    return files.select("run").distinct().orderBy("run")


def contains_ignoring_case(name: Column, part: str) -> Column:
    """Whether the name contains the literal part, neither with regard to case; an empty part is in every name."""
    return F.contains(F.lower(name), F.lower(F.lit(part)))


def filter_runs(table: DataFrame, part: str) -> DataFrame:
    return table.where(contains_ignoring_case(F.col("run"), part))


def filter_tags(table: DataFrame, part: str) -> DataFrame:
    return table.where(contains_ignoring_case(F.col("tag"), part))


def cap_runs(names: DataFrame, most: int) -> DataFrame:
    """(run, enabled): the first ``most`` runs by name are enabled; 0 enables all."""
    if most <= 0:
        return names.select("run", F.lit(True).alias("enabled"))
    first = names.select("run").distinct().orderBy("run").limit(most).withColumn("enabled", F.lit(True))
    return names.select("run").distinct().join(F.broadcast(first), "run", "left").withColumn("enabled", F.coalesce("enabled", F.lit(False)))


def admit_runs(known: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """(run, enabled): known runs keep their state; new ones, by name, are enabled while fewer than ``most`` runs are."""
    new = found.select("run").distinct().join(known, "run", "left_anti")
    if most <= 0:
        return known.select("run", "enabled").unionByName(new.withColumn("enabled", F.lit(True)))
    room = max(0, most - known.where("enabled").count())
    return known.select("run", "enabled").unionByName(cap_runs(new, room) if room else new.withColumn("enabled", F.lit(False)))


def hidden_notice(table: DataFrame) -> DataFrame:
    """(n_runs, n_hidden, notice), one row; the notice is null while nothing is hidden."""
    counted = table.agg(F.count("*").alias("n_runs"), F.count_if(~F.col("enabled")).alias("n_hidden"))
    text = F.format_string("%d runs found, %d shown", F.col("n_runs"), F.col("n_runs") - F.col("n_hidden"))
    return counted.withColumn("notice", F.when(F.col("n_hidden") > 0, text))


def colours(files: DataFrame) -> DataFrame:
    """(run, color_slot, hue, dash, marker): slots count runs in the order in which a sorted walk of the folders meets them.

    ``files`` has run and path_parts. Paths are compared part by part, so a/b comes before a-x.
    """
    first = files.groupBy("run").agg(F.min("path_parts").alias("first"))
    slot = first.select("run", (F.dense_rank().over(Window.orderBy("first")) - 1).alias("color_slot"))  # one row a run
    return style(slot)


def assign_slots(known: DataFrame, found: DataFrame) -> DataFrame:
    """(run, color_slot): known runs keep theirs, new ones get the next free slots in the order of their paths."""
    new = found.groupBy("run").agg(F.min("path_parts").alias("first")).join(known, "run", "left_anti")
    next_free = F.broadcast(known.agg(F.coalesce(F.max("color_slot") + 1, F.lit(0)).alias("free")))  # one row
    numbered = new.select("run", F.row_number().over(Window.orderBy("first", "run")).alias("k")).crossJoin(next_free)
    return known.select("run", "color_slot").unionByName(numbered.select("run", (F.col("free") + F.col("k") - 1).cast("int").alias("color_slot")))


def style(slots: DataFrame) -> DataFrame:
    """Adds hue (8 of them), dash (solid, dashed, dotted; the last for all further slots) and marker to color_slot."""
    dash = F.least(F.floor(F.col("color_slot") / HUES), F.lit(len(DASHES) - 1)).cast("int")
    marker = F.element_at(F.array(*[F.lit(m) for m in MARKERS]), dash + 1)
    return slots.select("*", F.pmod("color_slot", F.lit(HUES)).alias("hue"), dash.alias("dash"), marker.alias("marker"))


def dash_covers(dash: Column, phase: Column) -> Column:
    """Whether the phase-th dot of a line is drawn."""
    on = F.element_at(F.array(*[F.lit(a) for a, _ in DASHES]), dash + 1)
    period = F.element_at(F.array(*[F.lit(b) for _, b in DASHES]), dash + 1)
    return (period <= 1) | (F.pmod(phase, period) < on)


def toggle(table: DataFrame, run: str) -> DataFrame:
    """Flips one run."""
    return table.withColumn("enabled", F.when(F.col("run") == run, ~F.col("enabled")).otherwise(F.col("enabled")))


def solo(table: DataFrame, run: str) -> DataFrame:
    """Enables one run and no other, listed or not."""
    return table.withColumn("enabled", F.col("run") == run)


def toggle_all(table: DataFrame, part: str = "") -> DataFrame:
    """If a listed run is disabled all listed ones are enabled, else all listed are disabled; the others stay."""
    listed = contains_ignoring_case(F.col("run"), part)
    off = F.broadcast(table.where(listed).agg(F.coalesce(F.bool_or(~F.col("enabled")), F.lit(False)).alias("any_off")))  # one row
    return table.crossJoin(off).withColumn("enabled", F.when(listed, F.col("any_off")).otherwise(F.col("enabled"))).drop("any_off")


def enabled_points(points: DataFrame, table: DataFrame) -> DataFrame:
    return points.join(table.where("enabled").select("run"), "run", "left_semi")


def tags(points: DataFrame, table: DataFrame | None = None, part: str = "") -> DataFrame:
    """The distinct tags of the enabled runs that contain part, by name."""
    own = points if table is None else enabled_points(points, table)
    return filter_tags(own.select("tag").distinct(), part).orderBy("tag")


def header(points: DataFrame, table: DataFrame, cap: int, part: str = "") -> DataFrame:
    """(runs_on, runs_total, n_tags, total_points, max_stride), one row."""
    from curvemill.operators.thin import summary

    counts = table.agg(F.count_if("enabled").alias("runs_on"), F.count("*").alias("runs_total"))
    shown = tags(points, table, part).agg(F.count("*").alias("n_tags"))
    return counts.crossJoin(shown).crossJoin(summary(points, cap)).select("runs_on", "runs_total", "n_tags", "total_points", "max_stride")
