"""Schemas of the metric tables, and the parameters of a chart query."""

from __future__ import annotations

from dataclasses import dataclass, field

POINTS = "run string, tag string, step long, wall double, value double, path string, rec_off long, val_idx int"
FILES = "run string, path string, path_parts array<string>, length long, offset long, dead boolean, error string"
CHECKSUMS = "run string, path string, records long, wrong long"
LISTING = "run string, path string, path_parts array<string>, length long"
ERRORS = "run string, path string, offset long, error string"
#: Columns that give points of a series their order of arrival.
ARRIVAL = ("path", "rec_off", "val_idx")

STEP, RELTIME, WALL = "step", "reltime", "wall"
X_MODES = (STEP, RELTIME, WALL)


@dataclass(frozen=True)
class View:
    """The shown part of the x domain, as fractions, and the cursor's place in it."""

    lo: float = 0.0
    hi: float = 1.0
    cursor: float | None = None


@dataclass(frozen=True)
class Chart:
    """What a chart shows: one tag of all enabled runs at a resolution of px_w by px_h dots."""

    tag: str
    x_mode: str = STEP
    smoothing: float = 0.6
    log_y: bool = False
    view: View = field(default_factory=View)
    px_w: int = 400
    px_h: int = 80


@dataclass(frozen=True)
class Options:
    """Settings of a session over a log directory."""

    logdir: str
    refresh: float = 2.0
    follow: bool = True
    smoothing: float = 0.6
    x_mode: str = STEP
    max_runs: int = 8
    max_points: int = 100_000

    def __post_init__(self) -> None:
        if self.x_mode not in X_MODES:
            raise ValueError(f"x must be one of {', '.join(X_MODES)}, not {self.x_mode!r}")
        if not 0 <= self.smoothing <= 0.99:
            raise ValueError("smoothing must lie between 0 and 0.99")
        if self.max_runs < 0 or self.max_points < 0:
            raise ValueError("limits must not be negative; 0 means no limit")
        object.__setattr__(self, "refresh", max(0.2, self.refresh))
