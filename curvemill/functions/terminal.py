"""The terminal on the driver: depth of colours from its environment, the colour of each hue, and keys."""

from __future__ import annotations

import contextlib
import os
import select
import time
from collections.abc import Callable, Iterator, Mapping

TRUE_COLOUR, INDEXED, BASIC = "truecolor", "256", "basic"

#: Parts of the names of terminals that show 256 colours.
INDEXED_TERMS = ("256color", "direct", "kitty", "alacritty", "wezterm", "foot", "contour", "ghostty")


def colour_depth(env: Mapping[str, str]) -> str:
    """What a terminal with this environment can show."""
    named, term = env.get("COLORTERM", ""), env.get("TERM", "")
    if named.lower() in ("truecolor", "24bit"):
        return TRUE_COLOUR
    return INDEXED if named or any(part in term for part in INDEXED_TERMS) else BASIC


def hue_colour(hue: int, depth: str) -> str:
    """An ANSI foreground sequence for one of the eight hues: evenly spaced around the circle, or the basic colours."""
    import colorsys

    hue %= 8
    if depth == BASIC:
        return f"\x1b[{31 + hue % 6 if hue < 6 else 91 + hue - 6}m"
    r, g, b = colorsys.hls_to_rgb(hue / 8, 0.62, 0.75)
    if depth == TRUE_COLOUR:
        return f"\x1b[38;2;{round(r * 255)};{round(g * 255)};{round(b * 255)}m"
    return f"\x1b[38;5;{16 + 36 * round(r * 5) + 6 * round(g * 5) + round(b * 5)}m"


#: What terminals send for keys that are no characters.
SEQUENCES = {
    "\x1b[A": "up", "\x1b[B": "down", "\x1b[C": "right", "\x1b[D": "left", "\x1bOA": "up", "\x1bOB": "down", "\x1bOC": "right", "\x1bOD": "left", "\x1b[Z": "backtab",
    "\x1b[H": "home", "\x1b[F": "end", "\x1b[1~": "home", "\x1b[4~": "end", "\x1bOH": "home", "\x1bOF": "end",
}


def key_of(sent: str) -> str:
    """The name of what one key sent."""
    from curvemill.plans.console import key_name

    if sent in SEQUENCES:
        return SEQUENCES[sent]
    if len(sent) == 1 and "\x01" <= sent <= "\x1a" and sent not in "\t\n\r\b":
        return key_name(chr(ord(sent) + 96), ctrl=True)
    return key_name(sent)


@contextlib.contextmanager
def keys(source) -> Iterator[Callable[[float], str | None]]:
    """A function that waits so many seconds for a key and gives its name; without a terminal it only waits."""
    if not source.isatty():
        yield lambda seconds: time.sleep(seconds)
        return
    import termios
    import tty

    fd = source.fileno()
    before = termios.tcgetattr(fd)

    def pressed(seconds: float) -> str | None:
        if not select.select([fd], [], [], seconds)[0]:
            return None
        return key_of(os.read(fd, 8).decode(errors="replace"))

    try:
        tty.setcbreak(fd)
        yield pressed
    finally:
        termios.tcsetattr(fd, termios.TCSADRAIN, before)
