"""Finding and reading event files, on local disks or any file system that pyarrow opens by URI."""

from __future__ import annotations

import os
from collections.abc import Collection, Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem

from curvemill.sources.columnar import Columns, decode, frames, wrong_checksums
from curvemill.sources.wire import HEADER, TRAILER

SLICE = 4 << 20


@dataclass(frozen=True)
class EventFile:
    run: str
    path: str
    parts: tuple[str, ...]
    length: int


def is_event_file(name: str) -> bool:
    return "tfevents" in name and not name.endswith(".profile-empty")


def run_of(relative_folder: str) -> str:
    return relative_folder.replace(os.sep, "/").strip("/") or "."


def _local_walk(top: str) -> Iterator[tuple[str, int]]:
    try:
        entries = sorted(os.scandir(top), key=lambda e: os.fsencode(e.name))
    except OSError:
        return
    for e in entries:
        try:
            if e.is_dir():  # folders behind links too
                yield from _local_walk(e.path)
            elif is_event_file(e.name):
                yield e.path, e.stat().st_size
        except OSError:
            continue


def discover(top: str) -> list[EventFile]:
    """All event files below a folder, in the order of their path parts; folders that cannot be read are passed over."""
    if "://" in top:
        system, root = FileSystem.from_uri(top)
        infos = system.get_file_info(FileSelector(root, recursive=True, allow_not_found=True))
        found = [(i.path, i.size) for i in infos if i.type == FileType.File and is_event_file(i.base_name)]
        prefix = top[: len(top) - len(root)] if top.endswith(root) else top.split("://")[0] + "://"
    else:
        root, prefix = os.path.abspath(top), ""
        found = list(_local_walk(root))
    files = []
    for path, size in found:
        relative = os.path.relpath(path, root)
        parts = tuple(relative.replace(os.sep, "/").split("/"))
        files.append(EventFile(run_of("/".join(parts[:-1])), prefix + path, parts, size))
    return sorted(files, key=lambda f: f.parts)


def file_system(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), os.path.abspath(path))


def open_file(path: str):
    """A file for reading by position."""
    if "://" in path:
        system, at = FileSystem.from_uri(path)
        return system.open_input_file(at)
    return open(path, "rb")


def read_range(path: str, start: int, stop: int | None = None, step: int = SLICE, tags: Collection[str] | None = None, limit: int | None = None) -> Iterator[Columns]:
    """The points of a file from offset start (of the given tags), slice by slice; what a slice leaves undecoded goes to the next.

    All records that begin before stop are read, the last of them to its end; nothing is read from limit on.
    """
    with open_file(path) as source:
        source.seek(start)
        at, rest = start, b""
        while True:
            room = step if stop is None else min(step, stop - at - len(rest))
            if stop is not None and room <= 0:
                if at >= stop:
                    return
                room = HEADER - len(rest) if len(rest) < HEADER else HEADER + int.from_bytes(rest[:8], "little") + TRAILER - len(rest)
            if limit is not None:
                room = min(room, limit - at - len(rest))
            more = source.read(room) if room > 0 else b""
            data = rest + more
            if not more:
                return
            found = decode(data, at, tags)
            yield found
            if found.corrupt:
                return
            rest, at = data[found.consumed :], at + found.consumed


def checksums(path: str, step: int = SLICE) -> tuple[int, int]:
    """Whole records of a file, and how many of them have a wrong checksum. Reading points does not look at checksums."""
    records = bad = at = 0
    rest = b""
    with open_file(path) as source:
        while more := source.read(step):
            data = rest + more
            starts, at, broken = frames(memoryview(data))
            records, bad = records + len(starts), bad + wrong_checksums(data, starts, at)
            rest = data[at:]
            if broken:
                break
    return records, bad
