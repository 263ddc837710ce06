"""How far the event files of a stream have been read: small files in a folder that driver and executors share.

A task that reads a file, as long as it was when a batch was planned, up to its last whole record notes the place under the file's name and that length. The next
batch, whose start is that same length, looks the place up. A batch that is run again notes the same places, and what is
written appears under its name all at once, so neither retried tasks nor restarts leave gaps or doubles. Marks of dead files say where and why reading them ended.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyarrow.fs import FileSelector, FileType

from curvemill.sources import files

END, DEAD = ".end", ".dead"


def name_of(path: str) -> str:
    return hashlib.sha1(path.encode()).hexdigest()


def _put(folder: str, name: str, content: dict) -> None:
    system, at = files.file_system(folder)
    system.create_dir(at, recursive=True)
    hidden = f"{at}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as f:
        f.write(json.dumps(content).encode())
    system.move(hidden, f"{at}/{name}")


def _names(folder: str, kind: str) -> list[str]:
    system, at = files.file_system(folder)
    found = system.get_file_info(FileSelector(at, allow_not_found=True))
    return [i.base_name for i in found if i.type == FileType.File and i.base_name.endswith(kind) and not i.base_name.startswith(".")]


def _get(folder: str, name: str) -> dict:
    system, at = files.file_system(folder)
    with system.open_input_stream(f"{at}/{name}") as f:
        return json.loads(f.read())


def note(folder: str, path: str, length: int, at: int) -> None:
    """The file, when length bytes long, has whole records up to at."""
    _put(folder, f"{name_of(path)}-{length:020d}{END}", {"path": path, "length": length, "at": at})


def place(folder: str, path: str, length: int) -> int:
    """Where records went up to when the file was length bytes long."""
    return _get(folder, f"{name_of(path)}-{length:020d}{END}")["at"] if length else 0


def ends(folder: str) -> dict[str, int]:
    """By name of the file, the greatest length it was read at."""
    out: dict[str, int] = {}
    for name in _names(folder, END):
        key, _, length = name.removesuffix(END).partition("-")
        out[key] = max(out.get(key, 0), int(length))
    return out


def forget(folder: str, lengths: dict[str, int], at_once: int) -> None:
    """Deletes places at lengths before the given ones."""
    least = {name_of(path): length for path, length in lengths.items()}
    system, at = files.file_system(folder)
    old = [n for n in _names(folder, END) if int(n.removesuffix(END).partition("-")[2]) < least.get(n.partition("-")[0], 0)]
    with ThreadPoolExecutor(at_once) as workers:
        list(workers.map(lambda n: system.delete_file(f"{at}/{n}"), old))


def bury(folder: str, path: str, length: int, at: int, run: str, why: str | None) -> None:
    """The file is dead: no batch that starts at that length or later reads it."""
    _put(folder, name_of(path) + DEAD, {"path": path, "length": length, "offset": at, "run": run, "error": why})


def dead(folder: str) -> dict[str, int]:
    """Files that are not read any more, and the length they had when they were found dead."""
    return {mark["path"]: mark["length"] for mark in (_get(folder, n) for n in _names(folder, DEAD))}
