"""Files in any store that Arrow knows, and a staged commit of files that tasks wrote."""

from __future__ import annotations

import fnmatch
import re
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage

#: Store requests that the driver has under way at a time.
AT_ONCE = 32
STAGING, MANIFEST, DONE = "_staging", "_manifest", "_SUCCESS"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if re.match(r"[a-zA-Z][\w+.-]*:/", path) else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files with that suffix under a folder, or of those that a pattern in the last part names; sorted. Names that begin with _ or . do not count."""
    store, name = opened(path)
    folder, _, last = name.rstrip("/").rpartition("/")
    if any(c in last for c in "*?["):
        info = store.get_file_info(fs.FileSelector(folder or "."))
        found = [f for f in info if f.is_file and fnmatch.fnmatch(f.base_name, last)]
    else:
        at = store.get_file_info(name)
        if at.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [at] if at.is_file else [f for f in store.get_file_info(fs.FileSelector(name, recursive=True)) if f.is_file and f.base_name.endswith(suffix)]
        found = [f for f in found if not any(p.startswith(("_", ".")) for p in f.path[len(name) :].split("/"))]
    if not found and any(c in last for c in "*?["):
        raise FileNotFoundError(path)
    return sorted((f.path, f.size) for f in found)


@dataclass
class Staged(WriterCommitMessage):
    """What a task wrote: its own folder under the staging one, and how many files of how many bytes."""

    folder: str
    files: int
    size: int


class StagedFiles:
    """Files that become visible together: tasks write them into folders of their own, the driver moves those of committed tasks into place.

    A task's folder holds its files and one manifest, which stays as `_manifest/<task>`. Whatever else was
    written, by attempts that failed or a job that did, goes with the staging folder. Names that two tasks
    wrote, or that are there already, are an error before anything is moved. Overwriting deletes what was
    there once all tasks are through.
    """

    def __init__(self, path: str, overwrite: bool):
        """In the driver: makes the staging folder, without which no task writes, so that one that outlives its job leaves nothing."""
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        opened(path)[0].create_dir(self.staging, recursive=True)

    @property
    def staging(self) -> str:
        return f"{opened(self.path)[1].rstrip('/')}/{STAGING}-{self.job}"

    def write(self, files: Iterator[tuple[str, Iterator[bytes], str]]) -> Staged:
        """In a task: write (name, parts of its content, line of the manifest) each; names may have folders in them."""
        store, own = opened(self.path)[0], f"{self.staging}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=False)
        lines, size, made = [], 0, {""}
        for name, parts, line in files:
            if name.startswith("/") or any(p in ("", ".", "..") or p.startswith("_") for p in name.split("/")):
                raise ValueError(f"not a name for a file here: {name!r}")
            folder = name.rpartition("/")[0]
            if folder not in made:
                _folders(store, own, folder)
                made.add(folder)
            if store.get_file_info(f"{own}/{name}").type != fs.FileType.NotFound:
                raise FileExistsError(name)
            with store.open_output_stream(f"{own}/{name}") as out:
                for part in parts:
                    out.write(part)
                    size += len(part)
            lines.append(line)
        if lines:
            with store.open_output_stream(f"{own}/{MANIFEST}") as out:
                out.write("".join(x + "\n" for x in lines).encode())
        return Staged(own, len(lines), size)

    def commit(self, messages: list[Staged | None]) -> None:
        store, top = opened(self.path)[0], opened(self.path)[1].rstrip("/")
        moves: dict[str, str] = {}
        folders = [m.folder for m in messages if m is not None and m.files]
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for folder, found in zip(folders, pool.map(lambda f: store.get_file_info(fs.FileSelector(f, recursive=True)), folders), strict=True):
                for f in found:
                    if f.is_file:
                        name = f.path[len(folder) + 1 :]
                        to = f"{top}/{MANIFEST}/{folder.rpartition('/')[2]}" if name == MANIFEST else f"{top}/{name}"
                        if to in moves:
                            self.abort(messages)
                            raise FileExistsError(name)
                        moves[to] = f.path
            if self.overwrite:
                for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                    if not f.base_name.startswith(STAGING):
                        store.delete_file(f.path) if f.is_file else store.delete_dir(f.path)
            else:
                there = [f.path for f in pool.map(store.get_file_info, moves) if f.type != fs.FileType.NotFound]
                if there:
                    self.abort(messages)
                    raise FileExistsError(there[0])
            for folder in sorted({to.rpartition("/")[0] for to in moves} | {top}):
                store.create_dir(folder, recursive=True)
            list(pool.map(lambda to: store.move(moves[to], to), moves))
        self.abort(messages)
        with store.open_output_stream(f"{top}/{DONE}") as out:
            out.write(b"")

    def abort(self, messages: list[Staged | None]) -> None:
        """Leave nothing of this job but what is in place."""
        store = opened(self.path)[0]
        for again in range(10):  # tasks that are still writing can be in the way
            try:
                if store.get_file_info(self.staging).type != fs.FileType.NotFound:
                    store.delete_dir(self.staging)
                return
            except OSError:
                if again == 9:
                    raise
                time.sleep(0.2)


def _folders(store: fs.FileSystem, top: str, inner: str) -> None:
    """The folders of a path below `top`, which must be there."""
    for part in inner.split("/"):
        top = f"{top}/{part}"
        if store.get_file_info(top).type == fs.FileType.NotFound:
            store.create_dir(top, recursive=False)
