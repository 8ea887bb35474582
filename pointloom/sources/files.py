"""Files on any store, on the driver or in a task, by positional reads and committed writes."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


def size(uri: str) -> int:
    store, path = open_fs(uri)
    info = store.get_file_info(path)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(uri)
    return info.size


def read_at(uri: str, start: int, count: int) -> bytes:
    store, path = open_fs(uri)
    with store.open_input_file(path) as f:
        return f.read_at(count, start)


def expand(paths: Iterable[str], ending: str = ".ply") -> list[str]:
    """Files as they are, folders as the files in them (not deeper) with this ending, sorted."""
    out: list[str] = []
    for uri in paths:
        store, path = open_fs(uri)
        info = store.get_file_info(path)
        if info.type == fs.FileType.Directory:
            out += sorted(uri.rstrip("/") + "/" + x.base_name for x in store.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and x.base_name.endswith(ending))
        elif info.type == fs.FileType.File:
            out.append(uri)
        else:
            raise FileNotFoundError(uri)
    return out


class Writing:
    """A stream under a temporary name that gets its own when it is closed well."""

    def __init__(self, uri: str):
        self.store, self.path = open_fs(uri)
        parent = self.path.rpartition("/")[0]
        self.store.create_dir(parent or ".", recursive=True)
        self.part = f"{parent}/_tmp-{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.part)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def commit(self) -> None:
        self.out.close()
        self.store.move(self.part, self.path)
