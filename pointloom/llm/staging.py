"""Files in the folder that driver and executors share (see ``pointloom.shared``).

Files that no Spark writer produces go through pyarrow's file systems, so ``file:``, ``hdfs:`` and ``s3:`` folders all work.
"""

from __future__ import annotations

import uuid

from pyarrow import fs

from pointloom.shared import drop, folder, keep, root, shelf

__all__ = ["commit_file", "drop", "folder", "keep", "open_fs", "read_file", "root", "shelf"]


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, on the driver or an executor."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def commit_file(uri: str, blob: bytes) -> None:
    """Write under a temporary name, then rename: a file under its final name is whole, and a repeated task only replaces it by the same bytes."""
    store, path = open_fs(uri)
    parent = path.rpartition("/")[0]
    store.create_dir(parent, recursive=True)
    part = f"{parent}/_tmp-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(blob)
    store.move(part, path)


def read_file(uri: str) -> bytes:
    store, path = open_fs(uri)
    with store.open_input_file(path) as f:
        return f.read()
