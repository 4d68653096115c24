"""Whole files written, and ranges of files read, by tasks: local and shared folders directly, other stores by pyarrow."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlsplit


def _local(uri: str) -> str | None:
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return unquote(parts.path) if parts.scheme else uri
    return None


def create(uri: str):
    """A new file, open for writing; its folder is made."""
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def put(uri: str, data: bytes) -> None:
    """A whole file; whoever sees it under its name sees all of it."""
    part = f"{uri}.{uuid.uuid4().hex}.part"
    with create(part) as f:
        f.write(data)
    if (path := _local(uri)) is not None:
        os.replace(_local(part), path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.move(fs.FileSystem.from_uri(part)[1], path)


def read(uri: str, offset: int, length: int) -> bytes:
    """The bytes of one range."""
    if (path := _local(uri)) is not None:
        with open(path, "rb") as f:
            f.seek(offset)
            return f.read(length)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read_at(length, offset)


def tables(uri: str, columns: list[str], where: tuple) -> list:
    """`columns` of the Parquet files of one folder, of rows that fulfil `where`; none if there is no such folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = (fs.LocalFileSystem(), local) if (local := _local(uri)) is not None else fs.FileSystem.from_uri(uri)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return [pq.read_table(f.path, columns=columns, filters=[where], filesystem=store) for f in found if f.base_name.endswith(".parquet")]
