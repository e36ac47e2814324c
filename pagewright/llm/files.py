"""Raw files in the folder that driver and executors share, by URI."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Writes under a name of its own; close() renames: a lost or repeated task leaves a whole file or none."""

    def __init__(self, uri: str):
        self.store, self.path = _at(uri)
        self.store.create_dir(posixpath.dirname(self.path), recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.part"
        self.file = self.store.open_output_stream(self.own)

    def write(self, part: bytes) -> None:
        self.file.write(part)

    def close(self) -> None:
        self.file.close()
        self.store.move(self.own, self.path)


def write(uri: str, parts: list) -> None:
    out = Writer(uri)
    for p in parts:
        out.write(p)
    out.close()


def read(uri: str) -> bytes:
    store, path = _at(uri)
    with store.open_input_stream(path) as f:
        return f.read()


class Reader:
    """Ranges of one file."""

    def __init__(self, uri: str):
        store, path = _at(uri)
        self.file = store.open_input_file(path)

    def at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def close(self) -> None:
        self.file.close()
