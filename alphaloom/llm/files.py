"""Whole files on the shared file system, from inside tasks: written under a temporary name, then moved into place."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; plain paths are local ones."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


class Appender:
    """A file that appears under its name only when closed; a retried task writes the same file again."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out, self.size = self.fs.open_output_stream(self.tmp), 0

    def write(self, data: bytes) -> int:
        """Offset at which the bytes stand."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.path)


class Ranges:
    """Range reads; keeps the last file open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            f, path = open_fs(uri)
            self.uri, self.file = uri, f.open_input_file(path)
        self.file.seek(offset)
        return self.file.read(length)

    def size(self, uri: str) -> int:
        self.read(uri, 0, 0)
        return self.file.size()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.uri, self.file = None, None
