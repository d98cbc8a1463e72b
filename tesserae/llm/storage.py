"""Immutable objects in the shared folder, written and range-read from tasks."""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs

#: Schemes that Spark's file systems use for what pyarrow names otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


class Store:
    """A folder reached by its URI, on whatever file system it lies.

    An object is written under a name of the attempt's own and then moved, so readers see whole objects only; two
    attempts that write one name write the same bytes, so it doesn't matter which move comes last.  Where a write
    fails, what it left is deleted.
    """

    def __init__(self, folder: str):
        uri = folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1)
        scheme, rest = uri.split("://", 1)
        self.system, self.path = fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")
        self.system.create_dir(self.path, recursive=True)

    @contextlib.contextmanager
    def attempt(self, *endings: str) -> Iterator[dict[str, str]]:
        """Paths of the attempt's own, by ending; those that weren't published are deleted at the end."""
        own = {ending: f"{self.path}/.{uuid.uuid4().hex}{ending}" for ending in endings}
        try:
            yield own
        finally:
            for path in own.values():
                if self.system.get_file_info(path).type == fs.FileType.File:
                    self.system.delete_file(path)

    def create(self, path: str) -> pa.NativeFile:
        return self.system.open_output_stream(path)

    def publish(self, path: str, name: str) -> None:
        self.system.move(path, f"{self.path}/{name}")

    def write(self, data: bytes, ending: str) -> str:
        """Writes an object under the digest of its bytes, and returns the name."""
        name = hashlib.sha256(data).hexdigest()[:40] + ending
        with self.attempt(ending) as own:
            with self.create(own[ending]) as out:
                out.write(data)
            self.publish(own[ending], name)
        return name

    def open(self, name: str) -> pa.NativeFile:
        return self.system.open_input_file(f"{self.path}/{name}")

    def read(self, name: str) -> bytes:
        with self.open(name) as file:
            return file.read()
