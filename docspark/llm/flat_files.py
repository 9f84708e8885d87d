"""Flat files in the folder that the driver and all executors share, written and read at places by executors.

Each attempt of a task writes files of names of its own, and tells them in its result; what a lost or repeated attempt
wrote is in no result, so nobody reads it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it. An address that only Spark's readers know is refused."""
    try:
        return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))
    except (pa.ArrowException, OSError, ValueError) as e:
        raise ValueError(f"files at {uri} can't be opened here: {e}") from e


def reachable(uri: str) -> bool:
    """Whether files at the address can be opened here, not by Spark's readers alone."""
    try:
        opened(uri)
    except ValueError:
        return False
    return True


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class Files:
    """Files of one task's attempt in a folder, one for each kind of content, appended to."""

    def __init__(self, folder: str, task: int):
        self.system, self.base = opened(folder)
        self.system.create_dir(self.base, recursive=True)
        self.name = f"{task:06}-{uuid.uuid4().hex}"
        self.folder, self.streams, self.sizes = folder.rstrip("/"), {}, {}

    def append(self, kind: str, data: np.ndarray) -> None:
        if kind not in self.streams:
            self.streams[kind], self.sizes[kind] = self.system.open_output_stream(f"{self.base}/{self.name}.{kind}"), 0
        raw = data.tobytes()
        self.streams[kind].write(raw)
        self.sizes[kind] += len(raw)

    def path(self, kind: str) -> str:
        return f"{self.folder}/{self.name}.{kind}"

    def close(self) -> None:
        for own in self.streams.values():
            own.close()


class Reader:
    """Ranges of files, a file kept open until another is asked for."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, size: int) -> bytes:
        if uri != self.uri:
            self.close()
            system, path = opened(uri)
            self.uri, self.file = uri, system.open_input_file(path)
        return self.file.read_at(size, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.uri, self.file = None, None


@contextmanager
def reader() -> Iterator[Reader]:
    own = Reader()
    try:
        yield own
    finally:
        own.close()
