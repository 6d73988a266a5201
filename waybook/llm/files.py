"""Files that tasks write and read by themselves in the shared folder.

A task writes under a name nobody else uses and reports it in its rows; only
files named in the written report count. What a lost or repeated task leaves is
not read by anyone and goes with the folder.
"""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[len("file:/") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def new(folder: str, ending: str) -> str:
    return f"{folder}/{uuid.uuid4().hex}.{ending}"


def writer(path: str) -> BinaryIO:
    system, name = _at(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(name, compression=None)


def reader(path: str) -> BinaryIO:
    """The bytes as they are; the stream can seek."""
    system, name = _at(path)
    return system.open_input_file(name)
