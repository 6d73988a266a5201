"""A stream of the lines that are appended to files, new ones among them.

Spark's file source reads a file once; what is appended later is lost. This reader's offset is
the place behind the last whole line of each file, so a batch reads what was appended since the
last one, and a line that is still being written waits for its end. The offset has one entry per
file and stands in the checkpoint. A long stretch is read in ranges by several tasks; a file that
has become shorter has been replaced and is read again from its start.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from waybook.sources.tables import parse_lines

#: Bytes that one task reads, that are looked at at once, and that make a batch of lines.
RANGE, BLOCK = 32 << 20, 1 << 20


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[len("file:/") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def append(path: str, data: bytes, at: int) -> None:
    """Write data behind the first `at` bytes of a file, so that a repeated task leaves the same file."""
    system, name = _at(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    size = max(0, system.get_file_info(name).size or 0)
    if at and size != at:
        with system.open_input_file(name) as file:
            data = file.read(at) + data
        at = 0
    with system.open_append_stream(name) if at else system.open_output_stream(name) as out:
        out.write(data)


def last_line_end(file: pa.NativeFile, floor: int, size: int) -> int:
    """The place behind the last newline in [floor, size), or floor."""
    to = size
    while to > floor:
        begin = max(floor, to - BLOCK)
        file.seek(begin)
        found = file.read(to - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        to = begin
    return floor


def lines(file: pa.NativeFile, first: int, start: int, stop: int, end: int) -> Iterator[list[tuple[int, bytes]]]:
    """(place, line) of the lines that begin in [start, stop); the file's whole lines go from `first` to `end`."""
    at, held = start, b""
    if start > first:  # the line that holds the byte before belongs to the range before, unless it ends there
        at, held = start - 1, None
    file.seek(at)
    read = at
    while at < stop and read < end:
        block = file.read(min(BLOCK, end - read))
        if not block:
            raise OSError("a tailed file has become shorter while it was read")
        read += len(block)
        if held is None:
            cut = block.find(b"\n") + 1
            if not cut:
                at += len(block)
                continue
            at, block, held = at + cut, block[cut:], b""
        *whole, held = (held + block).split(b"\n")
        out = []
        for line in whole:
            if at >= stop:
                break
            out.append((at, line))
            at += len(line) + 1
        if out:
            yield out


@dataclass
class Stretch(InputPartition):
    file: str
    first: int
    start: int
    stop: int
    end: int

    def __post_init__(self) -> None:
        super().__init__(self.start)


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str, width: int):
        self.path, self.pattern, self.width = path, pattern, width
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = _at(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.Directory:
            found = [f for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and fnmatch(f.base_name, self.pattern)]
        else:
            found = [info] if info.type == fs.FileType.File else []
        for f in found:
            size, end = self.known.get(f.path, (0, 0))
            if f.size < size:
                size, end = 0, 0
            if f.size > size:
                with system.open_input_file(f.path) as file:
                    end = last_line_end(file, end, f.size)
            self.known[f.path] = (f.size, end)
        return {f.path: self.known[f.path][1] for f in sorted(found, key=lambda f: f.path) if self.known[f.path][1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for file, stop in end.items():
            first = start.get(file, 0) if start.get(file, 0) <= stop else 0
            out += [Stretch(file, first, at, min(at + self.width, stop), stop) for at in range(first, stop, self.width)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, _ = _at(self.path)
        with system.open_input_file(partition.file) as file:
            for some in lines(file, partition.first, partition.start, partition.stop, partition.end):
                texts = [line.decode("utf-8", "replace") for _, line in some]
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(some)), pa.array([at for at, _ in some]), pa.array(texts)], ["file", "at", "line"])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "waybook_tail"

    def schema(self) -> str:
        return "file string, at bigint, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("pattern", "*"), int(self.options.get("width", RANGE)))


def tailed_lines(spark: SparkSession, path: str, pattern: str = "*", width: int = RANGE) -> DataFrame:
    """Stream of ``file, at, line``: whole lines of a file, or of a folder's files that fit the pattern, with their place.

    The path is one that the driver and all executors can open. Within a file ``at`` gives the order.
    """
    spark.dataSource.register(TailSource)
    return spark.readStream.format(TailSource.name()).option("pattern", pattern).option("width", width).load(path)


def tailed_log(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ("qid",), pattern: str = "*", width: int = RANGE) -> DataFrame:
    """The records of a growing log, read leniently, with ``file`` and ``at``."""
    return parse_lines(tailed_lines(spark, path, pattern, width), "line", schema, required)
