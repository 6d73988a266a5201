"""WARC archives: whole-file gzip in, one member per record and an offset index out.

`write` puts records into archives that are one gzip stream each, as some crawlers
leave them; no record of such a file can be read without all before it. `normalise`
inflates each of them once, as a stream, writes every record again as a gzip member
of its own, and beside the archive a line of JSON per record with its place. `read`
goes by these indexes and can fetch any record alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybook.llm import files
from waybook.sources.scratch import folder, stage

#: Bytes of payload after which a task begins another archive.
ARCHIVE = 256 << 20
#: Bytes read from a file at a time.
PIECE = 1 << 20
#: The profile of a record whose payload another one has.
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, uri: str, number: int | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit has no block but names the payload's digest and length and the record that has it."""
    block = b"" if kind == "revisit" else payload
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{uuid.uuid4().urn}>",
        "WARC-Date": date,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "X-Page-ID": "" if number is None else str(number),
        "X-Payload-Length": str(len(payload)),
    }
    if kind == "revisit":
        fields |= {"WARC-Profile": SAME, "X-Refers-To-Page-ID": str(refers_to)}
    fields |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + _END


class Inflated:
    """The bytes of a gzip file of any number of members, inflated as they are read."""

    def __init__(self, source: BinaryIO):
        self.source, self.held, self.member, self.left = source, bytearray(), None, b""

    def _more(self) -> bool:
        data = self.left or self.source.read(PIECE)
        if not data and self.member is None:
            return False
        if self.member is None:
            self.member = zlib.decompressobj(31)
        made = self.member.decompress(data, PIECE)
        if not data and not made and not self.member.eof:
            raise ValueError("the archive ends within a gzip member")
        self.held += made
        self.left = self.member.unconsumed_tail
        if self.member.eof:
            self.left, self.member = self.member.unused_data, None
        return True

    def until(self, mark: bytes) -> bytes:
        """Up to and with the mark; empty at the end of the file."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends within a record")
                return b""
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, block, raw bytes) of every record, one in memory at a time."""
    stream = Inflated(source)
    while head := stream.until(_END):
        lines = head.decode().strip().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        block = stream.take(int(fields["content-length"]))
        if (tail := stream.take(len(_END))) != _END:
            raise ValueError("a record's length is wrong")
        yield fields, block, head + block + tail


def write(pages: DataFrame, target: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Archives of pages (page_id, url, html, record_type, refers_to) below `target`; the written list (path, records)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        count = size = 0

        def close() -> pa.RecordBatch:
            out.write(deflate.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count])], ["path", "records"])

        for batch in it:
            for number, url, html, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, deflate, count, size = files.new(target, "warc.gz"), zlib.compressobj(wbits=31), 0, 0
                    out = files.writer(name)
                payload = (html or "").encode()
                out.write(deflate.compress(record(kind, url or "", number, payload, refers_to, date)))
                count, size = count + 1, size + len(payload)
                if size > ARCHIVE:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    rows = pages.select("page_id", "url", "html", "record_type", "refers_to")
    return stage(rows.mapInArrow(run, "path string, records long"), "archives")


def normalise(archives: DataFrame, target: str) -> DataFrame:
    """Rewrite each archive (path) below `target`; the written list (path, index, records)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path in batch.column(0).to_pylist():
                name, at, count = files.new(target, "warc.gz"), 0, 0
                with files.reader(path) as source, files.writer(name) as out, files.writer(name + ".index") as index:
                    for fields, _, raw in records(source):
                        member = zlib.compressobj(wbits=31)
                        data = member.compress(raw) + member.flush()
                        out.write(data)
                        line = {"offset": at, "length": len(data), "type": fields["warc-type"], "id": fields["warc-record-id"], "uri": fields["warc-target-uri"], "digest": fields["warc-payload-digest"]}
                        index.write(json.dumps(line).encode() + b"\n")
                        at, count = at + len(data), count + 1
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, name + ".index", count)], ["path", "index", "records"])

    spread = archives.select("path").repartition(max(1, archives.count()))
    return stage(spread.mapInArrow(run, "path string, index string, records long"), "normalised")


def places(index: BinaryIO) -> Iterator[tuple[int, int]]:
    """(offset, length) of every record of an index, read in pieces."""
    left = b""
    while data := index.read(PIECE):
        *lines, left = (left + data).split(b"\n")
        for line in lines:
            entry = json.loads(line)
            yield entry["offset"], entry["length"]


def read(normalised: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of every record, found by the indexes.

    A record whose payload does not have the digest or length it names is an error.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, size = [], 0
                with files.reader(path) as source, files.reader(index) as listed:
                    for offset, length in places(listed):
                        source.seek(offset)
                        fields, block, _ = next(records(pa.BufferReader(source.read(length))))
                        named, count = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                        revisit = fields["warc-type"] == "revisit"
                        if not revisit and (digest(block) != named or len(block) != count):
                            raise ValueError(f"the record at {offset} of {path} is broken")
                        number = fields["x-page-id"]
                        held.append((int(number) if number else None, count, named, fields["warc-type"], int(fields["x-refers-to-page-id"]) if revisit else None, None if revisit else block))
                        size += len(block) + 100
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    spread = normalised.select("path", "index").repartition(max(1, normalised.count()))
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def deduplicated(pages: DataFrame, least: int = 0) -> DataFrame:
    """`pages` (page_id, url, html) with record_type and refers_to.

    Of the pages with equal payloads of at least `least` bytes, the one with the
    largest page_id is the response, the others revisit it; all other pages are
    responses. A null html is an empty payload. Pages without an id are responses
    and are revisited by none. Rows that repeat a page_id with the same payload are
    all responses if the largest id is theirs.
    """
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    long = F.octet_length(payload) >= least
    marked = pages.filter(F.col("page_id").isNotNull() & long).select("page_id", F.sha2(payload, 256).alias("_mark"))
    last = marked.groupBy("_mark").agg(F.max("page_id").alias("_last"))
    # only the pages that are not the last come into the join with the texts
    others = stage(marked.join(last, "_mark").filter("page_id < _last").select(F.col("page_id").alias("_page"), F.col("_mark").alias("_same"), "_last").distinct(), "revisits")
    joined = pages.join(others, (F.col("page_id") == F.col("_page")) & (F.sha2(payload, 256) == F.col("_same")), "left")
    return joined.select("page_id", "url", "html", F.when(F.col("_last").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("_last").alias("refers_to"))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write every page, normalise the archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row per row; an empty table gives an empty one; other columns are not read.
    """
    spark = pages.sparkSession
    archives = write(deduplicated(pages, least), folder(spark, "archives"))
    return read(normalise(archives, folder(spark, "records"))).drop("payload")
