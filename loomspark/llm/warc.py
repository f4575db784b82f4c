"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame for each record.

Archives travel as rows (name, content), which is also what ``spark.read.format("binaryFile")`` gives for
files on disk, so they can be read from any store that Spark reads.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.lean import lean
from loomspark.scratch import materialize

#: Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bounds of the sample that a dictionary is trained on, and of the dictionary.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 16_000, 64_000
ARCHIVE_BYTES = 4 << 20
MAX_BROADCAST_ROWS = 500_000
_DATE = "2000-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary; of samples too few or small to train one, their beginnings as raw content."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION] + [f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _line(value: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", value or "")


def page_record(page_id, url: str | None, payload: bytes, sha1: str, refers_to) -> bytes:
    """A response with the payload, or a revisit that has its HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", _DATE),
        ("WARC-Target-URI", _line(url)), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    return _record(headers, head if revisit else head + payload)


class Writer:
    """Records in, archives out, each closed when it has grown to ``limit`` bytes."""

    def __init__(self, dictionary: bytes, limit: int = ARCHIVE_BYTES, level: int = 3) -> None:
        self.lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True, write_checksum=True).compress
        self.limit, self.frames, self.size = limit, [], 0

    def add(self, record: bytes) -> bytes | None:
        self.frames.append(self.compress(record))
        self.size += len(self.frames[-1])
        return self.close() if self.size >= self.limit else None

    def close(self) -> bytes | None:
        if not self.frames:
            return None
        out = self.lead + b"".join(self.frames)
        self.frames, self.size = [], 0
        return out


def _taken(stream: BinaryIO, n: int, what: str) -> bytes:
    got = stream.read(n)
    if len(got) < n:
        raise WarcError(f"{what} is cut short")
    return got


def _frame(stream: BinaryIO, magic: bytes) -> bytes:
    """The bytes of the frame that begins with ``magic``: its header, then blocks up to the one that is marked as the last."""
    what = "a frame"
    out = [magic, flags := _taken(stream, 1, what)]
    flag = flags[0]
    single = flag >> 5 & 1
    out.append(_taken(stream, (not single) + (0, 1, 2, 4)[flag & 3] + (single, 2, 4, 8)[flag >> 6], what))
    last = False
    while not last:
        out.append(head := _taken(stream, 3, what))
        word = int.from_bytes(head, "little")
        last, kind, size = bool(word & 1), word >> 1 & 3, word >> 3
        out.append(_taken(stream, 1 if kind == 1 else size, what))
    if flag >> 2 & 1:
        out.append(_taken(stream, 4, what))
    return b"".join(out)


def frames(archive: bytes | BinaryIO) -> Iterator[bytes]:
    """The decoded frames of an archive, or of a stream of one, of which a frame at a time is held."""
    stream = io.BytesIO(archive) if isinstance(archive, bytes) else archive
    magic, dictionary, at = stream.read(4), None, 0
    if magic == struct.pack("<I", DICTIONARY_MAGIC):
        (n,) = struct.unpack("<I", _taken(stream, 4, "the dictionary's frame"))
        raw = _taken(stream, n, "the dictionary's frame")
        dictionary = zstandard.ZstdCompressionDict(zstandard.decompress(raw) if raw[:4] == FRAME_MAGIC else raw)
        magic, at = stream.read(4), 8 + n
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while magic:
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame begins at byte {at}")
        frame = _frame(stream, magic)
        try:
            yield decoder.decompressobj().decompress(frame)
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at byte {at}: {e}") from e
        magic, at = stream.read(4), at + len(frame)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, names in lower case, and block; checks version, required headers and lengths."""
    head, split, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not split or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise WarcError("no WARC version line or no end of headers")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"not a header: {line[:80]!r}")
        headers[name.decode().lower()] = value.strip().decode()
    for name in REQUIRED:
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("Content-Length differs from the record")
    return headers, rest[:-4]


def read(archive: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, HTTP head, payload) of each record, its digest checked."""
    for frame in frames(archive):
        headers, block = parse(frame)
        head, split, payload = block.partition(b"\r\n\r\n")
        if not split or not head.startswith(b"HTTP/"):
            raise WarcError("no HTTP head")
        if headers["warc-type"] == "response" and headers.get("warc-payload-digest") != f"sha1:{digest(payload)}":
            raise WarcError("the payload's digest differs")
        yield headers, head, payload


def _written(dictionary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, part, k = Writer(dictionary.value), TaskContext.get().partitionId(), 0

        def row(content: bytes) -> pa.RecordBatch:
            nonlocal k
            k += 1
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:05d}-{k:05d}.warc.zst"]), pa.array([content], pa.binary())], ["name", "content"])

        for batch in batches:
            for page, url, html, first in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url")], batch.column("html").cast(pa.binary()).to_pylist(), batch.column("first").to_pylist(), strict=True):
                payload = html or b""
                if (full := writer.add(page_record(page, url, payload, digest(payload), first))) is not None:
                    yield row(full)
        if (full := writer.close()) is not None:
            yield row(full)

    return run


def _id(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d*)>", urn)
    if not found:
        raise WarcError(f"not a page: {urn}")
    return int(found[1]) if found[1] else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content").to_pylist():
            rows, held = [], 0
            for headers, head, payload in read(content):
                if held > ARCHIVE_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
                held += len(payload)
                size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
                if not size or headers["warc-type"] == "response" and int(size[1]) != len(payload):
                    raise WarcError("the HTTP Content-Length differs from the payload")
                to = headers.get("warc-refers-to")
                rows.append((_id(headers["warc-record-id"]), headers.get("warc-target-uri"), int(size[1]), headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"], _id(to) if to else None, payload.decode() if headers["warc-type"] == "response" else None))
            if rows:
                yield _batch(rows)


def write_archives(pages: DataFrame) -> DataFrame:
    """Archives (name, content) of ``pages`` (page_id, url, html), a record for each row.

    Of rows with equal html, those with the smallest page_id are responses and the others revisits of it. A null
    html is an empty payload. A null page_id comes after all others; where a group has none but null ids, all are
    responses. Repeated rows get a record each. An empty table gives no archives. Other columns are not read.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    body = F.coalesce(F.col("html"), F.lit(""))
    key = F.unhex(F.sha1(body.cast("binary"))).alias("_key")
    # Only groups of several pages are looked up, by a broadcast while they are few.
    firsts = materialize(pages.select("page_id", key).groupBy("_key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-firsts")
    firsts = F.broadcast(firsts) if firsts.count() <= MAX_BROADCAST_ROWS else firsts.hint("merge")
    # Of the pages, about four times the sample are let through by their hash before any is sent on.
    share = max(1, pages.count() // (4 * SAMPLE_PAGES))
    h = F.xxhash64("page_id", "url")
    some = pages.where("html <> ''").where(F.pmod(h, F.lit(share)) == 0).select(F.substring("html", 1, SAMPLE_BYTES).alias("html"), h.alias("h"))
    sample = [r[0].encode()[:SAMPLE_BYTES] for r in some.orderBy("h", "html").limit(SAMPLE_PAGES).collect()]
    dictionary = pages.sparkSession.sparkContext.broadcast(train(sample))
    rows = pages.withColumn("_key", key).join(firsts, "_key", "left").withColumn("first", F.when(F.col("first") == F.col("page_id"), None).otherwise(F.col("first")))
    return rows.select("page_id", "url", "html", "first").mapInArrow(lean(_written(dictionary)), "name string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each record in ``archives`` (content).

    Lengths and digests are checked; a record that breaks the format raises WarcError. A revisit has no payload.
    """
    return archives.select("content").mapInArrow(lean(_read), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back. Odd rows are as in :func:`write_archives`; very long pages are kept whole."""
    return read_archives(materialize(write_archives(pages), "warc-archives"))


def payloads(records: Iterable[tuple[dict[str, str], bytes, bytes]]) -> list[bytes]:
    return [payload for _, _, payload in records]
