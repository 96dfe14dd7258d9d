"""WARC in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames, frames into bundles. A bundle ends with two skippable frames: an
index from record identifiers to (frame, offset inside the decompressed frame, length), and the seek table of the
Zstandard seekable format, whose footer is found from the end of the file. One record is read by decompressing one frame.

A bundle is one row of a table (name, bytes) in the shared folder: Spark's own writer commits it, so a lost executor or a
repeated task leaves no torn archive, and the store may be one that only Spark reaches. `export` turns a row into a file.

Of records with equal payloads (of at least min_bytes) the smallest page_id is the response and the others are revisits
of it, without payload. Equality is by SHA-1 and length.

Defined results: null html is an empty payload; a null page_id never is the smallest unless all are null, then all of
those rows are responses; rows that repeat the smallest page_id are all responses; a null url leaves out the target
header; an empty table writes no bundle; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stage

#: Raw bytes of records in a frame, and in a bundle. One longer record has a frame or bundle of its own.
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 24
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

#: Fixed values of the Zstandard formats.
SKIPPABLE_INDEX = 0x184D2A5D
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
#: Fixed value of the WARC standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLES = "bundle string, n_records long, n_frames long, content binary"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame long, frame_offset long, record_bytes long"
NO_ID = -(1 << 63)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    found = urn[len("<urn:page:") : -1]
    return None if found == "none" else int(found)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit's block is the HTTP head alone, which states the full payload's length."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def decode_record(record: bytes) -> dict:
    """The fields and, of a response, the payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its header")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class BundleWriter:
    """Builds one bundle in memory."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.out, self.seek, self.index, self.open = bytearray(), [], [], bytearray()
        self.raw = 0

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.open and len(self.open) + len(record) > self.frame_bytes:
            self._close_frame()
        self.index.append((NO_ID if page_id is None else page_id, len(self.seek), len(self.open), len(record)))
        self.open += record
        self.raw += len(record)

    def _close_frame(self) -> None:
        frame = self.packer.compress(bytes(self.open))
        self.seek.append((len(frame), len(self.open)))
        self.out += frame
        self.open = bytearray()

    def finish(self) -> bytes:
        if self.open:
            self._close_frame()
        index = b"".join(struct.pack("<qIQQ", *row) for row in self.index)
        self.out += struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index
        # The index is an entry of the seek table too, of no decompressed bytes, so that offsets add up.
        entries = [*self.seek, (len(index) + 8, 0)]
        table = b"".join(struct.pack("<II", *row) for row in entries) + struct.pack("<IBI", len(entries), 0, SEEKABLE_MAGIC)
        self.out += struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table
        return bytes(self.out)


class BundleReader:
    """Random access to a bundle's records."""

    def __init__(self, content: bytes):
        self.content = content
        n, _, magic = struct.unpack_from("<IBI", content, len(content) - 9)
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end")
        start = len(content) - 9 - 8 * n
        if struct.unpack_from("<I", content, start - 8)[0] != SKIPPABLE_SEEK_TABLE:
            raise ValueError("seek table without its frame header")
        sizes = list(struct.iter_unpack("<II", content[start : start + 8 * n]))
        self.frames, at = [], 0
        for packed, raw in sizes:
            self.frames.append((at, packed, raw))
            at += packed
        at, packed, _ = self.frames.pop()
        self.index = list(struct.iter_unpack("<qIQQ", content[at + 8 : at + packed]))
        self.unpacker, self.held = zstandard.ZstdDecompressor(), (-1, b"")

    def frame(self, i: int) -> bytes:
        if self.held[0] != i:
            at, packed, raw = self.frames[i]
            self.held = (i, self.unpacker.decompress(self.content[at : at + packed], max_output_size=max(raw, 1)))
        return self.held[1]

    def records(self) -> Iterator[tuple[int, int, int, bytes]]:
        for _, frame, offset, length in self.index:
            yield frame, offset, length, self.frame(frame)[offset : offset + length]

    def find(self, page_id: int) -> list[bytes]:
        """All records of an identifier, each by one frame."""
        return [self.frame(f)[o : o + n] for p, f, o, n in self.index if p == page_id]


#: Digests that occur more than once, up to which they are broadcast, so that payloads stay where they are read.
FEW_DIGESTS = 200_000
#: Copies of one payload beyond which its digest counts as hot where digests are too many to be broadcast.
HOT = 10_000


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 (hex), size, first_id, and revisit: whether an equal payload has a smaller page_id.

    Digests that occur more than once are counted and written, one narrow row each. If they are few they are broadcast and
    no payload is shuffled. Otherwise only the hot ones (at most one for HOT rows) are, and the rest are joined by
    digest, where a hot payload's rows are dealt by page_id instead, as they need no partner any more.
    """
    slim = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    keyed = slim.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    counted = keyed.where(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    shared = stage(counted, "digests")
    if shared.limit(FEW_DIGESTS + 1).count() <= FEW_DIGESTS:
        joined = keyed.join(F.broadcast(shared.drop("n")), ["sha1", "size"], "left")
    else:
        hot, cold = shared.where(F.col("n") > HOT).limit(FEW_DIGESTS), shared
        told = keyed.join(F.broadcast(hot.select("sha1", "size", F.col("first_id").alias("hot_first"), F.lit(True).alias("is_hot"))), ["sha1", "size"], "left")
        told = told.withColumn("deal", F.when(F.col("is_hot"), F.concat(F.lit("hot "), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("sha1")))
        joined = told.join(cold.select(F.col("sha1").alias("deal"), "size", "first_id"), ["deal", "size"], "left").withColumn("first_id", F.coalesce("hot_first", "first_id")).drop("deal", "hot_first", "is_hot")
    return joined.withColumn("revisit", F.coalesce(F.col("first_id") != F.col("page_id"), F.col("first_id").isNotNull() & F.col("page_id").isNull()))


def write_bundles(pages: DataFrame, *, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """The written table of bundles."""
    marked = mark_revisits(pages, min_bytes).select("page_id", "url", "payload", "sha1", "first_id", "revisit")

    def run(batches):
        from pyspark import TaskContext

        part, made, writer = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes)

        def close():
            nonlocal made, writer
            content, n, frames = writer.finish(), len(writer.index), len(writer.seek)
            row = pa.RecordBatch.from_pydict({"bundle": [f"part-{part:06d}-{made:06d}.warc.zst"], "n_records": pa.array([n], pa.int64()), "n_frames": pa.array([frames], pa.int64()), "content": pa.array([content], pa.binary())})
            made, writer = made + 1, BundleWriter(frame_bytes)
            return row

        for batch in batches:
            for page_id, url, payload, sha1, first_id, revisit in zip(*(batch.column(i) for i in range(6))):
                page_id, digest = page_id.as_py(), base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                writer.add(page_id, encode_record(page_id, url.as_py(), payload.as_py(), digest, first_id.as_py(), revisit.as_py()))
                if writer.raw >= bundle_bytes:
                    yield close()
        if writer.index:
            yield close()

    return stage(map_arrow(marked, run, BUNDLES), "warc")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """One row per archived record, read through the seek table and the index; digests of payloads are checked."""

    def run(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("bundle", pa.string()), ("frame", pa.int64()), ("frame_offset", pa.int64()), ("record_bytes", pa.int64())])
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for frame, offset, length, record in BundleReader(content.as_py()).records():
                    found = decode_record(record)
                    del found["payload"]
                    rows.append(found | {"bundle": name.as_py(), "frame": frame, "frame_offset": offset, "record_bytes": length})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return map_arrow(bundles.select("bundle", "content"), run, RECORDS)


def export(content: bytes, path: str) -> None:
    """One bundle as a .warc.zst file."""
    with open(path, "wb") as out:
        out.write(content)


def digest(records: DataFrame) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
