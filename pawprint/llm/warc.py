"""WARC archives as seekable Zstandard bundles.

A bundle holds WARC records in independent Zstandard frames, as many in each as come to FRAME_BYTES, and ends in a seek table: a skippable frame
with compressed and whole size of each frame and the seekable format's footer, so that any seekable-format reader
can use it. Before the seek table stands a skippable frame that maps record identifiers to frame numbers and the
record's offset in its frame. A reader needs the bundle's end to find and decompress any one record.

Of pages with equal payloads - found by SHA-256 of the payload, for payloads of at least revisit_bytes - the one
with the smallest identifier is written as response, the others as revisit records that refer to it.

Defined cases: null html counts as an empty payload and null url as an empty one; rows that repeat an identifier
are all written, and of those with one payload one is the response; null identifiers come last and refer to the group's response; an
empty table writes no bundle; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, shuffle_partitions, written

# Fixed values of the Zstandard seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
#: The skippable frame with the record map.
RECORD_MAP = 0x184D2A50
MAP_ENTRY = struct.Struct("<qBII")  # identifier, whether it has one, frame number, offset in the frame
BUNDLE_BYTES = 64 << 20
#: A frame is closed when its records come to as much; a longer record has one of its own.
FRAME_BYTES = 256 << 10
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:pawprint:page:{'' if page_id is None else page_id}>"


def uri_id(uri: str) -> int | None:
    found = uri.removeprefix("<urn:pawprint:page:").removesuffix(">")
    return int(found) if found else None


def build_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 response, or a revisit record without the payload. The HTTP header has the payload's length in both."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of a record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (None in a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind, digest = field["WARC-Type"], field["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(body) != length or payload_digest(body) != digest):
        raise ValueError(f"damaged payload in {field['WARC-Record-ID']}")
    return {
        "page_id": uri_id(field["WARC-Record-ID"]),
        "url": field["WARC-Target-URI"],
        "record_type": kind,
        "refers_to": uri_id(field["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload_bytes": length,
        "payload_digest": digest,
        "payload": body if kind == "response" else None,
    }


class BundleWriter:
    """Writes records into frames; memory holds one frame or record and the tables."""

    def __init__(self, out):
        import zstandard

        self.out, self.frames, self.map, self.size, self.open = out, [], [], 0, bytearray()
        self.zstd = zstandard.ZstdCompressor(level=3)

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.open and len(self.open) + len(record) > FRAME_BYTES:
            self.flush()
        self.map.append((page_id, len(self.frames), len(self.open)))
        self.open += record
        if len(self.open) >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.open:
            data = self.zstd.compress(bytes(self.open))
            self.out.write(data)
            self.frames.append((len(data), len(self.open)))
            self.size += len(data)
            self.open = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(MAP_ENTRY.pack(i or 0, i is not None, frame, at) for i, frame, at in self.map)
        table += struct.pack("<I", len(self.map))
        self.out.write(struct.pack("<II", RECORD_MAP, len(table)) + table)
        # the record map is a frame without content to the seek table
        sizes = [*self.frames, (len(table) + 8, 0)]
        seek = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(seek)) + seek)


class Bundle:
    """Reads a bundle: records() in order, get(page_id) by its tables alone."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        f.seek(size - 9 - 8 * n)
        sizes = list(struct.iter_unpack("<II", f.read(8 * n)))
        self.places, at = [], 0
        for packed, whole in sizes[:-1]:
            self.places.append((at, packed, whole))
            at += packed
        f.seek(at)
        table = f.read(sizes[-1][0])[8:-4]
        self.map = [(i if known else None, frame, start) for i, known, frame, start in MAP_ENTRY.iter_unpack(table)]

    def frame(self, i: int) -> bytes:
        import zstandard

        at, packed, _ = self.places[i]
        self.f.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.f.read(packed))

    def end(self, n: int) -> int:
        """Where the n-th record ends in its frame."""
        frame = self.map[n][1]
        return self.map[n + 1][2] if n + 1 < len(self.map) and self.map[n + 1][1] == frame else self.places[frame][2]

    def records(self):
        last, data = None, b""
        for n, (_, frame, start) in enumerate(self.map):
            if frame != last:
                last, data = frame, self.frame(frame)
            yield parse_record(data[start : self.end(n)])

    def get(self, page_id: int) -> dict | None:
        return next((parse_record(self.frame(frame)[at : self.end(n)]) for n, (i, frame, at) in enumerate(self.map) if i == page_id), None)


def mark_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, revisit_bytes: int) -> DataFrame:
    """page_id, url, payload, and for pages of groups of equal payloads: first_id, the smallest identifier.

    The digests' groups are aggregated before their shuffle; the join that brings them back is on digests alone and
    keeps to groups of two and more, of which a row each is sent; a group's own rows may be split by Spark.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    sha = F.sha2("payload", 256)
    same = rows.filter(F.octet_length("payload") >= revisit_bytes).groupBy(sha.alias("same_sha")).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    same = written(same.filter("n > 1").select("same_sha", "first_id"), "warc-groups")
    groups = same.count()
    if groups == 0:
        return rows.withColumn("first_id", F.lit(None).cast("long"))
    from .common import bounded_broadcast

    return rows.join(bounded_broadcast(same, groups, 120), (sha == F.col("same_sha")) & (F.octet_length("payload") >= revisit_bytes), "left").drop("same_sha")


def write_bundles(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0) -> DataFrame:
    """Writes bundles under path; returns a written table of them: path, records. Only bundles of successful tasks are listed."""
    marked = mark_revisits(pages, id_col, url_col, html_col, revisit_bytes)

    def run(batches):
        files, base = fs.FileSystem.from_uri(path)
        files.create_dir(base)
        done, out = [], None
        seen = set()
        for b in batches:
            for page, url, payload, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = payload.encode()
                # an identifier may come with several payloads: each has a response
                mine = (page, hashlib.sha256(payload).digest()) if page == first and first is not None else None
                revisit = first is not None and (mine is None or mine in seen)
                if mine:
                    seen.add(mine)
                if out is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                    bundle = BundleWriter(out)
                bundle.add(page, build_record(page, url, payload, first, revisit))
                if bundle.size >= BUNDLE_BYTES:
                    bundle.close()
                    out.close()
                    done.append((f"{path}/{name}", len(bundle.map)))
                    out = None
        if out is not None:
            bundle.close()
            out.close()
            done.append((f"{path}/{name}", len(bundle.map)))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    # by identifier, so that rows that repeat one are told apart in one task
    dealt = marked.repartition(shuffle_partitions(pages.sparkSession), "page_id").select("page_id", "url", "payload", "first_id")
    return written(dealt.mapInArrow(run, "path string, records bigint"), "warc-bundles")


FIELDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def read_bundles(bundles: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the listed bundles, checked against their digests; with_payload adds payload (binary, null in a revisit)."""
    schema = FIELDS + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                files, name = fs.FileSystem.from_uri(path)
                with files.open_input_file(name) as f:
                    rows, held = [], 0
                    for r in Bundle(f, f.size()).records():
                        rows.append(r)
                        held += r["payload_bytes"] if with_payload else 100
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

    n = max(1, bundles.count())
    return bundles.select("path").repartition(n).mapInArrow(run, schema)


def get_record(bundle_path: str, page_id: int) -> dict | None:
    """One record of one bundle, by its seek table and record map."""
    files, name = fs.FileSystem.from_uri(bundle_path)
    with files.open_input_file(name) as f:
        return Bundle(io.BufferedReader(f), f.size()).get(page_id)


def archive_round_trip(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """Writes bundles into the shared folder and reads their records back."""
    return read_bundles(write_bundles(pages, scratch(pages.sparkSession, "warc"), revisit_bytes=revisit_bytes))
