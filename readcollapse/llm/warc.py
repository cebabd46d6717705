"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own.  A reader task takes a byte range of a file, looks for the gzip magic, decodes each
candidate's header and the first bytes of its data (which must begin a WARC record) and then the whole member, whose checksum
must hold, and the members that follow it; after a member the next one begins where it ends.  A task owns the records that start inside its range and
reads on past its end to finish the last, so any ranges that cover a file give every record once.

Archives lie in the shared folder under names of their own; only files in the manifest are read, so what a lost task has
left does not matter.

Defined results: null html is an empty payload; an empty table gives no archives and an empty result; pages that repeat a
page_id have a record each; of equal payloads of MIN_REVISIT bytes or more that with the largest page_id (not null) is the
response; a null url leaves out the target; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_arrow, scratch

MIN_REVISIT = 1000
SPLIT_BYTES = 4 << 20
MAX_TASKS = 50_000
LEVEL = 4
MAGIC = b"\x1f\x8b\x08"
DATE = "2020-01-01T00:00:00Z"
MANIFEST = "part int, file string, bytes long, records long"
RECORDS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, url string, file string, offset long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes that a candidate is tried with at first, and that are read at once.
_TRY = 4096
_READ = 1 << 20
#: The longest stored block of deflate.
STORED = 65_535


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary), digest, refers_to (null for responses).

    One join by digest; a digest that very many pages share is split by AQE, as both sides are stored or scanned.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    heads = rows.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    heads = checkpoint(heads.select(F.col("digest").alias("_digest"), "head"))
    refers = F.when(F.col("page_id").eqNullSafe(F.col("head")), None).otherwise(F.col("head"))
    return rows.join(heads, F.col("digest") == F.col("_digest"), "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member.  A revisit holds the HTTP header only, which says how long the payload is."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    if refers_to is None:
        block += payload
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{b32encode(digest).decode()}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, wbits=31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write(planned: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes an archive for each partition of plan()'s rows; the manifest (part, file, bytes, records), stored."""
    folder = folder or scratch(planned.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        fs, top = pafs.FileSystem.from_uri(folder)
        name, stream, size, records = f"{part:06d}-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                fs.create_dir(top, recursive=True)
                stream = fs.open_output_stream(f"{top}/{name}", compression=None)
            names = ("page_id", "url", "payload", "digest", "refers_to")
            for at in range(0, batch.num_rows, 256):
                part_of = batch.slice(at, 256)
                for row in zip(*(part_of.column(c).to_pylist() for c in names), strict=True):
                    member = record(*row)
                    stream.write(member)
                    size += len(member)
                    records += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([f"{folder}/{name}"]), "bytes": pa.array([size], pa.int64()), "records": pa.array([records], pa.int64())})

    # All rows of the manifest, one a file, meet in one task: if archives are written again after a loss each is there once, under its last name.
    return checkpoint(map_arrow(planned, run, MANIFEST).repartition(1))


class Window:
    """Bytes of a file from a place on, read as they are asked for; what lies before the place that is kept goes."""

    def __init__(self, stream, at: int):
        self.stream, self.size, self.at, self.held = stream, stream.size(), at, b""

    def get(self, a: int, b: int) -> bytes:
        """Bytes a to b, fewer at the file's end.  a must not lie before the place kept."""
        b = min(b, self.size)
        if self.at + len(self.held) < b:
            more = max(_READ, b - self.at - len(self.held))
            self.held += self.stream.read_at(min(more, self.size - self.at - len(self.held)), self.at + len(self.held))
        return self.held[a - self.at : b - self.at]

    def keep(self, at: int) -> None:
        if at - self.at > _READ:
            self.held, self.at = self.held[min(at - self.at, len(self.held)) :], at


def candidate(start: bytes) -> bool:
    """Whether bytes begin a gzip member (method deflate, no reserved flags) whose data begin a WARC record."""
    if start[:3] != MAGIC or len(start) < 18 or start[3] & 0xE0:
        return False
    try:
        return zlib.decompressobj(wbits=31).decompress(start, 16)[:5] == b"WARC/"
    except zlib.error:
        return False


def member(window: Window, at: int) -> tuple[bytes, int] | None:
    """Data of the member at `at` and where it ends; None if it is none (bad data, checksum or end of file)."""
    opener, out, pos = zlib.decompressobj(wbits=31), [], at
    while not opener.eof:
        blob = window.get(pos, pos + (_TRY if pos == at else 1 << 16))
        if not blob:
            return None
        try:
            out.append(opener.decompress(blob))
        except zlib.error:
            return None
        pos += len(blob) - len(opener.unused_data)
    return b"".join(out), pos


def chain(window: Window, at: int, least: int) -> list[tuple[int, bytes]] | None:
    """(offset, data) of the members from `at` on, each beginning where the one before ends, over more than `least` bytes or to the
    end of the file, and where the last ends (with no data); None if the chain breaks off."""
    out, pos = [], at
    while pos <= at + least and pos < window.size or not out:
        got = member(window, pos) if candidate(window.get(pos, pos + _TRY)) else None
        if got is None:
            return None
        out.append((pos, got[0]))
        pos = got[1]
    return [*out, (pos, b"")]


def members(stream, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of the members that begin in bytes start to stop.

    Bytes of a member's data can look like members themselves: an archive inside an archive, which deflate stores as it is.
    A stored block has 65535 bytes at most, so a chain of members that is longer, or ends with the file, is a real one.
    Where one ends another one has to begin: if none does, also behind the last one of the range, the file is damaged and ValueError is raised.
    """
    window, at, known = Window(stream, start), start, start == 0
    while at < min(stop, window.size):
        window.keep(at)
        if not known:
            blob = window.get(at, min(at + _READ, stop + len(MAGIC) - 1))
            found = blob.find(MAGIC)
            if found < 0:
                at += max(1, len(blob) - len(MAGIC) + 1)
                continue
            at += found
        got = chain(window, at, 0 if known else STORED)
        if got is None and known:
            raise ValueError(f"no record begins at byte {at}")
        if got is None:
            at += 1
            continue
        for offset, data in got[:-1]:
            if offset < stop:
                yield offset, data
        at, known = got[-1][0], True
    if known and stop <= at < window.size and member(window, at) is None:
        raise ValueError(f"no record begins at byte {at}")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest[: int(fields.get("content-length", 0))]


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every response and revisit record of the files, with payload (null in revisits) and where it stands.

    Files are cut into ranges, which are dealt evenly to at most MAX_TASKS tasks.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    rows = manifest.select("file", "bytes", starts.alias("start")).select("file", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("stop"))
    count = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0]
    rows = rows.repartition(max(1, min(count or 1, MAX_TASKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64())])
        out, held = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(r["file"])
                with fs.open_input_file(path) as stream:
                    for offset, data in members(stream, r["start"], r["stop"]):
                        fields, block = parse(data)
                        kind = fields.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if kind == "response":
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        else:
                            size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
                            digest, payload = b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(), None
                        out.append({"page_id": _page(fields.get("warc-record-id")), "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")), "payload_bytes": size, "payload_digest": digest, "payload": payload, "url": fields.get("warc-target-uri"), "file": r["file"], "offset": offset})
                        held += size
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return map_arrow(rows, run, RECORDS)
