"""WARC archives: one gzip member per record, and a reader that splits files anywhere.

A reading task owns the records that start in its byte range. It looks for gzip magic, takes a
candidate only if it and what follows it decode to WARC records, and goes on member by member.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comeback.llm.common import scratch, staged

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
BLOCK = 1 << 16
STORED = 65535
BATCH_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP header of its page and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Pages with size, digest and, for repeated payloads, the page they refer to.

    The first page of each group comes from a map-side combined minimum. The join back is left to
    the adaptive skew join, which splits the partition of a payload that many pages share; the
    payloads of revisits are dropped there.
    """
    source = pages.select(
        pages["page_id"].cast("bigint").alias("page_id"),
        pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"),
    ).select("*", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("bigint").alias("size"))
    groups = source.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = groups.where("n > 1 and first is not null").select("digest", "first")
    joined = source.join(repeated.hint("merge"), "digest", "left")
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    refers = F.when(F.col("first").isNotNull() & other, F.col("first"))
    return joined.select(
        "page_id", "url", "digest", "size", refers.alias("refers_to"), F.when(refers.isNull(), F.col("html")).alias("html")
    )


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 100) -> DataFrame:
    """Writes a record for every row of ``pages`` (page_id, url, html); returns the files' list.

    Of pages with equal payloads of ``min_bytes`` or more, the smallest page_id is a response and
    the others are revisits of it (rows that repeat that page_id are responses too; a null page_id
    is never referred to). A null html is an empty payload, a null url is about:blank; other
    columns are not looked at. Each task attempt writes a file of its own name, and only files of
    attempts that ended well are listed, so a lost executor leaves no half-written archive behind.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    rows = with_revisits(pages, min_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, sink, size = "", None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    files, base = pyarrow.fs.FileSystem.from_uri(folder)
                    files.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, sink = f"{folder}/{name}", files.open_output_stream(f"{base}/{name}", compression=None)
                payload = (row["html"] or "").encode()
                record = member(row["page_id"], row["url"], payload, row["digest"], row["size"], row["refers_to"])
                sink.write(record)
                size += len(record)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size]})

    return staged(rows.mapInArrow(write, "path string, size bigint"), "warc-files")


class _Window:
    """Bytes of a seekable file from ``base`` on, read in blocks as they are asked for."""

    def __init__(self, source, base: int):
        self.source, self.base, self.size = source, base, source.size()
        self.held = b""

    def more(self) -> bool:
        self.source.seek(self.base + len(self.held))
        got = self.source.read(BLOCK)
        self.held += got
        return bool(got)

    def starts(self, at: int, prefix: bytes) -> bool:
        while len(self.held) < at - self.base + len(prefix) and self.more():
            pass
        return self.held.startswith(prefix, at - self.base)

    def forget(self, at: int) -> None:
        """Drop what lies before ``at``, now and then."""
        if at - self.base > 4 * BLOCK:
            self.held, self.base = self.held[at - self.base :], at

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The WARC record in the gzip member at ``at`` and where the member ends."""
        if not self.starts(at, MAGIC):
            return None
        unpack = zlib.decompressobj(31)
        out: list[bytes] = []
        fed, known = at - self.base, b""
        while True:
            if fed == len(self.held) and not self.more():
                return None
            try:
                piece = unpack.decompress(self.held[fed : fed + BLOCK])
            except zlib.error:
                return None
            fed = min(len(self.held), fed + BLOCK)
            out.append(piece)
            if len(known) < len(VERSION):
                known += piece[: len(VERSION) - len(known)]
                if not VERSION.startswith(known):
                    return None
            if unpack.eof:
                body = b"".join(out)
                return (body, self.base + fed - len(unpack.unused_data)) if body.startswith(VERSION) else None


def _records(source, start: int, end: int) -> Iterator[bytes]:
    """Decoded members that start in [start, end) of a seekable file.

    A payload may hold an archive of its own. Deflate keeps it as it is in stored blocks at most,
    whose headers interrupt it every 65,535 bytes; so a candidate counts if whole members follow
    it for longer than that, or up to the end of the file.
    """
    window = _Window(source, start)
    at, end = start, min(end, window.size)

    def follows(low: int) -> bool:
        here = low
        while here < window.size and here - low <= STORED:
            found = window.member(here)
            if found is None:
                return False
            here = found[1]
        return True

    while at < end and not (window.starts(at, MAGIC) and follows(at)):
        if at == 0:
            raise ValueError("the file doesn't start with a WARC record")
        place = window.held.find(MAGIC, at + 1 - window.base)
        if place >= 0:
            at = window.base + place
        else:
            at = max(at + 1, window.base + len(window.held) - len(MAGIC) + 1)
            if not window.more() and at + len(MAGIC) > window.size:
                return
        window.forget(at)
    while at < end:
        found = window.member(at)
        if found is None:
            raise ValueError(f"no whole WARC record at byte {at}")
        yield found[0]
        at = found[1]
        window.forget(at)


def parsed(record: bytes) -> dict:
    """Fields of a decoded record; checks the payload of a response against its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda name: (lambda t: None if t in (None, "none") else int(t))((re.search(r"<urn:page:(.*)>", fields.get(name, "")) or [None, None])[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    return {
        "page_id": page("WARC-Record-ID"),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": page("WARC-Refers-To"),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


FIELDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def read_archives(files: DataFrame, split_bytes: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """One row per record of the files (path, size); each byte range is a task of its own.

    An empty list of files gives no rows. A file that is no chain of gzip members raises.
    """
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))
    ranges = files.where("size > 0").select("path", F.explode(starts).alias("start"))
    tasks = max(1, ranges.count())
    ranges = ranges.repartitionByRange(tasks, "path", "start")
    kept = FIELDS if payloads else FIELDS.remove(FIELDS.get_field_index("payload"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found, held = [], 0
                system, path = pyarrow.fs.FileSystem.from_uri(row["path"])
                with system.open_input_file(path) as source:
                    for record in _records(source, row["start"], row["start"] + split_bytes):
                        fields = parsed(record)
                        if not payloads:
                            del fields["payload"]
                        found.append(fields)
                        held += len(record) if payloads else 300
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(found, schema=kept)
                            found, held = [], 0
                yield pa.RecordBatch.from_pylist(found, schema=kept)

    names = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
    return ranges.mapInArrow(read, names + (", payload binary" if payloads else ""))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives of ``pages``, read back, without the payloads."""
    return read_archives(write_archives(pages), payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
