"""WARC archives: deduplicating writer and splittable reader.

Every record is a gzip member of its own. Tasks of the reader take byte ranges of the files
and scan them for the first bytes of a member; a candidate counts if the first bytes it
decodes are those of a WARC record, and a range owns the records that start inside it, to
whose end it reads on. So files split at any byte without an index.

Writer: payloads are equal if their SHA-1 and length are; of equal payloads of at least
``min_bytes`` the one with the largest id is a response, the others are revisit records that
name it and have no payload. Null payloads are empty. Null urls are left out. Rows without
an id are responses of their own with no id in the record. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Sequence
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.llm.common import SharedFiles, handover, named
from rolltally.session import new_path

MIN_REVISIT_BYTES = 1000
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 16
FILE_BYTES = 1 << 28
VERSION = b"WARC/1.1"
_MEMBER = re.compile(rb"\x1f\x8b\x08")


def record_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    head += b"Content-Length: %d\r\n\r\n" % len(block)
    code = zlib.compressobj(6, zlib.DEFLATED, 31)
    return code.compress(head + block + b"\r\n\r\n") + code.flush()


def record_of_page(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields += [("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"), ("Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-ID", str(refers_to))]
    return record_bytes(fields, payload if refers_to is None else b"")


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id``, ``url``, ``payload`` and ``refers_to`` (null for responses).

    Groups are counted by digest with map-side sums; only digests that occur twice are joined
    back, and a digest that very many pages share is split by the adaptive join.
    """
    payload = F.coalesce(named(pages, "html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(named(pages, "page_id").cast("long").alias("page_id"), named(pages, "url").cast("string").alias("url"), payload.alias("payload"))
    # Small payloads look up keys of their own that nothing has: as nulls they would meet in one task.
    alone = F.concat(F.lit("small:"), F.xxhash64("page_id", "url", "payload").cast("string"))
    large = F.length("payload") >= min_bytes
    rows = rows.withColumn("digest", F.when(large, F.concat_ws(":", F.sha1("payload"), F.length("payload"))).otherwise(alone))
    shared = rows.where(large & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = rows.join(shared, "digest", "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id") < F.col("original"), F.col("original")).alias("refers_to"))


def write_warc(spark: SparkSession, pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages; returns the files (``folder``, ``file``, ``bytes``, ``records``).

    Tasks begin a new file beyond ``file_bytes``. Only files that were closed by a task that
    ended well are listed.
    """
    folder = new_path(spark, "warc")
    SharedFiles(folder).make()

    def write(batches):
        shared = SharedFiles(folder)
        stream, name, size, records = None, None, 0, 0
        info = record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")

        def closed():
            stream.close()
            return pa.RecordBatch.from_pydict({"folder": [folder], "file": [name], "bytes": [size], "records": [records]})

        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(len(batch)):
                if stream is None:
                    name, size, records = f"part-{TaskContext.get().partitionId():06d}-{uuid4().hex}.warc.gz", 0, 0
                    stream = shared.create(name)
                    stream.write(info)
                    size += len(info)
                data = record_of_page(*(c[i].as_py() for c in columns))
                stream.write(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    yield closed()
                    stream = None
        if stream is not None:
            yield closed()

    return handover(spark, with_revisits(pages, min_bytes).mapInArrow(write, "folder string, file string, bytes long, records long"), "warc-files")


class Source:
    """A window on a file that reads on as far as a record needs."""

    def __init__(self, stream, start: int, size: int) -> None:
        self.stream, self.start, self.size = stream, start, size
        self.data = bytearray()

    def upto(self, end: int) -> None:
        """Have the bytes before ``end``."""
        end = min(end, self.size)
        have = self.start + len(self.data)
        if end > have:
            self.stream.seek(have)
            data = self.stream.read(end - have)
            if not data:
                raise ValueError("The archive is shorter than listed.")
            self.data += data

    def forget(self, before: int) -> None:
        if before - self.start > RANGE_BYTES // 2:
            del self.data[: before - self.start]
            self.start = before


def _member(source: Source, at: int) -> tuple[bytes, int] | None:
    """The record in the gzip member at ``at`` and where the member ends, if it is one."""
    code = zlib.decompressobj(31)
    out, position = bytearray(), at
    while not code.eof:
        source.upto(position + READ_BYTES)
        part = bytes(source.data[position - source.start : position - source.start + READ_BYTES])
        if not part:
            return None
        try:
            out += code.decompress(part)
        except zlib.error:
            return None
        if len(out) >= len(VERSION) and not out.startswith(b"WARC/"):
            return None
        position += len(part)
    end = position - len(code.unused_data)
    return (bytes(out), end) if out.startswith(b"WARC/") else None


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields, rest[: int(fields["content-length"])]


def sha1_of(field: str | None) -> str | None:
    """A SHA-1 in lower-case hex, however a digest field spells it; null for other digests or none."""
    name, _, value = (field or "").partition(":")
    if name.strip().lower() != "sha1":
        return None
    value = value.strip()
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def payload_of(fields: dict[str, str], block: bytes, http_heads: bool) -> bytes:
    """The block, or what stands behind the head of an HTTP message in it."""
    if http_heads and fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def records_in(stream, start: int, end: int, size: int):
    """Records whose members start in ``[start, end)``: offset, fields, block."""
    source, at = Source(stream, start, size), start
    while at < end:
        source.upto(min(end + 2, at + READ_BYTES))
        found = _MEMBER.search(source.data, at - source.start)
        have = source.start + len(source.data)
        if found is None:
            if have >= min(end + 2, size):
                return
            at = max(at, have - 2)
            continue
        at = source.start + found.start()
        if at >= end:
            return
        record = _member(source, at)
        if record is None:
            at += 1
            continue
        data, after = record
        yield (at, *parse_record(data))
        # The next member starts where this one ends.
        source.forget(after)
        at = after


def read_warc(
    files: DataFrame, range_bytes: int = RANGE_BYTES, keep_payload: bool = True, types: Sequence[str] | None = ("response", "revisit"), http_heads: bool = True
) -> DataFrame:
    """Records of the files (``folder``, ``file``, ``bytes``): position, type, ids, payload size and digest, and payload.

    Archives of other writers are read too: record ``types`` to keep (all if None), digests
    in hex or base 32 or none, HTTP messages whose heads are passed over unless
    ``http_heads`` is off. Sizes and digests of responses are computed from what was read
    and must agree with the record's fields where it has them and is not truncated; those of
    other records are the fields'. ``keep_payload=False`` leaves the payload null.
    """

    def read(batches):
        names = ["file", "offset", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for folder, file, size, start in zip(*batch.to_pydict().values(), strict=True):
                shared, rows, held = SharedFiles(folder), [], 0
                with shared.open(file) as stream:
                    for at, fields, block in records_in(stream, start, min(start + range_bytes, size), size):
                        kind = fields.get("warc-type", "")
                        if types is not None and kind not in types:
                            continue
                        block = payload_of(fields, block, http_heads)
                        digest, n = sha1_of(fields.get("warc-payload-digest")), int(fields.get("payload-length", len(block)))
                        if kind == "response":
                            actual = hashlib.sha1(block).hexdigest()
                            if "warc-truncated" not in fields and (n != len(block) or digest not in (None, actual)):
                                raise ValueError(f"Damaged record at {at} of {file}")
                            digest, n = actual, len(block)
                        number = lambda key: int(fields[key]) if key in fields else None
                        rows.append((file, at, kind, number("page-id"), fields.get("warc-target-uri"), n, digest, number("refers-to-page-id"), block if keep_payload else None))
                        held += len(block) if keep_payload else 0
                        if held > RANGE_BYTES or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    ranges = files.select("folder", "file", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {range_bytes}L)")).alias("start"))
    schema = "file string, offset long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return ranges.repartition("file", "start").mapInArrow(read, schema)
