"""Token ids in bit-packed files with random access.

A file holds ids of ``bits`` bits each, the fewest that the vocabulary needs, in blocks of
``BLOCK_IDS`` ids that start on a byte. Behind the blocks stand the byte offset of each block,
the id (and whether it is null) of each document and the position of its first token; a
fixed trailer says where these are. Any range of tokens is read from the blocks that hold
it, and unpacked by array operations.

Files are written in ascending order of document ids, a file per range, nulls first, rows
with equal ids in the order of a hash of their texts. Null and empty texts have just the
end id. Extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolltally.llm.common import SharedFiles, handover, named
from rolltally.llm.encoding import encoder
from rolltally.session import new_path

MAGIC = b"TOKBITS1"
BLOCK_IDS = 1 << 14
READ_DOCS = 2000
_TRAILER = struct.Struct("<8sIIQQQQ")


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits one after another, low bits first, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for first in range(0, len(ids), 1 << 16):  # a multiple of 8 ids fills whole bytes
        part = ids[first : first + (1 << 16)].astype(np.uint32)
        flags = (part[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
        out.append(np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes, bits: int, n: int, first: int = 0) -> np.ndarray:
    """``n`` ids from the ``first`` on."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}")[first : first + n].astype(np.uint32)
    padded = data + b"\0" * 8
    words = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    at = np.arange(first, first + n, dtype=np.int64) * bits
    return ((words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """Writes one file; holds one block and the tables of documents."""

    def __init__(self, stream, bits: int) -> None:
        self.stream, self.bits, self.at = stream, bits, 0
        self.blocks, self.doc_ids, self.nulls, self.starts = [], [], [], [0]
        self.open: list[np.ndarray] = []
        self.open_ids = 0

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids))
        self.open.append(ids)
        self.open_ids += len(ids)
        if self.open_ids >= 8 * BLOCK_IDS:
            self._blocks(final=False)

    def _blocks(self, final: bool) -> None:
        ids = np.concatenate(self.open) if self.open else np.zeros(0, dtype=np.uint32)
        whole = len(ids) if final else len(ids) // BLOCK_IDS * BLOCK_IDS
        for first in range(0, whole, BLOCK_IDS):
            self.blocks.append(self.at)
            self._write(pack(ids[first : min(first + BLOCK_IDS, whole)], self.bits))
        self.open, self.open_ids = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._blocks(final=True)
        tables = self.at
        for values, kind in ((self.blocks, "<u8"), (self.starts, "<u8"), (self.doc_ids, "<i8"), (self.nulls, "u1")):
            self._write(np.array(values, dtype=kind).tobytes())
        self._write(_TRAILER.pack(MAGIC, self.bits, BLOCK_IDS, len(self.blocks), len(self.doc_ids), self.starts[-1], tables))
        self.stream.close()


class Reader:
    """Random access to one file."""

    def __init__(self, stream, size: int) -> None:
        self.stream = stream
        magic, self.bits, self.block_ids, self.n_blocks, self.n_docs, self.n_ids, tables = _TRAILER.unpack(self._read(size - _TRAILER.size, _TRAILER.size))
        if magic != MAGIC:
            raise ValueError("Not a file of packed token ids.")
        self.tables = tables
        self.at_starts = tables + 8 * self.n_blocks
        self.at_ids = self.at_starts + 8 * (self.n_docs + 1)
        self.at_nulls = self.at_ids + 8 * self.n_docs

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def documents(self, first: int, last: int) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents ``[first, last)`` and where their tokens start, with the end."""
        ids = np.frombuffer(self._read(self.at_ids + 8 * first, 8 * (last - first)), dtype="<i8")
        nulls = np.frombuffer(self._read(self.at_nulls + first, last - first), dtype="u1")
        starts = np.frombuffer(self._read(self.at_starts + 8 * first, 8 * (last - first + 1)), dtype="<u8").astype(np.int64)
        return [None if null else i for i, null in zip(ids.tolist(), nulls.tolist())], starts

    def tokens(self, first: int, last: int) -> np.ndarray:
        """The ids ``[first, last)``, from the blocks that hold them."""
        if last <= first:
            return np.zeros(0, dtype=np.uint32)
        low, high = first // self.block_ids, (last - 1) // self.block_ids + 1
        offsets = np.frombuffer(self._read(self.tables + 8 * low, 8 * (high - low)), dtype="<u8").tolist()
        out = []
        for k, at in enumerate(offsets, low):
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            data = self._read(at, (n * self.bits + 7) // 8)
            skip = max(0, first - k * self.block_ids)
            out.append(unpack(data, self.bits, min(n, last - k * self.block_ids) - skip, skip))
        return np.concatenate(out)


def write_packed(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Encode and write all documents; returns the list of files.

    Columns ``folder``, ``part`` (their order), ``file``, ``n_docs``, ``n_ids``. A task writes
    its file under a name of its own and reports it when it is whole, so what a lost or
    repeated attempt leaves behind is not on the list.
    """
    folder = new_path(spark, "packed-tokens")
    SharedFiles(folder).make()

    def write(batches):
        files, writer, name = SharedFiles(folder), None, None
        for batch in batches:
            if not len(batch):
                continue
            code = encoder(tokenizer)
            if writer is None:
                part = TaskContext.get().partitionId()
                name = f"part-{part:06d}-{uuid4().hex}.tok"
                writer = Writer(files.create(name), bits_for(max(code.vocabulary, end_id + 1)))
            end = np.array([end_id], dtype=np.uint32)
            for first in range(0, len(batch), 64):
                rows = batch.slice(first, 64)
                for doc_id, ids in zip(rows.column(0).to_pylist(), code.encode(rows.column(1).to_pylist())):
                    writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"folder": [folder], "part": [part], "file": [name], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.starts[-1]]})

    source = docs.select(named(docs, "doc_id").cast("long").alias("doc_id"), named(docs, "text").cast("string").alias("text"))
    ordered = source.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return handover(spark, ordered.select("doc_id", "text").mapInArrow(write, "folder string, part long, file string, n_docs long, n_ids long"), "packed-files")


def read_packed(files: DataFrame, digest: bool = False) -> DataFrame:
    """All documents of written files: ``doc_id``, ``start``, ``n_tokens``, and their ids.

    ``start`` counts the ids of all documents before. With ``digest`` the ids are replaced by
    ``ids_crc32``, the checksum of them as 32-bit little-endian integers. Tasks read ranges of
    ``READ_DOCS`` documents.
    """

    def read(batches):
        for batch in batches:
            for folder, file, base, first, last in zip(*batch.to_pydict().values()):
                shared = SharedFiles(folder)
                with shared.open(file) as stream:
                    reader = Reader(stream, shared.size(file))
                    ids, starts = reader.documents(first, last)
                    low = 0
                    while low < len(ids):  # bounded runs of tokens, or one document
                        high = max(low + 1, int(np.searchsorted(starts, starts[low] + (1 << 20), "right")) - 1)
                        tokens = reader.tokens(int(starts[low]), int(starts[high]))
                        parts = [tokens[a:b] for a, b in zip((starts[low:high] - starts[low]).tolist(), (starts[low + 1 : high + 1] - starts[low]).tolist())]
                        last_column = pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()) if digest else pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[low:high], pa.int64()), pa.array(starts[low:high] + base), pa.array(np.diff(starts[low : high + 1])), last_column],
                            names=["doc_id", "start", "n_tokens", kind.split()[0]],
                        )
                        low = high

    kind = "ids_crc32 long" if digest else "ids array<int>"
    # One row per file: the running sum over the list of files is small.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    ranges = based.withColumn("first", F.explode(F.expr(f"sequence(0L, n_docs - 1, {READ_DOCS}L)")))
    units = ranges.select("folder", "file", "base", "first", F.least(F.col("first") + READ_DOCS, "n_docs").alias("last"))
    return units.repartition("file", "first").mapInArrow(read, f"doc_id long, start long, n_tokens long, {kind}")
