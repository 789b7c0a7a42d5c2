"""Helpers that several corpus operators share: hand-over tables, word hashes, components."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.session import new_path

MASK = (1 << 64) - 1
CHUNK_BYTES = 1 << 20
_WORD_BASE = 0x9E3779B97F4A7C15
_BYTE_BASE = 0xD6E8FEB86659FD93

# Bytes that separate words: space and 0x09 to 0x0D.
SEPARATORS = bytes([32, 9, 10, 11, 12, 13])
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[list(SEPARATORS)] = False


# Whether Spark removes a query's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def handover(spark: SparkSession, df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` under the shared folder (or to ``path``) and read it back.

    This cuts the lineage: lost executors cost no recomputation of what is written. The
    shuffle files behind it, which nothing else refers to, go when it is written.
    """
    path = path or new_path(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def named(df: DataFrame, name: str) -> Column:
    """A column by its literal name, dots included."""
    return df["`" + name.replace("`", "``") + "`"]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a hand-over table that nothing will read again: what was made of it is written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers started from another folder import this package.

    A cluster has the package installed; this adds the place it was imported from.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """All columns inside one struct ``row`` beside ``more``, so that no names can clash."""
    return df.select(F.struct(*(named(df, c).alias(c) for c in df.columns)).alias("row"), *(v.alias(k) for k, v in more.items()))


def row_key(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    """Key of a row for joining results back; rows share it if id and text are the same."""
    return F.xxhash64(named(df, doc_id), named(df, text))


def local_path(uri: str) -> str | None:
    """The mounted path behind a URI, or None for a remote store."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return unquote(parts.path)
    return None


class SharedFiles:
    """Binary files in the shared folder, opened from inside tasks."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        mounted = local_path(folder)
        if mounted is not None:
            self.fs, self.root = fs.LocalFileSystem(), mounted
        else:
            self.fs, self.root = fs.FileSystem.from_uri(folder)

    def make(self) -> None:
        self.fs.create_dir(self.root, recursive=True)

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def create(self, name: str):
        return self.fs.open_output_stream(self.path(name), compression=None)

    def open(self, name: str):
        return self.fs.open_input_file(self.path(name))

    def size(self, name: str) -> int:
        return self.fs.get_file_info(self.path(name)).size

    def names(self) -> list[str]:
        from pyarrow import fs

        return sorted(x.base_name for x in self.fs.get_file_info(fs.FileSelector(self.root)) if x.is_file)


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers stay for later stages, whose memory it is taken from."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as long as was asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        n_kept = -(-n // 65536) * 65536
        while len(self.up) < n:
            have, more = len(self.up), n_kept - len(self.up)
            self.up = np.concatenate([self.up, self.up[:more] * np.uint64(pow(self.base, have, 1 << 64))])
            self.down = np.concatenate([self.down, self.down[:more] * np.uint64(pow(self.inverse, have, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS: dict[int, Powers] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS:
        _POWERS[base] = Powers(base)
    return _POWERS[base].get(n)


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """Running Rabin-Karp sums: with ``substring_hash`` every range's hash costs O(1)."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash of each range; equal ranges have equal hashes wherever they start."""
    return (prefix[end] - prefix[start]) * powers(base, len(prefix))[1][start]


def window_hash(word_hashes: np.ndarray, length: int, base: int = _WORD_BASE) -> np.ndarray:
    """Rolling hash of every window of ``length`` consecutive values."""
    n = len(word_hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    prefix = prefix_hash(word_hashes, base)
    return mix((prefix[length:] - prefix[:n]) * powers(base, n)[1])


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``[first, last)`` of a text column with their UTF-8 bytes and byte offsets.

    A chunk holds about ``limit`` bytes, or one longer text. Nulls are empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; a word ends at a separator or where its text ends."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = IN_WORD[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    borders = offsets[:-1][offsets[:-1] < n]
    start[borders] = inside[borders]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    before = borders[borders > 0] - 1
    end[before] = inside[before]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_WORD_BASE))


BYTE_VALUES = _byte_values()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the offsets of each text's words among them.

    Long texts are hashed piece by piece, cut at separators, so that memory beyond the
    result stays that of one piece unless a single word is longer.
    """
    starts, ends = word_spans(data, offsets)
    hashes = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK_BYTES, "right")))
        low, high = starts[first], ends[last - 1]
        prefix = prefix_hash(BYTE_VALUES[data[low:high]], _BYTE_BASE)
        part = substring_hash(prefix, starts[first:last] - low, ends[first:last] - low, _BYTE_BASE)
        hashes[first:last] = mix(part + (ends[first:last] - starts[first:last]).astype(np.uint64))
        first = last
    return hashes, np.searchsorted(starts, offsets)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components: ``node`` and the smallest node it is connected with, ``root``.

    ``edges`` has longs ``u`` and ``v``. Stars are contracted in turns (large and small
    star), each turn a pair of shuffles over the edges with map-side minima; a turn's
    result is a written table. Only two sums per turn reach the driver. Nodes without
    edges do not appear; loops and repeated edges do no harm.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = None
    while True:
        edges = handover(spark, _small_star(_large_star(edges)), "stars")
        print_of = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(print_of) == state:
            break
        state = tuple(print_of)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(smallest, "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(smallest.select("u", F.col("m"))).distinct()
