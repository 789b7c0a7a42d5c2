"""Best-fit packing of documents into fixed token windows, under conflicts.

No bin holds two pieces of one source or of one cluster of duplicates. Pieces are dealt by
a hash to groups of about ``GROUP_PIECES``, each packed by one task: longest first, every
piece goes to the bin with the least room that still takes it. Bins are ordered by their
residual; the search starts at the first with room and goes on upwards, past bins whose
bitmaps have the piece's source or cluster, until the tightest compatible bin is found. Only
then a new bin opens. A source may hold any share of the documents: it then opens as many
bins as the rule demands, and no group grows.

Defined results: documents longer than a bin are cut into pieces of full length and a rest;
documents of length zero (or null) take a slot without room; null sources and clusters
conflict with nothing; rows that repeat an id are documents of their own; an empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolltally.llm.common import handover, named

CAPACITY = 4096
GROUP_PIECES = 8192
_SEARCH = 256


def word_length(text: Column) -> Column:
    """Words of a text; null has none."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return F.size(words).cast("long")


def text_cluster(text: Column) -> Column:
    """Cluster of texts that are equal but for case and white space; none for texts without words."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))
    return F.when(F.length(plain) > 0, F.xxhash64(plain))


class Bins:
    """Open bins in order of residual, each with bitmaps of its sources and clusters."""

    def __init__(self, n_sources: int, n_clusters: int, expected: int) -> None:
        self.words = (n_sources + 63) // 64, (n_clusters + 63) // 64
        self.sources = np.zeros((expected, max(1, self.words[0])), dtype=np.uint64)
        self.clusters = np.zeros((expected, max(1, self.words[1])), dtype=np.uint64)
        self.residual = np.zeros(expected, dtype=np.int64)
        self.number = np.zeros(expected, dtype=np.int64)  # the bin at each place of the order
        self.n = 0

    def _grow(self) -> None:
        for name in ("sources", "clusters"):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        self.residual = np.concatenate([self.residual, np.zeros_like(self.residual)])
        self.number = np.concatenate([self.number, np.zeros_like(self.number)])

    def tightest(self, length: int, source: int, cluster: int) -> int:
        """Place of the bin with the least room that fits and has no conflict, or -1."""
        place = int(np.searchsorted(self.residual[: self.n], length, "left"))
        while place < self.n:
            bins = self.number[place : min(place + _SEARCH, self.n)]
            conflict = np.zeros(len(bins), dtype=np.uint64)
            if source >= 0:
                conflict |= (self.sources[bins, source >> 6] >> np.uint64(source & 63)) & np.uint64(1)
            if cluster >= 0:
                conflict |= (self.clusters[bins, cluster >> 6] >> np.uint64(cluster & 63)) & np.uint64(1)
            free = np.flatnonzero(conflict == 0)
            if len(free):
                return place + int(free[0])
            place += len(bins)
        return -1

    def put(self, place: int, room: int, length: int, source: int, cluster: int) -> int:
        """Put a piece into the bin at ``place`` (a new one with ``room`` if -1); its number."""
        if place < 0:
            number = self.n
            if number == len(self.residual):
                self._grow()
            last, left = self.n, room - length
            self.n += 1
        else:
            number, last = int(self.number[place]), place
            left = int(self.residual[place]) - length
        # The bin moves down to its new place; those between move up by one.
        to = int(np.searchsorted(self.residual[:last], left, "left"))
        self.residual[to + 1 : last + 1] = self.residual[to:last].copy()
        self.number[to + 1 : last + 1] = self.number[to:last].copy()
        self.residual[to], self.number[to] = left, number
        if source >= 0:
            self.sources[number, source >> 6] |= np.uint64(1 << (source & 63))
        if cluster >= 0:
            self.clusters[number, cluster >> 6] |= np.uint64(1 << (cluster & 63))
        return number


def _codes(values: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """Small numbers for values, -1 for null."""
    encoded = values.combine_chunks().dictionary_encode()
    return encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), len(encoded.dictionary)


def _repeated_only(codes: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Only what occurs twice can conflict: other codes become -1."""
    counts = np.bincount(codes[codes >= 0], minlength=n) if n else np.zeros(0, dtype=np.int64)
    renumbered = np.full(n + 1, -1, dtype=np.int64)
    renumbered[:-1][counts > 1] = np.arange(int((counts > 1).sum()))
    return renumbered[codes], int((counts > 1).sum())


def pack_group(table: pa.Table, capacity: int) -> pa.Table:
    """Pack the pieces of one group."""
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("tie", "ascending"), ("piece", "ascending")])
    sources, n_sources = _repeated_only(*_codes(table.column("source")))
    clusters, n_clusters = _repeated_only(*_codes(table.column("cluster")))
    bins = Bins(n_sources, n_clusters, max(16, len(table) // 4))
    number = np.zeros(len(table), dtype=np.int64)
    used, slots = np.zeros(len(table) + 1, dtype=np.int64), np.zeros(len(table) + 1, dtype=np.int32)
    offset, slot = np.zeros(len(table), dtype=np.int64), np.zeros(len(table), dtype=np.int32)
    for i, length in enumerate(table.column("length").to_pylist()):
        source, cluster = int(sources[i]), int(clusters[i])
        k = bins.put(bins.tightest(length, source, cluster), capacity, length, source, cluster)
        number[i], offset[i], slot[i] = k, used[k], slots[k]
        used[k] += length
        slots[k] += 1
    out = {"doc_id": table.column("doc_id"), "piece": table.column("piece"), "start": table.column("start"), "length": table.column("length"), "group": table.column("group")}
    return pa.table(out | {"bin": pa.array(number), "slot": pa.array(slot), "offset": pa.array(offset), "source": table.column("source"), "cluster": table.column("cluster")})


def best_fit(docs: DataFrame, length: Column, cluster: Column, source: str = "source", doc_id: str = "doc_id", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: where it is (``group``, ``bin``, ``slot``, ``offset``) and what it is.

    ``piece`` counts the pieces of a document, ``start`` is where a piece begins in it. Only
    lengths and codes are shuffled, not texts; they are written first, as the number of
    groups follows from the number of pieces.
    """
    rows = docs.select(
        named(docs, doc_id).cast("long").alias("doc_id"),
        named(docs, source).cast("string").alias("source"),
        cluster.cast("long").alias("cluster"),
        F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("total"),
    )
    rows = handover(docs.sparkSession, rows.withColumn("tie", F.xxhash64("total", "source", "cluster")), "lengths")
    last_piece = f"greatest(total - 1, 0L) div {capacity}"
    n_pieces = rows.agg(F.sum(F.expr(f"1L + {last_piece}"))).first()[0] or 0
    # A long document would fill its group alone: its full pieces are spread like documents.
    pieces = rows.withColumn("piece", F.explode(F.expr(f"sequence(0L, {last_piece})")))
    pieces = pieces.withColumn("start", F.col("piece") * capacity).withColumn("length", F.least(F.col("total") - F.col("start"), F.lit(capacity).cast("long")))
    groups = max(1, -(-n_pieces // group_pieces))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "tie", "piece"), F.lit(groups)).cast("long"))
    schema = "doc_id long, piece long, start long, length long, group long, bin long, slot int, offset long, source string, cluster long"
    return dealt.drop("total").groupBy("group").applyInArrow(lambda t: pack_group(t, capacity), schema)
