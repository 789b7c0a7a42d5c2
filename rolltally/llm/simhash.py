"""Near-duplicate documents by SimHash fingerprints, found with pivot distance tables.

Every distinct fingerprint has a row in a table of Hamming distances to many reference
fingerprints (pivots). Pivots come in pairs that agree on one block of bits and are
opposite on all others, so that half the sum of the two distances is the distance inside
the block. Two fingerprints that differ in at most two bits agree on at least two of four
blocks, so they have the same block distances there: these are the keys under which
candidates meet. Within a key, pairs are discarded by the largest difference of their
coordinates, and the survivors are verified bit by bit.

Defined results: a null or empty text has fingerprint zero, which is linked like any other;
null ids count last when a group's smallest id is sought; rows that repeat an id stay rows
of the result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolltally.llm.common import components, handover, named, packed, row_key

BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
# A key with more fingerprints than this is compared block of rows by block of rows.
GROUP_ROWS = 2048
NO_ID = -(1 << 63)


def references(patterns: int = 8) -> np.ndarray:
    """Reference fingerprints: per block and pattern one with zeros elsewhere, one with ones."""
    block = (1 << BLOCK_BITS) - 1
    found = []
    for b in range(BLOCKS):
        for p in range(patterns):
            # Pattern p sets the bits of a block whose index, times an odd step, falls low.
            bits = sum(1 << i for i in range(BLOCK_BITS) if ((i * (2 * p + 1) + p * p) % BLOCK_BITS) < BLOCK_BITS // 2 - (p % 3))
            low = bits << (b * BLOCK_BITS)
            found += [low, low | (((1 << 64) - 1) ^ (block << (b * BLOCK_BITS)))]
    return np.array(found, dtype=np.uint64)


def distance_table(fingerprints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each pivot."""
    return np.bitwise_count(fingerprints[:, None] ^ pivots[None, :]).astype(np.int16)


def block_keys(table: np.ndarray) -> np.ndarray:
    """Keys of each fingerprint: for every two blocks, their distances inside the blocks."""
    patterns = table.shape[1] // (2 * BLOCKS)
    inside = (table[:, 0::2] + table[:, 1::2] - (64 - BLOCK_BITS)) // 2
    inside = inside.reshape(len(table), BLOCKS, patterns).astype(np.uint64)
    packed_blocks = np.zeros((len(table), BLOCKS), dtype=np.uint64)
    for p in range(patterns):
        packed_blocks = packed_blocks * np.uint64(BLOCK_BITS + 1) + inside[:, :, p]
    keys = []
    for a in range(BLOCKS):
        for b in range(a + 1, BLOCKS):
            pair = np.uint64(len(keys) + 1)
            apart = np.uint64(int(pair) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
            keys.append((packed_blocks[:, a] * np.uint64(0x9E3779B97F4A7C15)) ^ (packed_blocks[:, b] + apart))
    return np.stack(keys, axis=1) if len(table) else np.zeros((0, 6), dtype=np.uint64)


def text_fingerprint(text: str | None) -> int:
    """SimHash of the 3-word shingles of a text, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= 3:
        hashes = [xxh64_intdigest(joined, 42)]
    else:
        starts = [0, *(ends[:-3] + 1).tolist()]
        hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[2:].tolist())]
    counts = np.zeros(64, dtype=np.int64)
    for first in range(0, len(hashes), 65536):
        part = np.array(hashes[first : first + 65536], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row_key`` and ``fp``, the fingerprint as a signed long."""

    def scan(batches):
        for batch in batches:
            fps = np.fromiter((text_fingerprint(t) for t in batch.column(1).to_pylist()), dtype=np.uint64, count=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "row_key", "fp"])

    source = docs.select(named(docs, "doc_id").cast("long").alias("doc_id"), named(docs, "text").cast("string").alias("text"), row_key(docs).alias("row_key"))
    return source.mapInArrow(scan, "doc_id long, row_key long, fp long")


def _keyed(distinct: DataFrame, patterns: int) -> DataFrame:
    def scan(batches):
        pivots = references(patterns)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            keys = block_keys(distance_table(fps.view(np.uint64), pivots)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fps, keys.shape[1])), pa.array(keys.ravel())], names=["fp", "key"])

    return distinct.select("fp").mapInArrow(scan, "fp long, key long")


def _close_pairs(fps, table, group, side, limit):
    """Positions of verified pairs among rows sorted by group: by distance in the order."""
    n = len(fps)
    at = np.arange(n)
    for step in range(1, n):
        at = at[at + step < n]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return
        other = at + step
        near = np.abs(table[at] - table[other]).max(axis=1) <= limit
        near &= (side[at] != side[other]) | (side[at] < 0)
        a, b = at[near], other[near]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= limit
        yield a[near], b[near]


def _stars(n: int, pairs) -> np.ndarray:
    """Smallest position connected with each position."""
    root = np.arange(n)
    pairs = list(pairs)
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    return root


def _link_groups(batches, limit: int, patterns: int):
    """From rows sorted by (key, sub): edges that connect what is linked within each group."""
    pivots = references(patterns)

    def link(rows):
        fps = rows["fp"].view(np.uint64)
        new = np.ones(len(fps), dtype=bool)
        new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["sub"][1:] != rows["sub"][:-1])
        root = _stars(len(fps), _close_pairs(fps, distance_table(fps, pivots), np.cumsum(new), rows["side"], limit))
        moved = root != np.arange(len(fps))
        return pa.RecordBatch.from_arrays([pa.array(rows["fp"][moved]), pa.array(rows["fp"][root[moved]])], names=["u", "v"])

    held = None
    for batch in batches:
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sub", "side", "fp")}
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
        if not len(rows["fp"]):
            continue
        open_group = (rows["key"] == rows["key"][-1]) & (rows["sub"] == rows["sub"][-1])
        cut = int(np.argmax(open_group))
        held = {c: v[cut:] for c, v in rows.items()}
        for first, last in _group_cuts(rows, cut):
            yield link({c: v[first:last] for c, v in rows.items()})
    if held is not None:
        yield link(held)


def _group_cuts(rows, end: int, size: int = 8192):
    """Ranges of about ``size`` rows that end where a group ends."""
    new = np.flatnonzero((rows["key"][1:end] != rows["key"][: end - 1]) | (rows["sub"][1:end] != rows["sub"][: end - 1])) + 1 if end > 1 else np.zeros(0, dtype=np.int64)
    first = 0
    while first < end:
        later = new[np.searchsorted(new, first + size) :]
        last = int(later[0]) if len(later) else end
        yield first, last
        first = last


def links(fps: DataFrame, limit: int = 2, patterns: int = 8, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (``u``, ``v``) between distinct fingerprints that connect all linked ones.

    Not every link is a row, but whatever a path of links connects, a path of rows does.
    Keys that many fingerprints share are cut into blocks of rows, and each pair of blocks
    is a group of its own: no group is larger than twice ``group_rows``, on average one.
    """
    if limit > BLOCKS - 2:
        raise ValueError(f"Four blocks find at most {BLOCKS - 2} differing bits.")
    keyed = _keyed(fps.select("fp").distinct(), patterns)
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = keyed.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") * 2 / F.lit(group_rows)).cast("int"))
    rows = rows.withColumn("part", F.when(F.col("n") <= group_rows, F.lit(-1)).otherwise(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")))
    rows = rows.withColumn("mate", F.explode(F.when(F.col("part") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    low, high = F.least("part", "mate"), F.greatest("part", "mate")
    rows = rows.select(
        "key",
        F.when(F.col("part") < 0, F.lit(-1).cast("long")).otherwise(low.cast("long") * F.col("parts") + high).alias("sub"),
        # Within a pair of different blocks, only rows of different blocks are compared.
        F.when(F.col("part") == F.col("mate"), F.lit(-1)).otherwise(F.col("part")).alias("side"),
        "fp",
    )
    ordered = rows.repartition("key", "sub").sortWithinPartitions("key", "sub")
    return ordered.mapInArrow(lambda batches: _link_groups(batches, limit, patterns), "u long, v long")


def near_duplicates(spark: SparkSession, docs: DataFrame, limit: int = 2, patterns: int = 8) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` and ``row_key`` of every row.

    ``component_id`` is the smallest id that links lead to, the row's own included. Copies
    meet in one fingerprint before anything is compared.
    """
    marked = handover(spark, fingerprints(docs), "fingerprints")
    distinct = handover(spark, marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    grouped = components(spark, links(distinct, limit, patterns))
    rooted = distinct.join(grouped, distinct["fp"] == grouped["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "row_key")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, limit: int = 2, patterns: int = 8) -> DataFrame:
    """The documents without near-duplicates: of each group the one with the smallest id.

    Of rows that repeat a kept id, one stays. Documents without an id stay only where their
    group has no id at all, one per fingerprint.
    """
    marked = near_duplicates(spark, docs, limit, patterns)
    first = marked.where("doc_id <=> component_id").groupBy(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.when(F.col("doc_id").isNull(), F.col("fingerprint")).alias("alone")
    )
    kept = first.agg(F.min("row_key").alias("key")).select("k", "key")
    rows = packed(docs, k=F.coalesce(named(docs, "doc_id").cast("long"), F.lit(NO_ID)), key=row_key(docs))
    # The join leaves equal rows side by side, so that numbering them takes no exchange.
    numbered = rows.join(kept, ["k", "key"], "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("k", "key").orderBy("key")))
    return numbered.where("nth = 1").select("row.*")
