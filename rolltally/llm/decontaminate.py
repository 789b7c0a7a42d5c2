"""Documents that hold passages of benchmark items, up to a share of edited words.

Texts and items are sequences of lower-case words (A-Z only). A document is contaminated by
an item of n words if some part of it is at most ``floor((1 - similarity) * n)`` word edits
away from it; items of fewer than ``FUZZY_WORDS`` words must occur unchanged.

Windows as long as the item are taken wherever a run of the item's words stands that k edits
leave intact in one of k + 1 segments, and shifted by up to k words. Each window is embedded
by the random walk of Chakraborty, Goldenberg and Koucky, which turns edits into few
differing positions; bit-sampling tables over several walks pass a window if all sampled
positions of one table agree with the item's embedding. The number of tables follows from
the target recall. What passes is verified exactly by a bit-parallel search.

Defined results: null and empty texts are clean, null and empty items match nothing, equal
items match alike, extra columns are not read, rows that repeat are rows of the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolltally.llm.common import mix, named, packed, row_key, text_chunks, window_hash, word_hashes

FUZZY_WORDS = 8
SIMILARITY = 0.8
# Items are sent to the tasks in blocks of at most about so many bytes.
BLOCK_BYTES = 32 << 20
WALKS = 6
SAMPLED = 2
# The share of embedded positions that differ, for which the recall is to be reached.
FAR_SHARE = 0.7
RECALL = 0.99
# Symbols of window embeddings held at once.
EMBEDDED = 1 << 22
_WALK_BASE = 0xE7037ED1A0B428DB


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + np.uint8(32), data)


def tables_for(recall: float, far_share: float = FAR_SHARE, sampled: int = SAMPLED) -> int:
    """Tables that find a pair with probability ``recall`` if ``far_share`` of positions differ."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - far_share) ** sampled)))


def edits_allowed(n_words: int, similarity: float) -> int:
    return int((1 - similarity) * n_words + 1e-9) if n_words >= FUZZY_WORDS else 0


@dataclass
class Items:
    """A block of benchmark items, ready for matching."""

    ids: list
    words: list[np.ndarray]
    edits: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def prepare(rows: list[tuple[int, str | None]], similarity: float) -> Items:
    """Hash the items' words and index the segments' first words by length."""
    ids, words = [], []
    for item_id, text in rows:
        data = lowered(np.frombuffer((text or "").encode(), dtype=np.uint8))
        hashes, _ = word_hashes(data, np.array([0, len(data)]))
        if len(hashes):
            ids.append(item_id)
            words.append(hashes)
    edits = np.array([edits_allowed(len(w), similarity) for w in words], dtype=np.int64)
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for k, (w, e) in enumerate(zip(words, edits.tolist())):
        length = len(w) // (e + 1)
        hashes = window_hash(w, length)
        for s in range(e + 1):
            at = s * len(w) // (e + 1)
            by_length.setdefault(length, []).append((int(hashes[at]), k, at))
    seeds = {}
    for length, found in by_length.items():
        found.sort()
        keys = np.array([x[0] for x in found], dtype=np.uint64)
        # A small table of flags sorts out most windows of a text before the search.
        flags = np.zeros(1 << 20, dtype=bool)
        flags[(keys >> np.uint64(44)).astype(np.int64)] = True
        seeds[length] = keys, np.array([x[1] for x in found]), np.array([x[2] for x in found]), flags
    return Items(ids, words, edits, seeds)


def _walk_multipliers(walk: int, steps: int) -> np.ndarray:
    """Odd numbers whose product with a symbol gives the walk's random bit at each step."""
    base = np.uint64((walk + 1) * _WALK_BASE % (1 << 64))
    return mix(np.arange(1, steps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + base) | np.uint64(1)


def sampled_positions(n_words: int, walk: int, tables: int, sampled: int) -> np.ndarray:
    """Positions in the embedding of an n-word string, per table of one walk."""
    draw = mix(np.arange(tables * sampled, dtype=np.uint64) + np.uint64((walk + 1) * 0x2545F4914F6CDD1D % (1 << 64)) + np.uint64(n_words))
    # Early positions differ least; the walk reads about half its steps' number of symbols.
    return (draw % np.uint64(max(1, 2 * n_words))).astype(np.int64).reshape(tables, sampled)


def embed(symbols: np.ndarray, start: np.ndarray, n_words: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """Embeddings (one column per string): the walk repeats a symbol or goes on to the next."""
    multipliers = _walk_multipliers(walk, steps)
    at = np.zeros(len(start), dtype=np.int64)
    out = np.zeros((steps, len(start)), dtype=np.uint64)
    for j in range(steps):
        inside = at < n_words
        symbol = np.where(inside, symbols[np.minimum(start + at, len(symbols) - 1)], np.uint64(0))
        out[j] = symbol
        at += ((symbol * multipliers[j]) >> np.uint64(63)).astype(np.int64) * inside
    return out


class Matcher:
    """Finds the items of a block in the word sequences of texts."""

    def __init__(self, items: Items, recall: float = RECALL) -> None:
        self.items = items
        self.lengths = np.array([len(w) for w in items.words], dtype=np.int64)
        self.per_walk = -(-tables_for(recall) // WALKS)
        steps = 2 * int(self.lengths.max()) if len(self.lengths) else 0
        self.flat = np.concatenate(items.words) if items.words else np.zeros(0, dtype=np.uint64)
        first = np.cumsum(self.lengths) - self.lengths
        self.embedded = [embed(self.flat, first, self.lengths, w, steps) for w in range(WALKS)] if steps else []
        self.positions = [np.stack([sampled_positions(int(n), w, self.per_walk, SAMPLED) for n in self.lengths]) for w in range(WALKS)] if steps else []

    def seeds(self, hashes: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item and start of every window at which a seed puts an item."""
        item, start = [], []
        for length, (keys, owner, offset, flags) in self.items.seeds.items():
            grams = window_hash(hashes, length)
            near = np.flatnonzero(flags[(grams >> np.uint64(44)).astype(np.int64)])
            near = near[text_of[near] == text_of[near + length - 1]]
            low, high = np.searchsorted(keys, grams[near], "left"), np.searchsorted(keys, grams[near], "right")
            counts = high - low
            which = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            item.append(owner[which])
            start.append(np.repeat(near, counts) - offset[which])
        if not item:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(item), np.concatenate(start)

    def windows(self, hashes: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct windows to be embedded (item and start): at seeds, and shifted."""
        found_item, found_start = self.seeds(hashes, text_of)
        if not len(found_item):
            return found_item, found_start
        item, start = [], []
        most = int(self.items.edits.max())
        for shift in range(-most, most + 1):
            use = abs(shift) <= self.items.edits[found_item]
            item.append(found_item[use])
            start.append(found_start[use] + shift)
        item, start = np.concatenate(item), np.concatenate(start)
        keep = (start >= 0) & (start < len(hashes))
        key = np.unique(item[keep] * len(hashes) + start[keep])
        return key // len(hashes), key % len(hashes)

    def passed(self, hashes: np.ndarray, room: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Windows that agree with their item in all sampled positions of some table.

        ``room`` is the number of words from the start to the end of its text.
        """
        ok = np.zeros(len(item), dtype=bool)
        order = np.argsort(self.lengths[item], kind="stable")
        first = 0
        while first < len(order):
            # Short items come first, so the last of a part needs the most steps; a part's
            # embeddings are bounded in symbols.
            ahead = 2 * self.lengths[item[order[first : first + 20000]]] * np.arange(1, len(order[first : first + 20000]) + 1)
            part = order[first : first + max(1, int(np.searchsorted(ahead, EMBEDDED, "right")))]
            first += len(part)
            n = np.minimum(self.lengths[item[part]], room[part])
            steps = 2 * int(self.lengths[item[part]].max())
            for walk in range(WALKS):
                same = embed(hashes, start[part], n, walk, steps) == self.embedded[walk][:steps, item[part]]
                sampled = self.positions[walk][item[part]]
                hit = same[sampled, np.arange(len(part))[:, None, None]].all(axis=2).any(axis=1)
                ok[part] |= hit
        return ok

    def matches(self, hashes: np.ndarray, borders: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Verified matches: text, item, first and last word of the passage, distance."""
        if not len(self.lengths) or not len(hashes):
            return []
        text_of = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
        item, start = self.windows(hashes, text_of)
        if not len(item):
            return []
        text = text_of[start]
        ok = self.passed(hashes, borders[text + 1] - start, item, start)
        item, start, text = item[ok], start[ok], text[ok]
        found, last = [], None
        for t, k, s in sorted(zip(text.tolist(), item.tolist(), start.tolist())):
            n, e = int(self.lengths[k]), int(self.items.edits[k])
            low, high = max(int(borders[t]), s - e), min(int(borders[t + 1]), s + n + e)
            if last and last[:2] == [t, k] and low <= last[3]:
                last[3] = max(last[3], high)
            else:
                last = [t, k, low, high]
                found.append(last)
        out = []
        for t, k, low, high in found:
            distance, end = search(self.items.words[k].tolist(), hashes[low:high].tolist())
            if distance <= int(self.items.edits[k]):
                first = max(low, low + end - int(self.lengths[k]))
                out.append((t, k, first - int(borders[t]), low + end - int(borders[t]), distance))
        return out


def search(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and where that part ends.

    Bit-parallel over the pattern (Myers): one word of the text takes a few operations.
    """
    n = len(pattern)
    masks: dict[int, int] = {}
    for i, symbol in enumerate(pattern):
        masks[symbol] = masks.get(symbol, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, where = n, 0
    for j, symbol in enumerate(text):
        match = masks.get(symbol, 0)
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right, left = down | (full & ~(diagonal | up)), diagonal & up
        score += bool(right & top) - bool(left & top)
        right, left = (right << 1) & full, (left << 1) & full
        up, down = left | (full & ~(diagonal | right)), diagonal & right
        if score < best:
            best, where = score, j + 1
    return best, where


_MATCHES = "array<struct<item_id:long,start:int,end:int,distance:int>>"


def _scan(rows: DataFrame, items: list[tuple[int, str | None]], similarity: float, recall: float) -> DataFrame:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())]))

    def scan(batches):
        matcher = Matcher(prepare(items, similarity), recall)
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(len(batch))]
            for first, _, data, offsets in text_chunks(batch.column(1)):
                hashes, borders = word_hashes(lowered(data), offsets)
                for t, k, low, high, distance in matcher.matches(hashes, borders):
                    found[first + t].append({"item_id": matcher.items.ids[k], "start": low, "end": high, "distance": distance})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, kind)], names=["doc_id", "row_key", "matches"])

    return rows.mapInArrow(scan, f"doc_id long, row_key long, matches {_MATCHES}")


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``doc_id``, ``row_key`` and ``matches`` (item, words from and to, distance) of every row.

    The items are collected in blocks of bounded size, and each block is matched in one
    narrow pass over the documents; a benchmark that fits a block takes one pass.
    """
    items = benchmark.select(named(benchmark, "item_id").cast("long").alias("item_id"), named(benchmark, "text").cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // BLOCK_BYTES))
    rows = docs.select(named(docs, "doc_id").cast("long").alias("doc_id"), named(docs, "text").cast("string").alias("text"), row_key(docs).alias("row_key"))
    parts = []
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        parts.append(_scan(rows, [(r["item_id"], r["text"]) for r in block], similarity, recall))
    if blocks == 1:
        return parts[0]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # Rows that share a key are equal: each block saw all of them.
    per_block = found.groupBy("doc_id", "row_key").agg(F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"))
    left = rows.select("doc_id", "row_key").alias("r")
    return left.join(per_block.select("row_key", "matches"), "row_key").select("doc_id", "row_key", "matches")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The documents without a match, with all their columns.

    Only the keys of contaminated rows take part in the join; keys are hashes of id and text.
    """
    bad = contamination(docs, benchmark, similarity, recall).where(F.size("matches") > 0).select("row_key").distinct()
    return packed(docs, row_key=row_key(docs)).join(bad, "row_key", "left_anti").select("row.*")
