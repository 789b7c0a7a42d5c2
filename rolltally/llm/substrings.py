"""Removal of long passages that occur more than once, anywhere in the corpus.

Rabin-Karp hashes of all windows of ``window`` words are derived from running sums. A
window can only repeat if its anchor does, the smallest hash among the ``ANCHOR_WORDS``-word
sequences inside it: equal windows have equal anchors. So anchors, about a tenth as many as
windows, are counted first; windows over an anchor that occurs once are known to occur once.
All other windows are counted by their own hashes, and the repeated ones merge into
intervals of words. Rows with equal keys meet in sorted order in a stream that looks at
neighbours only, so no group is ever held; what repeats inside a batch of texts sends one
row for all.

Defined results: a null text has no words. Texts shorter than a window lose nothing. Rows
that repeat an id and text are separate occurrences. Null ids are kept. Extra columns pass
by unread.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.llm.common import discard, handover, mix, named, row_key, text_chunks, window_hash, word_hashes
from rolltally.session import new_path

ANCHOR_WORDS = 16
BATCH_BYTES = 1 << 22
_SECOND_BASE = 0xA0761D6478BD642F


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        best = np.where(values[left] <= values[right], left, right)
        span += step
    return best[:n]


class Windows:
    """Hashes of the words of a chunk of texts, and of the windows that lie in one text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> None:
        self.hashes, self.borders = word_hashes(data, offsets)
        self.window = window
        n = len(self.hashes) - window + 1
        text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(self.borders))
        self.start = np.flatnonzero(text_of[:n] == text_of[window - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)
        self.text = text_of[self.start]
        self.grams = window_hash(self.hashes, anchor)
        self.anchor = sliding_argmin(self.grams, window - anchor + 1)[self.start] if len(self.start) else self.start

    def within(self, positions: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Word numbers inside their texts."""
        return positions - self.borders[text]

    def keys(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = window_hash(self.hashes, self.window)[start]
        second = window_hash(mix(self.hashes + np.uint64(_SECOND_BASE)), self.window, _SECOND_BASE)[start]
        return first.view(np.int64), (second >> np.uint64(33)).astype(np.int32)


def _batch(first: np.ndarray, second: np.ndarray, key: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Rows for counting; of rows that share a key, the first stands for all.

    ``done`` marks rows that are known to repeat and take no further part (they lose their
    keys), ``many`` the rows that stand for several.
    """
    order = np.lexsort((second, first))
    first, second, key, pos = first[order], second[order], key[order], pos[order]
    same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
    done = np.zeros(len(first), dtype=bool)
    done[1:] = same
    many = np.zeros(len(first), dtype=bool)
    many[:-1] = same
    many &= ~done
    first[done], second[done] = 0, 0
    arrays = [pa.array(first), pa.array(second), pa.array(key), pa.array(pos.astype(np.int32)), pa.array(many), pa.array(done)]
    return pa.RecordBatch.from_arrays(arrays, names=["h", "h2", "row_key", "pos", "many", "done"])


_ROWS = "h long, h2 int, row_key long, pos int, many boolean, done boolean"


def _anchor_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def scan(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, data, offsets in text_chunks(batch.column(1), BATCH_BYTES):
                found = Windows(data, offsets, window, anchor)
                position, at = np.unique(found.anchor, return_index=True)
                text = found.text[at]
                yield _batch(found.grams[position].view(np.int64), np.zeros(len(position), dtype=np.int32), keys[first + text], found.within(position, text))

    return docs.mapInArrow(scan, _ROWS)


def _window_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Windows over repeated anchors; ``docs`` has their word numbers in ``at``."""

    def scan(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            at = batch.column(2)
            counts = np.diff(np.asarray(at.offsets))
            values, ends = np.asarray(at.flatten()), np.cumsum(counts)
            for first, last, data, offsets in text_chunks(batch.column(1), BATCH_BYTES):
                found = Windows(data, offsets, window, anchor)
                low = ends[first] - counts[first]
                text = np.repeat(np.arange(last - first), counts[first:last])
                repeated = np.zeros(len(found.hashes) + 1, dtype=bool)
                repeated[values[low : ends[last - 1]] + found.borders[text]] = True
                chosen = repeated[found.anchor]
                start, text = found.start[chosen], found.text[chosen]
                yield _batch(*found.keys(start), keys[first + text], found.within(start, text))

    return docs.mapInArrow(scan, _ROWS)


def _neighbours(batches):
    """From rows sorted by key: those with an equal neighbour."""
    held, equal_before = None, False
    names = ("h", "h2", "row_key", "pos", "many")
    for batch in batches:
        if not len(batch):
            continue
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in names}
        same = (rows["h"][1:] == rows["h"][:-1]) & (rows["h2"][1:] == rows["h2"][:-1])
        twice = np.zeros(len(rows["h"]), dtype=bool)
        twice[:-1] = same
        twice[1:] |= same
        twice[0] |= equal_before
        equal_before = bool(twice[-1])
        held = {c: v[-1:] for c, v in rows.items()}
        out = twice[:-1] | rows["many"][:-1].astype(bool)
        yield pa.RecordBatch.from_arrays([pa.array(rows["row_key"][:-1][out]), pa.array(rows["pos"][:-1][out])], names=["row_key", "pos"])
    if held is not None:
        out = np.array([equal_before]) | held["many"].astype(bool)
        yield pa.RecordBatch.from_arrays([pa.array(held["row_key"][out]), pa.array(held["pos"][out])], names=["row_key", "pos"])


def _repeated(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    """Positions (``row_key``, ``pos``) of the rows whose key occurs more than once.

    The rows are written once, as they serve both the counting and what is known without it,
    and deleted when the positions are.
    """
    path = new_path(spark, label)
    rows = handover(spark, rows, label, path)
    open_rows = rows.where("not done").drop("done").repartition("h").sortWithinPartitions("h", "h2")
    known = rows.where("done").select("row_key", "pos")
    found = handover(spark, open_rows.mapInArrow(_neighbours, "row_key long, pos int").union(known), f"repeated-{label}")
    discard(spark, path)
    return found


def _positions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("row_key").agg(F.collect_list("pos").alias("at"))


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every word that lies in a window whose word sequence also starts elsewhere.

    Returns ``doc_id``, ``n_words``, ``n_removed``, ``removed`` (spans of word numbers, end
    exclusive, maximal) and ``kept_text`` (the other words joined by single spaces). Windows
    are judged on the input. ``window`` must be at least ``ANCHOR_WORDS``.
    """
    if window < ANCHOR_WORDS:
        raise ValueError(f"Windows have at least {ANCHOR_WORDS} words.")
    source = docs.select(row_key(docs, doc_id, text).alias("row_key"), named(docs, text).cast("string").alias("text"))
    at_anchor = _repeated(spark, _anchor_rows(source, window, ANCHOR_WORDS), "anchors")
    at_window = _repeated(spark, _window_rows(source.join(_positions(at_anchor), "row_key"), window, ANCHOR_WORDS), "windows")

    def cut(batches):
        for batch in batches:
            columns = batch.to_pydict()
            out = [_without(t, at, window) for t, at in zip(columns["text"], columns["at"])]
            arrays = [batch.column("doc_id"), *(pa.array(list(x), kind) for x, kind in zip(zip(*out), _CUT_TYPES))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "removed", "kept_text"])

    whole = docs.select(row_key(docs, doc_id, text).alias("row_key"), named(docs, doc_id).cast("long").alias("doc_id"), named(docs, text).cast("string").alias("text"))
    joined = whole.join(_positions(at_window), "row_key", "left").select("doc_id", "text", "at")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string")


_CUT_TYPES = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string())


def _without(text: str | None, at: list[int] | None, window: int) -> tuple[int, int, list[dict], str]:
    """Words, words removed, removed spans and the rest of one text."""
    words = text.encode().split() if text else []
    if not at:
        return len(words), 0, [], b" ".join(words).decode()
    start = np.unique(np.asarray(at, dtype=np.int64))
    breaks = np.flatnonzero(start[1:] > start[:-1] + window)
    lows = start[np.concatenate([[0], breaks + 1])]
    highs = start[np.concatenate([breaks, [len(start) - 1]])] + window
    kept, last = [], 0
    for low, high in zip(lows.tolist(), highs.tolist()):
        kept += words[last:low]
        last = high
    kept += words[last:]
    spans = [{"start": a, "end": b} for a, b in zip(lows.tolist(), highs.tolist())]
    return len(words), len(words) - len(kept), spans, b" ".join(kept).decode()


def digest(words: list[str]) -> str:
    """Digest of words joined by single spaces, as the query reports it."""
    return sha256(" ".join(words).encode()).hexdigest()
