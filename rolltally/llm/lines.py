"""Near-duplicate lines by a segment-partition edit join.

Two lines within ``EDITS`` edits (of code points) must share one of ``EDITS + 1`` segments:
every line is cut into that many parts, and looks up, for its own length and those up to
``EDITS`` less, the substrings at the few places where an unchanged part can have moved to.
Candidates meet under the hash of such a part together with the length it was cut for. They
carry the parities of their hashed character pairs, of which an edit changes at most four,
so nearly all that differ elsewhere fall out at once; the others are verified by a banded
bit-parallel edit distance over their texts.

With ``words_an_edit``, lines are also near if one becomes the other by editing (changing,
adding, dropping) at most one word for every so many words of the longer. That many edits
leave one of the longer line's segments, one more than the edits, whole somewhere in the
other. Both look up a run of ``GRAM`` words that the words around it determine, so that
equal segments choose the same run. Under a run, only lines are compared whose lengths and
places allow it, which are ranges of its rows in order of these, by the parities of their
hashed words, of which an edit changes at most two. What is left is verified by a
bit-parallel edit distance over words, of any length.

Keys are counted before rows are dealt out under them: parts of the lines send each distinct
key once, packed, in a few bytes with what its row is made of. What is left are those that two
different lines share and one of them owns, a small part. Longer segments choose their run
among more words, so that lines are looked up under fewer.

Pairs are never written: a group's size squared is work inside a task, and what leaves it is
one row a line. Under a key, lines stay that have a likely partner there. The least of them
leads the key, so that near copies, which share many keys, have one leader for most. Each
line goes, with its text, once to every leader of its keys, and is verified against the
others there. A pair counts under the least leader of the keys that both have, which each
line's keys tell, and so once.

Lines are compared without white space at their ends. Lines without a word are left alone,
lines of fewer than ``NEAR_CHARS`` code points have no lines within ``EDITS`` but equal ones. A line is
removed if an equal line, or any near one, starts earlier: by document id (null last), then
line number. What is judged is the input, not what is left of it.

Defined results: null texts have no lines and stay null; a text that loses all its lines
becomes empty; rows that repeat an id and text are one document and get the same result.
Other columns, of whatever names, pass through.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.llm.common import IN_WORD, SEPARATORS, discard, give_back, handover, mix, named, packed, prefix_hash, row_key, substring_hash, text_chunks, window_hash
from rolltally.session import new_path

EDITS = 2
NEAR_CHARS = 16
# Words for each word that may be edited. Segments of longer lines have GRAM words at least;
# no more than WINDOW of them choose a run.
WORDS_AN_EDIT = 10
GRAM, WINDOW = 5, 9
# Groups with more rows are compared block of rows by block of rows.
GROUP_ROWS = 2048
# Stands for the place of a run that comes several times in its line.
ANYWHERE = 0x7FFFFFFF
_CHAR_BASE = 0x8EBC6AF09C88C6E3
_SMALL = mix(np.arange(1, 0x3001, dtype=np.uint64))


def _values(codes: np.ndarray) -> np.ndarray:
    out = _SMALL[np.minimum(codes, 0x2FFF)]
    large = codes >= 0x3000
    if large.any():
        out[large] = mix(codes[large].astype(np.uint64) + np.uint64(1))
    return out


def _in_word(codes: np.ndarray) -> np.ndarray:
    return IN_WORD[codes if codes.dtype == np.uint8 else np.minimum(codes, 255)]


# Steps over white space that all lines take together.
_STEPS = 32


def _trimmed(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges without white space at their ends; those of nothing else end where they start."""
    start, end = start.copy(), end.copy()
    for at, before, step in ((start, 0, 1), (end, 1, -1)):
        left = np.arange(len(start))
        for _ in range(_STEPS):
            left = left[start[left] < end[left]]
            left = left[~_in_word(codes[at[left] - before])]
            if not len(left):
                break
            at[left] += step
        for k in left[start[left] < end[left]].tolist():
            inside = np.flatnonzero(_in_word(codes[start[k] : end[k]]))
            if not len(inside):
                end[k] = start[k]
            elif step > 0:
                start[k] += inside[0]
            else:
                end[k] = start[k] + inside[-1] + 1
    return start, end


class Lines:
    """All lines with a word in a chunk of texts: where they are and what they hash to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        # Code point positions of the texts' borders.
        later = np.flatnonzero(data.view(np.int8) < -64)
        borders = offsets - np.searchsorted(later, offsets)
        plain = len(data) and data.max() < 128
        self.codes = data if plain else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
        n = len(self.codes)
        breaks = np.flatnonzero(self.codes == 10)
        begin = np.sort(np.concatenate([borders[:-1], breaks + 1]))
        start, end = _trimmed(self.codes, begin, np.concatenate([begin[1:], [n]]))
        keep = end > start
        begin, self.start, self.end = begin[keep], start[keep], end[keep]
        # Where empty texts or lines begin at the same place, the line is the last one's.
        self.text = np.searchsorted(borders, begin, "right") - 1
        self.number = np.searchsorted(breaks, begin) - np.searchsorted(breaks, borders[self.text])
        self.length = self.end - self.start
        self._values = _SMALL[self.codes] if plain else _values(self.codes)
        self.prefix = prefix_hash(self._values, _CHAR_BASE)
        self.id = mix(substring_hash(self.prefix, self.start, self.end, _CHAR_BASE) + mix(self.length.astype(np.uint64)))
        self._words = self._hashes = None

    def parity(self) -> np.ndarray:
        """Of each line, which of 64 classes of pairs of characters it has an odd number of."""
        n, values = len(self.codes), self._values
        pairs = np.zeros(max(n, 1) + 1, dtype=np.uint64)
        if n > 1:
            hashed = ((values[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ values[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(58)
            np.bitwise_xor.accumulate(np.uint64(1) << hashed, out=pairs[1:n])
        return pairs[self.end - 1] ^ pairs[self.start]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of all words; of each line, its first word and how many it has."""
        if self._words is not None:
            return self._words
        inside = _in_word(self.codes)
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        begin[self.start], end[self.end - 1] = True, True
        begin = np.flatnonzero(begin)
        first = np.searchsorted(begin, self.start)
        self._words = begin, np.flatnonzero(end) + 1, first, np.searchsorted(begin, self.end) - first
        return self._words

    def word_hashes(self) -> np.ndarray:
        if self._hashes is None:
            begin, end, _, _ = self.words()
            self._hashes = mix(substring_hash(self.prefix, begin, end, _CHAR_BASE) + mix((end - begin).astype(np.uint64)))
        return self._hashes

    def word_parity(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each line, which of 64 classes of words it has an odd number of, and its number of words."""
        _, _, first, count = self.words()
        hashed = self.word_hashes()
        odd = np.zeros(len(hashed) + 1, dtype=np.uint64)
        np.bitwise_xor.accumulate(np.uint64(1) << (hashed >> np.uint64(58)), out=odd[1:])
        return odd[first + count] ^ odd[first], count


def _segment(length: np.ndarray, k: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the k-th of ``parts`` nearly equal parts, longer ones last."""
    size, rest = length // parts, length % parts
    late = np.maximum(0, k - (parts - rest))
    return k * size + late, size + (k >= parts - rest)


def segment_keys(lines: Lines, chosen: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, key and whether the part is the line's own segment, for every part to meet under.

    A line looks up every length from its own down to ``edits`` less. Of a segment with i
    others before it, the part can have moved by at most i edits, and what is left for the
    other side bounds it too.
    """
    start, length = lines.start[chosen], lines.length[chosen]
    out = []
    for less in range(edits + 1):
        target = length - less
        for k in range(edits + 1):
            at, size = _segment(target, k, edits + 1)
            code = mix((target * 8 + k).astype(np.uint64))
            for move in range(max(-k, less - (edits - k)), min(k, less + (edits - k)) + 1):
                fits = (at + move >= 0) & (at + move + size <= length)
                low = start[fits] + (at + move)[fits]
                key = mix(substring_hash(lines.prefix, low, low + size[fits], _CHAR_BASE) ^ code[fits])
                out.append((chosen[fits], key, np.full(int(fits.sum()), less == 0 and move == 0)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _widths(words_an_edit: int) -> tuple[np.ndarray, np.ndarray]:
    """By number of words (the last stands for all larger ones): how many words of its segments choose a line's own runs, and how many words choose the runs it is looked up by.

    The smallest run of some words is also the smallest of those fewer among them that still
    hold it. So a line that looks up the runs of no more words than any line in reach has
    in its segments meets them all.
    """
    count = np.arange(words_an_edit * (WINDOW + 4))
    own = np.minimum(WINDOW, count // (count // words_an_edit + 1))
    own[:words_an_edit] = WINDOW  # no edits, no segments
    reach = np.searchsorted(count - count // words_an_edit, count, "right")
    return own, np.array([own[k:high].min() for k, high in zip(count.tolist(), reach.tolist())])


def word_keys(lines: Lines, chosen: np.ndarray, words_an_edit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line, key, place and whether a segment of its own chose it, for every run of words to meet under.

    The place holds the line's number of words above that of the run's first word.
    """
    _, _, first, count = lines.words()
    # A line is looked up by longer ones, which have at least words_an_edit words.
    chosen = np.sort(chosen[count[chosen] >= max(GRAM, words_an_edit - 1)])
    none = np.zeros(0, dtype=np.int64)
    if not len(chosen):
        return none, none.astype(np.uint64), none, none.astype(bool)
    first, count = first[chosen], count[chosen]
    runs = window_hash(lines.word_hashes(), GRAM)
    own_widths, widths = _widths(words_an_edit)
    kind = np.minimum(count, len(widths) - 1)
    width = widths[kind]
    edits = count // words_an_edit
    parts = np.where(edits > 0, edits + 1, 0)
    which = np.repeat(np.arange(len(parts)), parts)
    begin_at, _ = _segment(count[which], np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts), parts[which])
    begin_at, own_width = first[which] + begin_at, own_widths[kind][which]
    taken, own = np.zeros(len(runs), dtype=bool), np.zeros(len(runs), dtype=bool)
    # The smallest run, the first of equal ones, of every window of ``size`` words.
    least, best = np.arange(len(runs)), runs.copy()
    for size in range(GRAM, WINDOW + 1):
        shift = size - GRAM
        if shift >= len(runs):
            break
        if shift:
            lower = runs[shift:] < best[:-shift]
            np.copyto(least[:-shift], np.arange(shift, len(runs)), where=lower)
            np.copyto(best[:-shift], runs[shift:], where=lower)
        some = width == size
        if some.any():
            inside = np.zeros(len(runs) + 1, dtype=np.int8)
            inside[first[some]] = 1
            inside[(first + count)[some] - size + 1] -= 1
            taken[least[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]] = True
        own[least[begin_at[own_width == size]]] = True
    used = np.flatnonzero(taken | own)
    line = np.searchsorted(first, used, "right") - 1
    return chosen[line], runs[used], (count[line] << 32) | (used - first[line]), own[used]


def _one_a_line(line: np.ndarray, key: np.ndarray, place: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One row for each line and key; where a run comes again in its line, its place is left open.

    A line that says one word a thousand times has one run at a thousand places.
    """
    both = key + mix(line.astype(np.uint64))
    ordered = np.sort(both)
    again = np.isin(both, ordered[1:][ordered[1:] == ordered[:-1]])
    if not again.any():
        return line, key, place, own
    rows = np.flatnonzero(again)
    rows = rows[np.lexsort((place[rows], key[rows], line[rows]))]
    starts = np.flatnonzero(np.concatenate([[True], (line[rows][1:] != line[rows][:-1]) | (key[rows][1:] != key[rows][:-1])]))
    several = np.diff(np.append(starts, len(rows))) > 1
    one = rows[starts]
    changed = line[one], key[one], np.where(several, place[one] | ANYWHERE, place[one]), np.logical_or.reduceat(own[rows], starts)
    return tuple(np.concatenate([x[~again], y]) for x, y in zip((line, key, place, own), changed))


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def occurrences(docs: DataFrame) -> DataFrame:
    """``row_key``, ``doc_id``, ``line_no``, ``id`` and length (``chars``) of every line with a word."""

    def scan(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            ids = batch.column(2)
            for first, _, data, offsets in text_chunks(batch.column(1)):
                lines = Lines(data, offsets)
                rows = pa.array(first + lines.text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[first + lines.text]), ids.take(rows), pa.array(lines.number.astype(np.int32)), _long(lines.id), pa.array(lines.length.astype(np.int32))],
                    names=["row_key", "doc_id", "line_no", "id", "chars"],
                )
                lines = None
        give_back()

    return docs.mapInArrow(scan, "row_key long, doc_id long, line_no int, id long, chars int")


# Lines of some texts (a part) and the keys that they meet under, by characters (c) and by words (w). Rows of these kinds hold the
# keys of a part and a bucket, each once: its bits above two flags (a line owns it, several lines have it), the first line, the run's
# place. One row of kind i a part has its lines (ids, parities of character pairs and of words, numbers of words) and, for the keys
# that several have, all these lines. Arrays are kept as bytes: there are many small numbers.
_SHARED = [f"{kind}_{c}" for kind in "cw" for c in ("key", "line", "at", "own")]
_KEYED = "kind string, bucket long, part long, keys binary, flags binary, lines binary, at binary, ids binary, parity binary, marks binary, words binary, " + ", ".join(f"{c} binary" for c in _SHARED)
_KEYED_NAMES = [f.split()[0] for f in _KEYED.split(", ")]
# Keys that one task counts at once, on average, and that a part has, or one chunk of texts.
BUCKET_KEYS, PART_KEYS, BUCKETS = 1 << 20, 1 << 20, 16
_KEY_BITS = 30
_MASK = (1 << _KEY_BITS) - 1


def _narrow(values: np.ndarray) -> bytes:
    """Numbers (or ANYWHERE) in two bytes each if they fit, else in four."""
    large = values >= 0xFFFF
    if large.any() and (values[large] != ANYWHERE).any():
        return values.astype(np.uint32).tobytes()
    return np.minimum(values, 0xFFFF).astype(np.uint16).tobytes()


def _widened(data: bytes, n: int) -> np.ndarray:
    if len(data) == 4 * n:
        return np.frombuffer(data, dtype=np.uint32).astype(np.int64)
    values = np.frombuffer(data, dtype=np.uint16).astype(np.int64)
    values[values == 0xFFFF] = ANYWHERE
    return values


class _Part:
    """Lines and keys of some chunks of texts."""

    def __init__(self, number: int, buckets: int) -> None:
        self.number, self.buckets = number, buckets
        self.lines, self.keys, self.n_lines, self.n_keys = [], {"c": [], "w": []}, 0, 0

    def add(self, lines: tuple[np.ndarray, ...], **keys: tuple[np.ndarray, ...]) -> None:
        """``lines``: id, parity of character pairs and of words, number of words. ``keys``: line (of these), key, place, own."""
        self.lines.append(lines)
        for kind, (line, key, at, own) in keys.items():
            name = ((key >> np.uint64(64 - _KEY_BITS)) % np.uint64(self.buckets)).astype(np.int64) << _KEY_BITS | (key & np.uint64(_MASK)).astype(np.int64)
            self.keys[kind].append((name, line + self.n_lines, at, own))
            self.n_keys += len(key)
        self.n_lines += len(lines[0])

    def rows(self):
        shared = {}
        for kind, found in self.keys.items():
            name, line, at, own = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(name)
            name, line, at, own = name[order], line[order], at[order], own[order]
            starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, dtype=np.int64)
            sizes = np.diff(np.append(starts, len(name)))
            several, owned = np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
            if len(name):
                several = np.maximum.reduceat(line, starts) != np.minimum.reduceat(line, starts)
                owned = np.logical_or.reduceat(own, starts)
                one_bits = ((name[starts] & _MASK) << 2 | owned | several.astype(np.int64) << 1).astype(np.uint32)
                bucket = name[starts] >> _KEY_BITS
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = np.append(cuts[1:], len(bucket)).tolist()
                first, place = line[starts], at[starts]
                cells = [(one_bits[a:b].tobytes(), _narrow(first[a:b]), _narrow(place[a:b]) if kind == "w" else b"") for a, b in zip(cuts.tolist(), ends)]
                keys, lines, places = zip(*cells)
                yield self._batch(kind=[kind] * len(cells), bucket=bucket[cuts].tolist(), part=[self.number] * len(cells), keys=keys, lines=lines, at=places)
            all_of = np.repeat(several, sizes)
            shared |= {f"{kind}_key": [name[all_of].tobytes()], f"{kind}_line": [_narrow(line[all_of])], f"{kind}_at": [_narrow(at[all_of])], f"{kind}_own": [own[all_of].tobytes()]}
        ids, parity, marks, words = (np.concatenate(x) for x in zip(*self.lines))
        own = {"ids": ids, "parity": parity, "marks": marks, "words": words.astype(np.int32)}
        yield self._batch(kind=["i"], bucket=[self.number], part=[self.number], **{c: [v.tobytes()] for c, v in own.items()}, **shared)

    @staticmethod
    def _batch(**columns) -> pa.RecordBatch:
        return _rows_of_bytes(_KEYED_NAMES, columns)


def _rows_of_bytes(names: list[str], columns: dict) -> pa.RecordBatch:
    kinds = {"kind": pa.string(), "bucket": pa.int64(), "part": pa.int64()}
    n = len(columns["part"])
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds.get(c, pa.binary())) if c in columns else pa.nulls(n, kinds.get(c, pa.binary())) for c in names], names=names)


def keyed_lines(docs: DataFrame, edits: int | None, near_chars: int, words_an_edit: int | None, fewer_words: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Lines and keys of parts of ``docs`` (``row_key``, ``text`` and, if there, ``at``: the line numbers that count).

    ``edits`` None leaves out keys by characters, ``words_an_edit`` None those by words;
    with ``fewer_words`` only lines of fewer words have keys by characters.
    """
    chosen_only = "at" in docs.columns

    def scan(batches):
        number = TaskContext.get().partitionId() << 32
        part = _Part(number, buckets)
        none = np.zeros(0, dtype=np.int64)
        nothing = none, none.astype(np.uint64), none, none.astype(bool)
        for batch in batches:
            if chosen_only:
                at = batch.column(2)
                counts = np.diff(np.asarray(at.offsets))
                numbers, ends = np.asarray(at.flatten()), np.cumsum(counts)
            for first, last, data, offsets in text_chunks(batch.column(1)):
                lines = Lines(data, offsets)
                if chosen_only:
                    wanted = np.repeat(np.arange(last - first), counts[first:last]) << 32 | numbers[ends[first] - counts[first] : ends[last - 1]]
                    at_lines = np.flatnonzero(np.isin(lines.text << 32 | lines.number, wanted))
                else:
                    at_lines = np.arange(len(lines.id))
                # Equal lines of a chunk look up once.
                at_lines = np.sort(at_lines[np.unique(lines.id[at_lines], return_index=True)[1]])
                if not len(at_lines):
                    continue
                place = np.zeros(len(lines.id), dtype=np.int64)
                place[at_lines] = np.arange(len(at_lines))
                marks, words = lines.word_parity()
                by_chars = by_words = nothing
                if edits is not None:
                    short = at_lines[lines.length[at_lines] >= max(near_chars, edits + 1)]
                    if fewer_words is not None:
                        short = short[words[short] < fewer_words]
                    if len(short):
                        line, key, own = segment_keys(lines, short, edits)
                        by_chars = place[line], key, np.zeros(len(line), dtype=np.int64), own
                if words_an_edit is not None:
                    line, key, at_word, own = _one_a_line(*word_keys(lines, at_lines, words_an_edit))
                    by_words = place[line], key, at_word & 0xFFFFFFFF, own
                part.add((lines.id[at_lines], lines.parity()[at_lines], marks[at_lines], words[at_lines]), c=by_chars, w=by_words)
                if part.n_keys > PART_KEYS:
                    yield from part.rows()
                    number += 1
                    part = _Part(number, buckets)
        lines = None
        if part.n_lines:
            yield from part.rows()
        part = None
        give_back()

    return docs.mapInArrow(scan, _KEYED)


def _meeting_keys(keyed: DataFrame) -> DataFrame:
    """``keyed`` with only those of the keys that two different lines share, one of which owns it.

    A part sends every distinct key once, packed by ranges of keys, and with what its rows are
    made of, so that no key is looked up again.
    """

    def count(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == "i":
            return table
        data, lines, at = (table.column(c).to_pylist() for c in ("keys", "lines", "at"))
        sizes = [len(d) // 4 for d in data]
        key = np.frombuffer(b"".join(data), dtype=np.uint32)
        ordered = np.sort(key.astype(np.uint64) >> np.uint64(2) << np.uint64(32) | np.arange(len(key), dtype=np.uint64))
        order, value = (ordered & np.uint64(0xFFFFFFFF)).astype(np.int64), ordered >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        any_flag = np.bitwise_or.reduceat((key & 3).astype(np.uint8)[order], starts)
        times = np.diff(np.append(starts, len(key)))
        kept = np.zeros(len(key), dtype=bool)
        kept[order] = np.repeat((any_flag & 1 > 0) & ((times > 1) | (any_flag & 2 > 0)), times)
        cuts, bucket = np.cumsum([0, *sizes]).tolist(), table.column("bucket")[0].as_py()
        out = {c: [] for c in ("part", "keys", "flags", "lines", "at")}
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            some = kept[a:b]
            if not some.any():
                continue
            left = key[a:b][some]
            out["part"].append(table.column("part")[k].as_py())
            out["keys"].append((bucket << _KEY_BITS | (left >> 2).astype(np.int64)).tobytes())
            out["flags"].append((left & 3).astype(np.uint8).tobytes())
            out["lines"].append(_narrow(_widened(lines[k], b - a)[some]))
            out["at"].append(_narrow(_widened(at[k], b - a)[some]) if at[k] else b"")
        n = len(out["part"])
        return pa.Table.from_batches([_rows_of_bytes(_KEYED_NAMES, {"kind": [table.column("kind")[0].as_py()] * n, "bucket": [bucket] * n, **out})])

    return keyed.groupBy("kind", "bucket").applyInArrow(count, _KEYED)


def _meeting_rows(spark: SparkSession, keyed: DataFrame, kind: str) -> DataFrame:
    """``key``, ``id``, ``place``, ``mark`` (parities) and ``own`` of lines under keys that can bring a pair together."""
    return _rows_under(handover(spark, _meeting_keys(keyed), "meeting-keys"), kind)


def _rows_under(meeting: DataFrame, kind: str) -> DataFrame:
    """The rows of ``_meeting_rows`` by the keys that meet."""
    by_words = kind == "w"
    keys = meeting.where(F.col("kind") == kind).groupBy("part").agg(F.collect_list(F.struct("keys", "flags", "lines", "at")).alias("met"))
    columns = ["ids", "marks" if by_words else "parity", "words", *(f"{kind}_{c}" for c in ("key", "line", "at", "own"))]
    numbers = {"words": np.int32, f"{kind}_own": np.bool_}

    def rows(batches):
        for batch in batches:
            for row in range(len(batch)):
                stored = {c: batch.column(c)[row].as_py() for c in columns}
                ids, marks, words, s_key, s_own = (np.frombuffer(stored[c], dtype=numbers.get(c, np.int64)) for c in (*columns[:4], columns[6]))
                s_line, s_at = (_widened(stored[c], len(s_key)) for c in columns[4:6])
                met = [(len(m["flags"]), m) for m in batch.column("met")[row].as_py()]
                key = np.frombuffer(b"".join(m["keys"] for _, m in met), dtype=np.int64)
                flags = np.frombuffer(b"".join(m["flags"] for _, m in met), dtype=np.uint8)
                line = np.concatenate([_widened(m["lines"], n) for n, m in met])
                at = np.concatenate([_widened(m["at"], n) for n, m in met]) if by_words else np.zeros(len(key), dtype=np.int64)
                alone = flags & 2 == 0
                shared = np.isin(s_key, key[~alone])
                key, line, at, own = (np.concatenate([x[alone], y[shared]]) for x, y in ((key, s_key), (line, s_line), (at, s_at), (flags & 1 > 0, s_own)))
                place = words[line].astype(np.int64) << 32 | at if by_words else np.zeros(len(line), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, ids[line].view(np.int64), place, marks[line].view(np.int64), own)], names=["key", "id", "place", "mark", "own"])

    return meeting.where("kind = 'i'").join(keys, "part").select(*columns, "met").mapInArrow(rows, "key long, id long, place long, mark long, own boolean")


class ByCharacters:
    """Who is compared under a part of a line: all, by the parities of their character pairs."""

    def __init__(self, edits: int) -> None:
        self.most_bits = 4 * edits

    def ranges(self, group: np.ndarray, place: np.ndarray):
        at = np.arange(len(group))
        yield at, at + 1, np.searchsorted(group, group, "right")

    def alike(self, place_a: np.ndarray, place_b: np.ndarray, differing: np.ndarray) -> np.ndarray:
        return differing <= self.most_bits


class ByWords:
    """Who is compared under a run of words: lines that may be near by their numbers of words and the run's places."""

    def __init__(self, words_an_edit: int) -> None:
        self.words_an_edit = words_an_edit

    def ranges(self, group: np.ndarray, place: np.ndarray):
        """Rows and the ranges of later rows that each is compared with.

        Moving the run and then ending at the other length must take no more edits than the
        longer line allows, so that for each larger number of words the run's place lies in
        one interval. Runs of no one place come last among those of their number of words.
        """
        count, at = place >> 32, place & ANYWHERE
        new = np.ones(len(group), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (count[1:] != count[:-1])
        block, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        ends = np.append(starts[1:], len(group))
        order = block << 32 | at
        opened = np.searchsorted(order, np.arange(len(starts)) << 32 | ANYWHERE)
        rows, step = np.arange(len(group)), 0
        while len(rows):
            other = block[rows] + step
            rows, other = rows[other < len(starts)], other[other < len(starts)]
            longer = count[starts[other]] - count[rows]
            edits = count[starts[other]] // self.words_an_edit
            # Where a line is out of reach, so are all longer ones.
            near = (group[starts[other]] == group[rows]) & (longer <= edits)
            rows, other, longer, edits = rows[near], other[near], longer[near], edits[near]
            slack = (edits - longer) // 2
            fixed = at[rows] != ANYWHERE
            low = np.searchsorted(order, other << 32 | np.maximum(at[rows] - slack, 0))
            high = np.searchsorted(order, other << 32 | np.minimum(at[rows] + longer + slack, ANYWHERE - 1), "right")
            low, high = np.where(fixed, low, starts[other]), np.where(fixed, high, ends[other])
            yield rows, np.maximum(low, rows + 1), high
            yield rows[fixed], opened[other[fixed]], ends[other[fixed]]
            step += 1

    def alike(self, place_a: np.ndarray, place_b: np.ndarray, differing: np.ndarray) -> np.ndarray:
        return differing <= 2 * ((np.maximum(place_a, place_b) >> 32) // self.words_an_edit)


_NAMES = ("key", "sub", "side", "id", "place", "mark", "own")
# Pairs of rows compared at once.
_AT_ONCE = 1 << 19


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _alike(rows: dict[str, np.ndarray], rule):
    """Places of pairs of rows of different lines of a group, one with the part as its own, that ``rule`` finds alike.

    Rows are in order of group and place.
    """
    n = len(rows["id"])
    new = np.ones(n, dtype=bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["sub"][1:] != rows["sub"][:-1])
    place, mark, own, side, ids = (rows[c] for c in ("place", "mark", "own", "side", "id"))
    for at, low, high in rule.ranges(np.cumsum(new), place):
        for a, b in _ranges(at, low, high):
            ok = rule.alike(place[a], place[b], np.bitwise_count((mark[a] ^ mark[b]).view(np.uint64)))
            a, b = a[ok], b[ok]
            ok = (own[a] | own[b]) & (ids[a] != ids[b]) & ((side[a] != side[b]) | (side[a] < 0))
            yield a[ok], b[ok]


def _ranges(at: np.ndarray, low: np.ndarray, high: np.ndarray, at_once: int = _AT_ONCE):
    """Pairs of each ``at`` with all rows from its ``low`` to its ``high``, a bounded number (or one row's) at once."""
    some = high > low
    at, low, sizes = at[some], low[some], (high - low)[some]
    upto = np.cumsum(sizes)
    first = 0
    while first < len(at):
        before = upto[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(upto, before + at_once, "right")))
        a = np.repeat(at[first:last], sizes[first:last])
        yield a, np.arange(len(a)) + np.repeat(low[first:last] - (upto[first:last] - sizes[first:last] - before), sizes[first:last])
        first = last


def _pairs_of(rows: dict[str, np.ndarray], rule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids of different lines of a group that ``rule`` finds alike."""
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for a, b in _alike(rows, rule):
        left.append(rows["id"][a])
        right.append(rows["id"][b])
    return _distinct_pairs(np.concatenate(left), np.concatenate(right))


def _lines_of(rows: dict[str, np.ndarray], rule, led: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and keys of lines with a partner that ``rule`` finds alike, and each key's leader: itself where groups are not ``led``."""
    partnered = np.zeros(len(rows["id"]), dtype=bool)
    for a, b in _alike(rows, rule):
        partnered[a] = True
        partnered[b] = True
    ids, key = rows["id"][partnered], rows["key"][partnered]
    order = np.lexsort((ids, key))
    ids, key = ids[order], key[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (key[1:] != key[:-1])
    ids, key = ids[new], key[new]
    return ids, key, ids[np.searchsorted(key, key)] if led else key


def _compare(batches, rule, limit: int, pairs: bool):
    """What rows sorted by group come to; rows of groups beyond ``limit`` go on unread.

    Yields rows with ``a`` and ``b`` for ``pairs``, else with ``a`` (a line), ``b`` (its key) and
    ``leader``; and with ``key`` for rows that are to be compared in blocks. At most ``limit``
    rows of a group are held.
    """
    names = ["a", "b", "leader", "key", "id", "place", "mark", "own"]

    def found(rows):
        a, b, leader = (*_pairs_of(rows, rule), None) if pairs else _lines_of(rows, rule, limit < _NO_LIMIT)
        empty = pa.nulls(len(a), pa.int64())
        leader = empty if leader is None else pa.array(leader)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), leader, empty, empty, empty, empty, pa.nulls(len(a), pa.bool_())], names=names)

    def deferred(rows):
        empty = pa.nulls(len(rows["id"]), pa.int64())
        return pa.RecordBatch.from_arrays([empty, empty, empty, *(pa.array(rows[c]) for c in names[3:])], names=names)

    held, passing = None, None
    for batch in batches:
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _NAMES}
        if not len(rows["id"]):
            continue
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in _NAMES}
        starts, is_hot, cut, passing = _groups(rows["key"], rows["sub"], passing, limit)
        if is_hot.any():
            yield deferred({c: v[is_hot] for c, v in rows.items()})
        done = {c: v[:cut][~is_hot[:cut]] for c, v in rows.items()}
        if len(done["id"]):
            yield found(done)
        held = None if passing is not None else {c: v[cut:] for c, v in rows.items()}
    if held is not None:
        yield found(held)


_NO_LIMIT = 1 << 62


def _groups(key: np.ndarray, sub: np.ndarray, passing, limit: int):
    """Of rows sorted by group: which belong to groups beyond ``limit``, where the last group begins, and its name if it is such a one.

    ``passing`` is that name of the rows before.
    """
    starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1])
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    hot = sizes > limit
    if passing is not None and (key[0], sub[0]) == passing:
        hot[0] = True  # begun in earlier batches
    return starts, np.repeat(hot, sizes), int(starts[-1]), (key[-1], sub[-1]) if hot[-1] else None


_COMPARED = "a long, b long, leader long, key long, id long, place long, mark long, own boolean"


def candidate_pairs(spark: SparkSession, docs: DataFrame, edits: int = EDITS, near_chars: int = NEAR_CHARS, group_rows: int = GROUP_ROWS, fewer_words: int | None = None) -> DataFrame:
    """Pairs (``a``, ``b``) of ids of different lines (of ``fewer_words``) that may be within ``edits``: as many as there are."""
    keyed = keyed_lines(docs, edits, near_chars, None, fewer_words)
    return _meet(spark, _meeting_rows(spark, keyed, "c"), ByCharacters(edits), group_rows, pairs=True).select("a", "b")


def word_candidate_pairs(spark: SparkSession, docs: DataFrame, words_an_edit: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pairs (``a``, ``b``) of ids of different lines that may be near in words: as many as there are."""
    keyed = keyed_lines(docs, None, 0, words_an_edit)
    return _meet(spark, _meeting_rows(spark, keyed, "w"), ByWords(words_an_edit), group_rows, pairs=True).select("a", "b")


def _in_blocks(hot: DataFrame, key: str, group_rows: int) -> DataFrame:
    """Rows of groups too large for one task: every pair of their blocks of rows becomes a group, ``key`` and ``sub``."""
    sizes = hot.groupBy(key).agg(F.ceil(F.count(F.lit(1)) * 2 / F.lit(group_rows)).cast("int").alias("parts"))
    rows = hot.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select(
        *hot.columns,
        (F.least("part", "mate") * F.col("parts") + F.greatest("part", "mate")).alias("sub"),
        F.when(F.col("part") == F.col("mate"), F.lit(-1)).otherwise(F.col("part")).alias("side"),
    ).repartition(key, "sub")


def _meet(spark: SparkSession, parts: DataFrame, rule, group_rows: int, pairs: bool = False) -> DataFrame:
    """``a``, ``b``, ``leader`` of lines under keys where they have a likely partner, or (``pairs``) ``a`` and ``b`` of these."""
    parts = parts.select("key", F.lit(0).alias("sub"), F.lit(-1).alias("side"), "id", "place", "mark", "own")
    met = parts.repartition("key").sortWithinPartitions("key", "place")
    first = handover(spark, met.mapInArrow(lambda batches: _compare(batches, rule, group_rows, pairs), _COMPARED), "line-groups")
    hot = first.where("key IS NOT NULL").groupBy("key", "id", "place", "mark").agg(F.max("own").alias("own"))
    blocks = _in_blocks(hot, "key", group_rows).sortWithinPartitions("key", "sub", "place").select(*_NAMES)
    more = blocks.mapInArrow(lambda batches: _compare(batches, rule, _NO_LIMIT, pairs), _COMPARED).select("a", "b", "leader")
    if pairs:
        return first.where("a IS NOT NULL").select("a", "b", "leader").union(more).distinct()
    return first.where("a IS NOT NULL").select("a", "b", "leader").union(more.distinct())


def banded_distances(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Edit distances of pairs, exact where at most ``edits``, larger than that elsewhere."""
    codes = [tuple(np.frombuffer(x.encode("utf-32-le"), dtype="<u4") for x in p) for p in pairs]
    return banded_sequence_distances(codes, edits)


def banded_sequence_distances(pairs: list[tuple[np.ndarray, np.ndarray]], edits: int) -> np.ndarray:
    """Edit distances of pairs of code sequences, exact where at most ``edits`` (31 or fewer).

    Where lengths differ by at most ``edits``, never less than the distance: cells beyond the
    band count as one more than those beside them, which is the most they can be.
    A band of ``2 * edits + 1`` rows around the diagonal is kept as bit vectors of vertical
    differences, one small integer per pair; a step over one column serves all pairs.
    """
    if not pairs:
        return np.zeros(0, dtype=np.int64)
    ordered = [p if len(p[0]) >= len(p[1]) else p[::-1] for p in pairs]
    longer, shorter = zip(*ordered)
    rows, columns = np.array([len(x) for x in longer]), np.array([len(x) for x in shorter])
    width = 2 * edits + 1
    pattern = np.zeros((len(pairs), int(rows.max()) + width + 1), dtype=np.uint32)
    text = np.full((len(pairs), int(columns.max()) + 1), 1, dtype=np.uint32)
    # 0 and 1 stand for no symbol: codes are moved by two, and a sequence's end never matches.
    for k, (x, y) in enumerate(zip(longer, shorter)):
        pattern[k, edits : edits + len(x)] = x + 2
        text[k, : len(y)] = y + 2
    pattern, text = np.ascontiguousarray(pattern.T), np.ascontiguousarray(text.T)
    kind = np.uint16 if width < 15 else np.uint64
    full = kind((1 << width) - 1)
    up = np.full(len(pairs), (1 << width) - (1 << edits), dtype=kind)
    down = np.zeros(len(pairs), dtype=kind)
    far = rows - columns
    score = far.astype(np.int64)
    at = np.minimum(far + edits, width - 1).astype(kind)
    for j in range(int(columns.max())):
        match = np.zeros(len(pairs), dtype=kind)
        for b, byte in enumerate(np.packbits(pattern[j : j + width] == text[j], axis=0, bitorder="little")):
            match |= byte.astype(kind) << kind(8 * b)
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right, left = down | (full & ~(diagonal | up)), diagonal & up
        score += np.where(j < columns, 1 - ((diagonal >> at) & kind(1)).astype(np.int64), 0)
        moved = diagonal >> kind(1)
        up, down = (left | (full & ~(moved | right))), moved & right
    return np.where(far > edits, edits + 1, score)


_WHITE = SEPARATORS.decode()
_SPACE = re.compile("[" + re.escape(_WHITE) + "]+")


def word_distance(a: list, b: list) -> int:
    """Edit distance over words: bit vectors of vertical differences, as long as the line."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full, last, score = (1 << len(a)) - 1, len(a) - 1, len(a)
    up, down = full, 0
    for word in b:
        match = places.get(word, 0)
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right, left = down | (full & ~(diagonal | up)), diagonal & up
        score += (right >> last & 1) - (left >> last & 1)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | (full & ~(diagonal | right)), right & diagonal
    return score


# Edits whose band fits a machine word, and a band that most near pairs keep to.
_MOST_BANDED, _NARROW = 31, 7


def near_in_words(pairs: list[tuple[str, str]], words_an_edit: int) -> np.ndarray:
    """Whether edits of words, one for every ``words_an_edit`` of the longer line, suffice, for each pair.

    Shorter lines are near to none, not even to those of the same words in other white space.
    Pairs with equally many edits are verified together; few pairs, and those of lines too
    long for a band in a machine word, one by one.
    """
    known: dict[str, int] = {}
    coded: dict[str, np.ndarray] = {}

    def codes(line: str) -> np.ndarray:
        if line not in coded:
            coded[line] = np.array([known.setdefault(w, len(known)) for w in _SPACE.split(line)], dtype=np.uint32)
        return coded[line]

    cut = [(codes(a), codes(b)) for a, b in pairs]
    sizes = np.array([(len(a), len(b)) for a, b in cut], dtype=np.int64).reshape(-1, 2)
    longer = sizes.max(axis=1)
    allowed = longer // words_an_edit
    near = np.zeros(len(pairs), dtype=bool)
    possible = (allowed > 0) & (longer - sizes.min(axis=1) <= allowed)
    for edits in np.unique(allowed[possible]).tolist():
        chosen = np.flatnonzero(possible & (allowed == edits))
        near[chosen] = _within([cut[k] for k in chosen], edits, words_an_edit)
    return near


def _within(cut: list[tuple[np.ndarray, np.ndarray]], edits: int, words_an_edit: int) -> np.ndarray:
    """Whether pairs of word codes, of about ``edits * words_an_edit`` words at most, are within ``edits``."""
    near = np.zeros(len(cut), dtype=bool)
    # Their lengths bound the memory of a part.
    room = max(1, (1 << 21) // ((edits + 1) * words_an_edit))
    for first in range(0, len(cut), room):
        part = cut[first : first + room]
        if edits <= _MOST_BANDED and len(part) > 4 * edits:
            near[first : first + room] = banded_sequence_distances(part, edits) <= edits
        else:
            near[first : first + room] = [word_distance(*(x.tolist() for x in pair)) <= edits for pair in part]
    return near


def _near_in_chars(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    near = np.zeros(len(pairs), dtype=bool)
    sizes = np.array([max(len(a), len(b)) for a, b in pairs], dtype=np.int64)
    order, low = np.argsort(sizes, kind="stable"), 0
    while low < len(order):  # pairs of like length, bounded in characters
        high = low + 1
        while high < len(order) and (high + 1 - low) * sizes[order[high]] <= 1 << 21:
            high += 1
        part = order[low:high]
        near[part] = banded_distances([pairs[k] for k in part], edits) <= edits
        low = high
    return near


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every range in turn: which it is, and all of ``start .. start + count``."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def _parities(values: np.ndarray, row: np.ndarray, n_rows: int, bits: int) -> np.ndarray:
    """Of each row, which classes of values (modulo ``bits``) it has an odd number of; rows ascend."""
    out = np.zeros((n_rows, bits // 64), dtype=np.uint64)
    for first in range(0, n_rows, 1024):
        last = min(first + 1024, n_rows)
        low, high = np.searchsorted(row, [first, last])
        counts = np.bincount((row[low:high] - first) * bits + values[low:high] % bits, minlength=(last - first) * bits)
        out[first:last] = np.packbits((counts & 1).astype(bool)).reshape(last - first, -1).view(np.uint64)
    return out


class _Sets:
    """Sets of numbers, one a row, and which pairs of rows have one in common."""

    def __init__(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.known, codes = np.unique(values, return_inverse=True)
        self.counts, self.starts = counts, np.cumsum(counts) - counts
        self.codes = codes
        # Of a row and a value in it; numbers ascend within a row.
        self.table = np.repeat(np.arange(len(counts)), counts) * max(len(self.known), 1) + codes
        self.table.sort()

    def meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(a), dtype=bool)
        possible = np.flatnonzero((self.counts[a] > 0) & (self.counts[b] > 0))
        if not len(possible):
            return hit
        hit[possible] = self.codes[self.starts[a[possible]]] == self.codes[self.starts[b[possible]]]
        rest = possible[~hit[possible]]
        a, b = a[rest], b[rest]
        fewer = self.counts[a] <= self.counts[b]
        a, b = np.where(fewer, a, b), np.where(fewer, b, a)
        upto = np.cumsum(self.counts[a])
        first = 0
        while first < len(a):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + _AT_ONCE, "right")))
            which, at = _spread(self.starts[a[first:last]], self.counts[a[first:last]])
            wanted = b[first:last][which] * len(self.known) + self.codes[at]
            found = np.searchsorted(self.table, wanted)
            same = self.table[np.minimum(found, len(self.table) - 1)] == wanted
            hit[rest[first + which[same]]] = True
            first = last
        return hit


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all lines' words, equal for equal words, and how many each line has."""
    known: defaultdict = defaultdict(count().__next__)
    # White space for bytes is SEPARATORS.
    coded = [np.fromiter(map(known.__getitem__, line.encode().split()), dtype=np.int64) for line in lines]
    sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    return np.concatenate(coded) if coded else np.zeros(0, dtype=np.int64), sizes


def _common_words(codes: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words rows a and b have in common, in whatever order, each as often as both have it."""
    known = int(codes.max(initial=0)) + 1
    table, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * known + codes, return_counts=True)
    starts = np.searchsorted(table, np.arange(len(sizes) + 1) * known)
    kinds = np.diff(starts)
    fewer = kinds[a] <= kinds[b]
    a, b = np.where(fewer, a, b), np.where(fewer, b, a)
    out, upto, first = np.zeros(len(a), dtype=np.int64), np.cumsum(kinds[a]), 0
    while first < len(a):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + _AT_ONCE, "right")))
        which, at = _spread(starts[a[first:last]], kinds[a[first:last]])
        wanted = table[at] + (b[first:last] - a[first:last])[which] * known
        found = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        shared = np.where(table[found] == wanted, np.minimum(times[found], times[at]), 0)
        np.add.at(out[first:last], which, shared)
        first = last
    return out


def _near_by_words(codes: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, words_an_edit: int) -> np.ndarray:
    """Whether rows a and b of word codes are near in words.

    Changes alone, or beside one place where words were added or dropped, bound the distance
    from above and settle most; the others are verified without their equal ends.
    """
    starts = np.cumsum(sizes) - sizes
    longer = np.where(sizes[a] >= sizes[b], a, b)
    shorter = np.where(sizes[a] >= sizes[b], b, a)
    allowed, more = sizes[longer] // words_an_edit, sizes[longer] - sizes[shorter]
    near = np.zeros(len(a), dtype=bool)
    order, open_pairs, first = np.argsort(sizes[shorter], kind="stable"), [], 0
    while first < len(order):
        # Pairs of like length, bounded in words.
        width = sizes[shorter[order[first:]]]
        last = first + max(1, int(np.searchsorted(np.arange(1, len(width) + 1) * width, 1 << 19, "right")))
        part = order[first:last]
        n = sizes[shorter[part]][:, None]
        at = np.arange(int(n.max()))[None, :]
        inside = at < n
        at = np.where(inside, at, 0)
        x, y = starts[longer[part]][:, None] + at, codes[starts[shorter[part]][:, None] + at]
        ahead = (codes[x] != y) & inside
        behind = (codes[x + more[part][:, None]] != y) & inside
        least = np.minimum(np.cumsum(ahead.astype(np.int32) - behind, axis=1).min(axis=1), 0)
        near[part] = behind.sum(axis=1) + least + more[part] <= allowed[part]
        left = np.flatnonzero(~near[part])
        if len(left):
            n = n[left, 0]
            head = np.where(ahead[left].any(axis=1), ahead[left].argmax(axis=1), n)
            tail = np.where(behind[left].any(axis=1), n - behind.shape[1] + behind[left, ::-1].argmax(axis=1), n)
            tail = np.minimum(tail, n - head)
            open_pairs += zip(part[left].tolist(), head.tolist(), tail.tolist())
        first = last
    if open_pairs:
        at_pairs = np.array([k for k, _, _ in open_pairs], dtype=np.int64)
        common = _common_words(codes, sizes, a[at_pairs], b[at_pairs])
        possible = sizes[longer[at_pairs]] - common <= allowed[at_pairs]
        open_pairs = [x for x, ok in zip(open_pairs, possible.tolist()) if ok]
    cut = {k: tuple(codes[starts[r] + head : starts[r] + sizes[r] - tail].astype(np.uint32) for r in (longer[k], shorter[k])) for k, head, tail in open_pairs}
    # A distance within a narrow band is a bound from above, too.
    for band in (_NARROW, _MOST_BANDED):
        some = np.array([k for k in cut if not near[k] and more[k] <= band < allowed[k]], dtype=np.int64)
        some, first = some[np.argsort([len(cut[k][0]) for k in some.tolist()], kind="stable")], 0
        while first < len(some):
            width = np.array([len(cut[k][0]) for k in some[first:].tolist()])
            last = first + max(1, int(np.searchsorted(np.arange(1, len(width) + 1) * (width + 2 * band), 1 << 22, "right")))
            part = some[first:last]
            near[part] = banded_sequence_distances([cut[k] for k in part.tolist()], band) <= allowed[part]
            first = last
    rest = np.array([k for k in cut if not near[k]], dtype=np.int64)
    for edits in np.unique(allowed[rest]).tolist():
        some = rest[allowed[rest] == edits]
        near[some] = _within([cut[k] for k in some.tolist()], edits, words_an_edit)
    return near


def _near_rows(rows: pa.Table, edits: int, near_chars: int, words_an_edit: int | None) -> pa.RecordBatch:
    """Of whole groups: per line its near lines that count here and whether one of them occurs earlier."""
    key, sub, ids = (rows.column(c).to_numpy() for c in ("leader", "sub", "id"))
    # Documents that are there again bring their lines again.
    order = np.lexsort((ids, sub, key))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (sub[order][1:] != sub[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    rows = rows.take(pa.array(order[new])).combine_chunks()
    key, sub = rows.column("leader").to_numpy(), rows.column("sub").to_numpy()
    group = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])]))
    lines = rows.column("line").to_pylist()
    n_chars = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    codes, n_words = _codes(lines)
    size = n_chars if words_an_edit is None else n_words
    order = np.lexsort((size, group))
    rank = np.empty(len(order), dtype=np.int64)
    doc_id = rows.column("doc_id")
    rank[np.lexsort((rows.column("row_key").to_numpy(), rows.column("line_no").to_numpy(), doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy()))] = np.arange(len(order))

    eligible = n_chars >= max(near_chars, edits + 1)
    reach = size + edits
    if words_an_edit is not None:
        eligible &= n_words < 2 * edits * words_an_edit
        reach = np.maximum(reach, size * words_an_edit // (words_an_edit - 1) + 1)
        word_marks = _parities(codes, np.repeat(np.arange(len(lines)), n_words), len(lines), 1024)
    texts = "".join(line for line, short in zip(lines, eligible.tolist()) if short)
    chars = np.frombuffer(texts.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    row = np.repeat(np.flatnonzero(eligible), n_chars[eligible])
    inside = row[1:] == row[:-1]
    char_marks = _parities((chars[:-1] * 0x9E3779B1 + chars[1:] * 0x85EBCA6B >> 7)[inside], row[1:][inside], len(lines), 256)

    def sets(name):
        column = rows.column(name).combine_chunks()
        return _Sets(column.flatten().to_numpy(), column.value_lengths().to_numpy().astype(np.int64))

    here, before, side = sets("here"), sets("before"), rows.column("side").to_numpy()
    in_order = group[order] << 32 | size[order]
    high = np.searchsorted(in_order, group[order] << 32 | reach[order], "right")
    at = np.arange(len(order))
    links, late = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=bool)
    for a, b in _ranges(at, at + 1, high, 1 << 16):
        a, b = order[a], order[b]
        ok = (side[a] != side[b]) | (side[a] < 0)
        a, b = a[ok], b[ok]
        by_words = np.zeros(len(a), dtype=bool)
        if words_an_edit is not None:
            longer = np.maximum(n_words[a], n_words[b])
            allowed = longer // words_an_edit
            by_words = (allowed > 0) & (longer - np.minimum(n_words[a], n_words[b]) <= allowed)
            some = np.flatnonzero(by_words)
            by_words[some] = np.bitwise_count(word_marks[a[some]] ^ word_marks[b[some]]).sum(axis=1) <= 2 * allowed[some]
        by_chars = eligible[a] & eligible[b] & (np.abs(n_chars[a] - n_chars[b]) <= edits)
        some = np.flatnonzero(by_chars)
        by_chars[some] = np.bitwise_count(char_marks[a[some]] ^ char_marks[b[some]]).sum(axis=1) <= 4 * edits
        ok = by_words | by_chars
        a, b, by_words, by_chars = a[ok], b[ok], by_words[ok], by_chars[ok]
        ok = here.meet(a, b) & ~before.meet(a, b)
        a, b, by_words, by_chars = a[ok], b[ok], by_words[ok], by_chars[ok]
        near = by_words
        if words_an_edit is not None:
            near[by_words] = _near_by_words(codes, n_words, a[by_words], b[by_words], words_an_edit)
        rest = np.flatnonzero(by_chars & ~near)
        near[rest] = _near_in_chars([(lines[i], lines[j]) for i, j in zip(a[rest].tolist(), b[rest].tolist())], edits)
        a, b = a[near], b[near]
        links += np.bincount(a, minlength=len(links)) + np.bincount(b, minlength=len(links))
        late[np.where(rank[a] > rank[b], a, b)] = True
    some = pa.array(np.flatnonzero(links))
    found = rows.select(["row_key", "line_no"]).take(some)
    return found.append_column("n", pa.array(links[links > 0])).append_column("late", pa.array(late[links > 0]))


_LINE = "leader long, id long, row_key long, doc_id long, line_no int, here array<long>, before array<long>, line string"
_LINE_NAMES = [f.split()[0] for f in _LINE.split(", ")]
# Characters of lines that one batch holds, or one line.
_BATCH_CHARS = 1 << 23


def _lines_under_leaders(docs: DataFrame, firsts: DataFrame, met: DataFrame) -> DataFrame:
    """Every line once for each leader of its keys: its text, read where it first occurs, its keys led so and those of lesser leaders."""
    of_line = met.groupBy(F.col("a").alias("id")).agg(F.collect_list(F.struct("leader", F.col("b").alias("key"))).alias("keys"))
    places = firsts.join(of_line, "id").groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("line_no", "id", "keys")).alias("places"))

    def scan(batches):
        for batch in batches:
            row = np.repeat(np.arange(len(batch)), batch.column(3).value_lengths().to_numpy())
            line_no, ids, keys = batch.column(3).flatten().flatten()
            numbers, lines, last, cut = line_no.to_numpy(), [], -1, []
            for r, k in zip(row.tolist(), numbers.tolist()):
                if r != last:
                    last, cut = r, batch.column(2)[r].as_py().split("\n")
                lines.append(cut[k].strip(_WHITE))
            of = np.repeat(np.arange(len(lines)), keys.value_lengths().to_numpy())
            leader, key = (x.to_numpy() for x in keys.flatten().flatten())
            order = np.lexsort((key, leader, of))
            of, leader, key = of[order], leader[order], key[order]
            starts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (leader[1:] != leader[:-1])]))
            ends = np.append(starts[1:], len(of))
            begin = np.searchsorted(of, of[starts])
            texts = pa.array(lines, pa.large_string())
            size = np.cumsum(np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))[of[starts]] + (ends - begin) * 8) // _BATCH_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(starts)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                line = of[starts[i:j]]
                before = _spread(begin[i:j], starts[i:j] - begin[i:j])[1]
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(v))
                    for n, v in ((ends[i:j] - starts[i:j], key[starts[i] : ends[j - 1]]), (starts[i:j] - begin[i:j], key[before]))
                ]
                at = pa.array(row[line])
                columns = [pa.array(leader[starts[i:j]]), ids.take(pa.array(line)), batch.column(0).take(at), batch.column(1).take(at), line_no.take(pa.array(line))]
                yield pa.RecordBatch.from_arrays([*columns, *lists, texts.take(pa.array(line)).cast(pa.string())], names=_LINE_NAMES)

    return docs.join(places, "row_key").select("row_key", "doc_id", "text", "places").mapInArrow(scan, _LINE)


def _judge(batches, limit: int, edits: int, near_chars: int, words_an_edit: int | None):
    """Near lines of rows sorted by group; rows of groups beyond ``limit`` go on unread, without ``n``."""
    kinds = [("n", pa.int64()), ("late", pa.bool_())]
    held, passing, names = None, None, None

    def judged(rows):
        found = _near_rows(rows, edits, near_chars, words_an_edit)
        empty = {f.name: pa.nulls(len(found), f.type) for f in rows.schema}
        return pa.table([found.column(c) if c in found.column_names else empty[c] for c in names], names=names).combine_chunks().to_batches()

    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        names = [*_LINE_NAMES, "n", "late"]
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        _, is_hot, cut, passing = _groups(rows.column("leader").to_numpy(), rows.column("sub").to_numpy(), passing, limit)
        if is_hot.any():
            hot = rows.filter(pa.array(is_hot)).select(_LINE_NAMES)
            for name, kind in kinds:
                hot = hot.append_column(name, pa.nulls(len(hot), kind))
            yield from hot.combine_chunks().to_batches()
        done = rows.slice(0, cut).filter(pa.array(~is_hot[:cut]))
        if len(done):
            yield from judged(done)
        held = None if passing is not None else rows.slice(cut)
    if held is not None:
        yield from judged(held)
    batch = rows = held = done = None
    give_back()


def links(
    spark: SparkSession, docs: DataFrame, firsts: DataFrame, edits: int = EDITS, near_chars: int = NEAR_CHARS, words_an_edit: int | None = None, group_rows: int = GROUP_ROWS, buckets: int = BUCKETS
) -> DataFrame:
    """``row_key``, ``line_no``, ``n_links`` and ``late`` of lines (where they first occur) that others are within ``edits`` of, or near to in words.

    ``late`` tells whether one of these occurs earlier.
    """
    if words_an_edit is not None and words_an_edit < 2 * GRAM:
        raise ValueError(f"words_an_edit has to be {2 * GRAM} or more, for segments to hold {GRAM} words")
    # An edit of a character edits at most two words (a space between them comes or goes), so
    # a line of so many words that is within edits of another is near to it in words.
    fewer_words = None if words_an_edit is None else 2 * edits * words_an_edit
    # Every line where it first occurs, and no other, is read for its keys.
    places = firsts.groupBy("row_key").agg(F.collect_list("line_no").alias("at"))
    path = new_path(spark, "meeting-keys")
    chosen = docs.join(places, "row_key").select("row_key", "text", "at")
    meeting = handover(spark, _meeting_keys(keyed_lines(chosen, edits, near_chars, words_an_edit, fewer_words, buckets)), "meeting-keys", path)
    met = _meet(spark, _rows_under(meeting, "c"), ByCharacters(edits), group_rows)
    if words_an_edit is not None:
        met = met.union(_meet(spark, _rows_under(meeting, "w"), ByWords(words_an_edit), group_rows))
    met = handover(spark, met, "met-lines")
    discard(spark, path)
    rows = _lines_under_leaders(docs, firsts, met).select("*", F.lit(0).alias("sub"), F.lit(-1).alias("side"))
    rows = rows.repartition("leader").sortWithinPartitions("leader")
    schema = f"{_LINE}, n long, late boolean"
    first = handover(spark, rows.mapInArrow(lambda batches: _judge(batches, group_rows, edits, near_chars, words_an_edit), schema), "judged-lines")
    blocks = _in_blocks(first.where("n IS NULL").drop("n", "late"), "leader", group_rows).sortWithinPartitions("leader", "sub")
    more = blocks.mapInArrow(lambda batches: _judge(batches, _NO_LIMIT, edits, near_chars, words_an_edit), schema)
    found = first.where("n IS NOT NULL").select("row_key", "line_no", "n", "late").union(more.select("row_key", "line_no", "n", "late"))
    return handover(spark, found.groupBy("row_key", "line_no").agg(F.sum("n").alias("n_links"), F.max("late").alias("late")), "line-links")


def dedup_lines(spark: SparkSession, docs: DataFrame, edits: int = EDITS, near_chars: int = NEAR_CHARS, words_an_edit: int | None = None) -> DataFrame:
    """All rows with their columns in ``row``, and per row what its lines came to.

    ``kept_text`` is the text without the removed lines, ``n_lines`` counts lines with a word,
    ``n_removed`` those of them that go, ``n_links`` the near lines of those that occur first
    in this document.
    """
    source = docs.select(row_key(docs).alias("row_key"), named(docs, "text").cast("string").alias("text"), named(docs, "doc_id").cast("long").alias("doc_id"))
    found = handover(spark, occurrences(source), "lines")
    order = F.struct(F.col("doc_id").isNull().alias("without_id"), "doc_id", "line_no", "row_key")
    firsts = found.groupBy("id").agg(F.min(order).alias("first"), F.max("chars").alias("chars")).select("id", "first.*", "chars")
    firsts = handover(spark, firsts, "first-lines")
    # About as many keys as the lines have at most, but for lines of the shortest words.
    total = firsts.agg(F.sum(F.lit(12) + F.col("chars") / 8)).first()[0] or 0
    judged = links(
        spark, source.select("row_key", "text"), firsts.select("id", "row_key", "doc_id", "line_no"), edits, near_chars, words_an_edit, buckets=int(total) // BUCKET_KEYS + 1
    )

    # Other lines of a document with a word are equal to earlier ones.
    told = firsts.select("row_key", F.col("line_no").alias("first"), F.lit(None).cast("int").alias("late"), F.lit(0).cast("long").alias("n_links"))
    told = told.union(judged.select("row_key", F.lit(None).cast("int"), F.when(F.col("late"), F.col("line_no")), "n_links"))
    per_row = told.groupBy("row_key").agg(F.collect_list("first").alias("first"), F.collect_list("late").alias("late"), F.sum("n_links").alias("n_links"))

    @F.pandas_udf("kept_text string, n_lines long, n_removed long")
    def without(texts, first, late):
        import pandas as pd

        out = []
        for text, here, gone in zip(texts, first, late):
            if text is None:
                out.append((None, 0, 0))
                continue
            cut = text.split("\n")
            worded = [k for k, line in enumerate(cut) if line.strip(_WHITE)]
            kept = set() if here is None else set(here.tolist()).difference(gone.tolist())
            removed = [k for k in worded if k not in kept]
            if removed:
                for k in removed:
                    cut[k] = None
                text = "\n".join(line for line in cut if line is not None)
            out.append((text, len(worded), len(removed)))
        return pd.DataFrame(out, columns=["kept_text", "n_lines", "n_removed"])

    rows = packed(docs, row_key=row_key(docs), text=named(docs, "text").cast("string")).join(per_row, "row_key", "left")
    rows = rows.select("row", "n_links", without("text", "first", "late").alias("found"))
    return rows.select("row", "found.kept_text", "found.n_lines", "found.n_removed", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, edits: int = EDITS, near_chars: int = NEAR_CHARS, words_an_edit: int | None = None) -> DataFrame:
    """The documents with the same columns, ``text`` (and ``n_chars``, if there) brought up to date."""
    result = dedup_lines(spark, docs, edits, near_chars, words_an_edit)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    kinds = dict(docs.dtypes)
    fields = [(new[c].cast(kinds[c]) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return result.select(*fields)
