"""Alignment of two tokenizations of the same bytes, and how their tokens correspond.

The ends of both tokenizers' tokens are byte offsets in a space and the text. An alignment is
found by divide and conquer: the end near the middle of an interval of the first tokenizer's
tokens that the second one's ends also hold, located by bisection and sought outwards from the
middle, cuts the interval, and both halves are treated likewise; an interval without a common
end is one group. All intervals of a chunk of texts take a step together.

Tokens whose bytes overlap are linked. How many documents hold a pair of ids linked is
counted over the whole corpus. Texts are read once: a chunk of them is written as one row
with its distinct pairs and, per document, which of them it holds how often. Only the
chunks' distinct pairs are counted and joined with the counts; what comes back to a chunk is
one number for each of them, so no row per document and pair is ever shuffled. What a
document holds goes through Spark in bytes, three for a pair, and workers are handed few rows
at once: an executor's memory does not follow the size of the table or of its partitions.

Texts are encoded in parts, cut at single spaces between two characters that are not white
space, and parts met before are looked up. That no token reaches over such a cut is derived
from the tokenizers' own files; tokenizers for which it does not follow encode texts whole.
New parts are strung together again, by such spaces, to be encoded many in one call, and
their ids cut apart by their bytes; where these do not come back, part by part.

Defined results: texts that are null, empty, or not given back byte by byte by both
tokenizers have no tokens, no groups and an empty digest; null ids, and rows that repeat an
id and text, are rows of the result each; an empty table gives an empty result. Other
columns, of whatever names, are not read.
"""

from __future__ import annotations

import json
import os
import re
from contextlib import contextmanager
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.llm.common import give_back, handover, named

CHUNK_CHARS = 1 << 20
# Characters that a row counts for at least, as each has numbers and a digest.
LEAST_CHARS = 64
# Documents, and chunks of them, that a worker is handed at once.
BATCH_DOCS, BATCH_CHUNKS = 256, 16
CACHE_PARTS, CACHE_TOKENS = 300_000, 6_000_000
# Characters that one call hands to a tokenizer, and of the parts strung together in it.
CALL_CHARS = 1 << 22
STRING_CHARS = 1 << 12
# A space between two characters neither of which is white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE_SIGN = "▁"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes of Latin-1 stand for themselves, the others, in order, are moved behind
    all of them.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A tokenizer of the tokenizers library over a byte-level vocabulary."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        made_of = json.loads(self.tokenizer.to_str())
        before = made_of["pre_tokenizer"] or {}
        # The library's own splitting at word starts: white space only ever begins a piece.
        self.by_parts = made_of["normalizer"] is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        alphabet = byte_level_alphabet()
        self.bytes: list[bytes] = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes[number] = bytes(alphabet[c] for c in token)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model, which puts a space before a text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.processor.serialized_model_proto())
        rules, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
        # Merges make pieces of the vocabulary: none joins a word with a space behind it.
        joins = any(re.search(f"[^{_SPACE_SIGN}]{_SPACE_SIGN}", p.piece) for p in model.pieces)
        own = any(p.type == kinds.USER_DEFINED for p in model.pieces)
        bpe = model.trainer_spec.model_type == model.trainer_spec.BPE and not model.trainer_spec.treat_whitespace_as_suffix
        self.by_parts = bool(plain and bpe and not joins and not own)
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(_SPACE_SIGN, " ").encode() for p in model.pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of ``start .. start + count`` for every range, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


class _Known:
    """Ids of parts met before by one tokenizer."""

    def __init__(self) -> None:
        self.data, self.start, self.count = np.zeros(1 << 16, dtype=np.int32), [], []
        self.used = 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(len(self.data), dtype=np.int32)])
        self.data[self.used : self.used + len(flat)] = flat
        self.start.append(self.used + np.cumsum(sizes) - sizes)
        self.count.append(sizes)
        self.used += len(flat)

    def of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.start, self.count = [np.concatenate(self.start)], [np.concatenate(self.count)]
        counts = self.count[0][slots]
        return self.data[_spread(self.start[0][slots], counts)], counts


class Encoders:
    """Both tokenizers and what they made of parts met before."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.by_parts = self.a.by_parts and self.b.by_parts
        self.length_a, self.length_b = (np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (self.a, self.b))
        # Ids in decimals with what follows them: in a group, at its side's end, at a text's end.
        self.signs = [b"%d%c" % (i, s) for i in range(len(self.a.bytes)) for s in b",|"]
        self.first_b = len(self.signs)
        self.signs += [b"%d%s" % (i, s) for i in range(len(self.b.bytes)) for s in (b",", b";", b"")]
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.known_a, self.known_b, self.sound = _Known(), _Known(), []

    def learn(self, parts: list[str]) -> None:
        first = 0
        while first < len(parts):
            last, size = first, 0
            while last < len(parts) and (size < CALL_CHARS):
                size += len(parts[last]) + 1
                last += 1
            some = parts[first:last]
            if self.by_parts:
                # Only between other characters than white space is a space a cut.
                apart = [p for p in some if p[0].isspace() or p[-1].isspace()]
                strung = [p for p in some if not (p[0].isspace() or p[-1].isspace())]
                apart += self._learn_strung(strung)
            else:
                apart = some
            self._learn_apart(apart)
            first = last

    def _known(self, parts: list[str], a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], sound: np.ndarray) -> None:
        self.known_a.add(*a)
        self.known_b.add(*b)
        self.sound.append(sound)
        self.slots.update(zip(parts, range(len(self.slots), len(self.slots) + len(parts))))

    def _learn_apart(self, parts: list[str]) -> None:
        if not parts:
            return
        a, b = self.a.encode(parts), self.b.encode(parts)
        bytes_a, bytes_b = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        wanted = [(" " + p).encode() for p in parts]
        sound = np.array([b"".join(map(bytes_a, x)) == w == b"".join(map(bytes_b, y)) for x, y, w in zip(a, b, wanted)], dtype=bool)
        flat = [(np.fromiter(chain.from_iterable(ids), dtype=np.int32), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))) for ids in (a, b)]
        self._known(parts, *flat, sound)

    def _learn_strung(self, parts: list[str]) -> list[str]:
        """Learn parts, many in one text; those are left over whose bytes do not come back."""
        if not parts:
            return []
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
        of_string = (np.cumsum(lengths) - lengths) // STRING_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(of_string)) + 1).tolist(), len(parts)]
        strings = [" ".join(parts[i:j]) for i, j in zip(cuts[:-1], cuts[1:]) if j > i]
        encoded = (self.a.encode(strings), self.b.encode(strings))
        good, ids, sizes, left = [], ([], []), ([], []), []
        for k, string in enumerate(strings):
            some = parts[cuts[k] : cuts[k + 1]]
            wanted = (" " + string).encode()
            of_part = lengths[cuts[k] : cuts[k + 1]] if len(wanted) == len(string) + 1 else np.array([len(p.encode()) + 1 for p in some])
            borders = np.cumsum(of_part)
            counted = []
            for x, tokenizer, token_bytes in ((encoded[0][k], self.a, self.length_a), (encoded[1][k], self.b, self.length_b)):
                if b"".join(map(tokenizer.bytes.__getitem__, x)) != wanted:
                    break
                x = np.array(x, dtype=np.int32)
                ends = np.cumsum(token_bytes[x])
                at = np.searchsorted(ends, borders)
                # A token without bytes belongs to no part.
                if not (ends[at] == borders).all() or not token_bytes[x].all():
                    break
                counted.append((x, np.diff(at, prepend=-1)))
            if len(counted) < 2:
                left += some
                continue
            good += some
            for side, (x, n) in enumerate(counted):
                ids[side].append(x)
                sizes[side].append(n)
        if good:
            a, b = ((np.concatenate(ids[side]), np.concatenate(sizes[side])) for side in (0, 1))
            self._known(good, a, b, np.ones(len(good), dtype=bool))
        return left

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of both tokenizers and how many of them each text has: none where a text has no tokens."""
        cut = [[] if not t else _CUT.split(t) if self.by_parts else [t] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.slots)
        if len(self.slots) + len(new) > CACHE_PARTS or self.known_a.used > CACHE_TOKENS:
            self.forget()
            new = set(chain.from_iterable(cut))
        self.learn(sorted(new))
        sizes = np.array([len(c) for c in cut], dtype=np.int64)
        slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(sizes.sum()))
        text = np.repeat(np.arange(len(texts)), sizes)
        if len(slots):
            self.sound = [np.concatenate(self.sound)]
            failed = np.bincount(text[~self.sound[0][slots]], minlength=len(texts)) > 0
            slots, text = slots[~failed[text]], text[~failed[text]]
        out = []
        for known in (self.known_a, self.known_b):
            ids, counts = known.of(slots) if len(slots) else (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))
            of_text = np.zeros(len(texts), dtype=np.int64)
            np.add.at(of_text, text, counts)
            out += [ids, of_text]
        return out


def _nearest_cut(ends_a: np.ndarray, ends_b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For intervals of positions of ``ends_a``: the one nearest the middle whose end is in ``ends_b``, or -1.

    Positions at growing distances are bisected into ``ends_b``, for all intervals at once.
    """
    middle = (low + high) >> 1
    found = np.full(len(low), -1)
    pending, near, far = np.arange(len(low)), 0, 1
    while len(pending):
        lo, hi, mid = low[pending], high[pending], middle[pending]
        left, left_end = np.maximum(lo, mid - far + 1), np.maximum(lo, mid - near + 1)
        right, right_end = np.minimum(hi, mid + max(near, 1)), np.minimum(hi, mid + far)
        starts = np.concatenate([left, right])
        counts = np.concatenate([left_end - left, np.maximum(right_end - right, 0)])
        which = np.repeat(np.concatenate([pending, pending]), counts)
        at = _spread(starts, counts)
        value = ends_a[at]
        shared = ends_b[np.searchsorted(ends_b, value)] == value
        which, at = which[shared], at[shared]
        # Distance first, the left of two equally near.
        rank = np.abs(at - middle[which]) * 2 + (at > middle[which])
        best = np.full(len(low), 1 << 62)
        np.minimum.at(best, which, rank)
        hit = best[which] == rank
        found[which[hit]] = at[hit]
        open_still = (found[pending] < 0) & ((mid - far >= lo) | (mid + far < hi))
        pending, near, far = pending[open_still], far, far * 4
    return found


def common_cuts(ends_a: np.ndarray, ends_b: np.ndarray, counts_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``ends_a`` and ``ends_b`` of all common ends, by divide and conquer.

    Offsets run on over the texts, of which ``counts_a`` have so many tokens of the first
    tokenizer; a text's last end is common to both.
    """
    high = np.cumsum(counts_a)
    low = (high - counts_a)[counts_a > 0]
    high = high[counts_a > 0] - 1
    cuts = [high]
    while True:
        inside = high > low
        low, high = low[inside], high[inside]
        if not len(low):
            break
        cut = _nearest_cut(ends_a, ends_b, low, high)
        split = cut >= 0
        low, high, cut = low[split], high[split], cut[split]
        cuts.append(cut)
        low, high = np.concatenate([low, cut + 1]), np.concatenate([cut, high])
    at = np.sort(np.concatenate(cuts))
    return at, np.searchsorted(ends_b, ends_a[at])


class Aligned:
    """A chunk of texts in both tokenizations, cut into groups."""

    def __init__(self, encoders: Encoders, texts: list[str | None]) -> None:
        self.encoders = encoders
        self.a, self.n_a, self.b, self.n_b = encoders.encode(texts)
        self.ends_a, self.ends_b = np.cumsum(encoders.length_a[self.a]), np.cumsum(encoders.length_b[self.b])
        self.cut_a, self.cut_b = common_cuts(self.ends_a, self.ends_b, self.n_a)
        self.last_a, self.last_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        self.text_of_cut = np.searchsorted(self.last_a, self.cut_a, "right")
        self.n_groups = np.bincount(self.text_of_cut, minlength=len(texts))
        self.n_links = self.n_a + self.n_b - self.n_groups

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups, written in decimals."""
        size_a, size_b = np.diff(self.cut_a, prepend=-1), np.diff(self.cut_b, prepend=-1)
        end_a, begin_b = self.cut_a + 1, self.cut_b + 1 - size_b
        codes = np.zeros(len(self.a) + len(self.b), dtype=np.int64)
        sign_a = self.a.astype(np.int64) * 2
        sign_a[self.cut_a] += 1
        codes[np.arange(len(self.a)) + np.repeat(begin_b, size_a)] = sign_a
        sign_b = self.b.astype(np.int64) * 3 + self.encoders.first_b
        sign_b[self.cut_b] += 1
        sign_b[self.last_b[self.n_b > 0] - 1] += 1
        codes[np.arange(len(self.b)) + np.repeat(end_a, size_b)] = sign_b
        out, last, sign = [], 0, self.encoders.signs.__getitem__
        for n in (self.n_a + self.n_b).tolist():
            digest, first, last = sha256(), last, last + n
            for low in range(first, last, 1 << 16):
                digest.update(b"".join(map(sign, codes[low : min(low + (1 << 16), last)].tolist())))
            out.append(digest.hexdigest() if n else "")
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and pair (first id times the second vocabulary plus second id) of every link.

        Between two neighbouring ends, of either tokenizer, lies the overlap of one pair.
        """
        alone = np.ones(len(self.b), dtype=bool)
        alone[self.cut_b] = False
        at_b = np.flatnonzero(alone)
        a = np.concatenate([np.arange(len(self.a)), np.searchsorted(self.ends_a, self.ends_b[at_b])])
        b = np.concatenate([np.searchsorted(self.ends_b, self.ends_a), at_b])
        return np.searchsorted(self.last_a, a, "right"), self.a[a].astype(np.int64) * len(self.encoders.b.bytes) + self.b[b]


_ENCODERS: dict[tuple[str, str], Encoders] = {}


def _encoders(path_a: str, path_b: str) -> Encoders:
    """One pair of tokenizers per worker, so that parts are known from task to task."""
    if (path_a, path_b) not in _ENCODERS:
        _ENCODERS[path_a, path_b] = Encoders(path_a, path_b)
    return _ENCODERS[path_a, path_b]


def _chunks(batches):
    """Ids and texts, about ``CHUNK_CHARS`` of them or one longer text at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i in range(len(batch)):
            text = batch.column(1)[i].as_py()
            chars = max(len(text or ""), LEAST_CHARS)
            if ids and size + chars > CHUNK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(batch.column(0)[i].as_py())
            texts.append(text)
            size += chars
    if ids:
        yield ids, texts


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(named(docs, doc_id).cast("long").alias("doc_id"), named(docs, text).cast("string").alias("text"))


def aligned_tokens(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``a`` and ``b``, the ids, and ``a_ends`` and ``b_ends``, how many of them lie before each group's end."""

    def scan(batches):
        encoders = _encoders(path_a, path_b)
        for ids, texts in _chunks(batches):
            x = Aligned(encoders, texts)
            first_a, first_b = x.last_a - x.n_a, x.last_b - x.n_b
            ends = np.cumsum(x.n_groups)
            lists = [
                (x.a, np.concatenate([[0], x.last_a])),
                (x.b, np.concatenate([[0], x.last_b])),
                (x.cut_a + 1 - first_a[x.text_of_cut], np.concatenate([[0], ends])),
                (x.cut_b + 1 - first_b[x.text_of_cut], np.concatenate([[0], ends])),
            ]
            arrays = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v.astype(np.int32))) for v, o in lists]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *arrays], names=["doc_id", "a", "b", "a_ends", "b_ends"])

    return _source(docs, doc_id, text).mapInArrow(scan, "doc_id long, a array<int>, b array<int>, a_ends array<int>, b_ends array<int>")


_DOC = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
# Of a chunk: its documents, its distinct pairs and in how many documents each is, and, see
# ``packed_holds``, which pairs each document holds and how often.
_CHUNK = (
    "chunk long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>, "
    "pairs array<long>, in_docs array<int>, per_doc binary, held binary, times binary"
)


def _one_list(values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def packed_holds(held_by: np.ndarray, held: np.ndarray, times: np.ndarray, n_docs: int, n_pairs: int) -> list[bytes]:
    """How many entries each document has; and of the entries the pair's position, in two bytes if these do, and how many links, in one.

    Over 255 links of a document and pair are more than one entry.
    """
    order = np.argsort(held_by, kind="stable")
    held_by, held, times = held_by[order], held[order], times[order]
    entries = (times + 254) // 255
    in_bytes = np.full(int(entries.sum()), 255, dtype="<u1")
    in_bytes[np.cumsum(entries) - 1] = times - 255 * (entries - 1)
    per_doc = np.bincount(np.repeat(held_by, entries), minlength=n_docs)
    return [per_doc.astype("<u4").tobytes(), np.repeat(held.astype("<u2" if n_pairs <= 1 << 16 else "<u4"), entries).tobytes(), in_bytes.tobytes()]


def sums_of_holds(per_doc, held, times, *values: np.ndarray) -> list[np.ndarray]:
    """For each document the sum over its links of each of ``values``, which the pairs have by position."""
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(per_doc, dtype="<u4"), dtype=np.int64)])
    times = np.frombuffer(times, dtype="<u1")
    held = np.frombuffer(held, dtype="<u4" if len(held) == 4 * len(times) else "<u2")
    return [np.diff(np.concatenate([[0], np.cumsum(v[held] * times)])[ends]) for v in values]


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Python workers of what runs inside are handed so many rows at once at most."""
    before = spark.conf.get(_BATCH_ROWS)
    # Zero and less stand for no limit.
    spark.conf.set(_BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def link_chunks(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chunk of documents, aligned: see ``_CHUNK``. Meant to be written before use."""

    def scan(batches):
        encoders = _encoders(path_a, path_b)
        first = TaskContext.get().partitionId() << 32
        for number, (ids, texts) in enumerate(_chunks(batches)):
            x = Aligned(encoders, texts)
            text_of, pair = x.links()
            each, times = np.unique(pair * len(texts) + text_of, return_counts=True)
            pair, held_by = each // len(texts), each % len(texts)
            pairs, held, in_docs = np.unique(pair, return_inverse=True, return_counts=True)
            columns = [pa.array(ids, pa.int64()), *(pa.array(v, pa.int64()) for v in (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array(x.digests())]
            rows = pa.StructArray.from_arrays(columns, fields=[pa.field(*f) for f in _DOC])
            lists = [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), rows),
                _one_list(pairs, pa.int64()),
                _one_list(in_docs.astype(np.int32), pa.int32()),
                *(pa.array([v], pa.binary()) for v in packed_holds(held_by, held, times, len(texts), len(pairs))),
            ]
            names = ["chunk", "docs", "pairs", "in_docs", "per_doc", "held", "times"]
            yield pa.RecordBatch.from_arrays([pa.array([first + number], pa.int64()), *lists], names=names)
        # Workers stay for later stages, whose memory theirs is taken from.
        encoders.forget()
        give_back()

    return _source(docs, doc_id, text).mapInArrow(scan, _CHUNK)


def pair_counts(chunks: DataFrame, vocabulary_b: int) -> DataFrame:
    """``pair``, ``n`` (documents that hold it linked) and whether no pair of its first id has more."""
    counted = chunks.select(F.explode(F.arrays_zip("pairs", "in_docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.in_docs").alias("n"))
    first_id = F.expr(f"pair div {vocabulary_b}")
    highest = counted.groupBy(first_id.alias("a")).agg(F.max("n").alias("most"))
    return counted.withColumn("a", first_id).join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its numbers of tokens, groups and links, and what its links come to over the corpus.

    ``n_best`` counts links that no pair of the same first id exceeds in documents,
    ``count_sum`` adds up the pairs' documents over the links.
    """
    with batches_of(spark, BATCH_DOCS):
        chunks = handover(spark, link_chunks(docs, path_a, path_b, doc_id, text), "alignment-chunks")
    counts = handover(spark, pair_counts(chunks, len(_encoders(path_a, path_b).b.bytes)), "alignment-pairs")
    wanted = chunks.select("chunk", F.posexplode("pairs").alias("at", "pair"))
    # A chunk's pairs are bounded by its texts.
    told = wanted.join(counts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("at", "n", "best")).alias("told"))
    joined = chunks.select("chunk", "docs", "per_doc", "held", "times").join(told, "chunk", "left").select("docs", "per_doc", "held", "times", "told")

    def total(batches):
        for batch in batches:
            for row in range(len(batch)):
                docs_of = batch.column(0)[row].values
                n, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
                if batch.column(4)[row].is_valid:
                    told_of = batch.column(4)[row].values
                    at = np.asarray(told_of.field("at"))
                    n, best = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
                    n[at], best[at] = np.asarray(told_of.field("n")), np.asarray(told_of.field("best").cast(pa.int64()))
                sums = sums_of_holds(*(batch.column(k)[row].as_buffer() for k in (1, 2, 3)), best, n)
                columns = [docs_of.field(name) for name, _ in _DOC]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sums)], names=[*(name for name, _ in _DOC), "n_best", "count_sum"])
        give_back()

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    with batches_of(spark, BATCH_CHUNKS):
        # Chunks are large and what is left of them small: few files, not one for each task.
        return handover(spark, joined.mapInArrow(total, schema).hint("rebalance"), "alignment-totals")
