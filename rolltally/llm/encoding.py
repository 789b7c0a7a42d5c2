"""Token ids of texts, by the tokenizers library, with a cache of what was encoded before.

For a tokenizer whose file says that it lower-cases, drops white space, cuts words apart and
marks their ends, texts of ASCII and Latin-1 letters without apostrophes and special markers
are cut into the pieces that it cuts itself (runs of letters, digits, runs of other signs);
pieces not met before are encoded together, and a piece ends where a token ends a word. All
other texts, and all texts for other tokenizers, go to the library whole. Both ways give the
same ids.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

CACHE_PIECES = 1_000_000

_PLAIN = re.compile(r"[^\x09-\x0d\x20-\x26\x28-\x7eÀ-ÖØ-öø-ÿ]|<\|")
_PIECE = re.compile(r"[a-zà-öø-ÿß]+|[0-9]|[!-/:-@\[-`{-~]+")


# Fixed value: how the tokenizer that is known to allow it cuts words.
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def cuts_at_words(made_of: dict) -> bool:
    """Whether a tokenizer, by its file, encodes the pieces of ``_PIECE`` one by one and in lower case."""
    first, then = made_of.get("normalizer") or {}, made_of.get("pre_tokenizer") or {}
    normal = [n.get("type") for n in first.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    steps = then.get("pretokenizers", [])
    if not normal or [s.get("type") for s in steps] != ["Split", "ByteLevel"]:
        return False
    split, level = steps
    by_words = split["pattern"] == {"Regex": _WORDS} and split["behavior"] == "Removed" and split["invert"]
    return by_words and not level["use_regex"] and not level["add_prefix_space"] and made_of["model"].get("end_of_word_suffix") == "</w>"


class CachedEncoder:
    """Encodes lists of texts into arrays of ids; ``literal_markers`` reads special markers as text."""

    def __init__(self, path: str, literal_markers: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal_markers
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        self.by_pieces = cuts_at_words(json.loads(self.tokenizer.to_str()))
        self.ends = np.zeros(self.vocabulary, dtype=bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[number] = token.endswith("</w>")
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=self.kind).tobytes()

    def learn(self, pieces: list[str]) -> None:
        for first in range(0, len(pieces), 2000):
            part = pieces[first : first + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype=self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):  # not a tokenizer that marks word ends
                self.cache.update((p, self.whole(p)) for p in part)
                continue
            data, size, last = ids.tobytes(), self.kind.itemsize, 0
            for piece, end in zip(part, ends.tolist()):
                self.cache[piece] = data[last * size : end * size]
                last = end

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for first in range(0, len(texts), 64):
            part = texts[first : first + 64]
            cut = [None if t and (not self.by_pieces or _PLAIN.search(t)) else _PIECE.findall(t.lower()) if t else [] for t in part]
            new = set().union(*(x for x in cut if x)).difference(self.cache)
            if len(self.cache) + len(new) > CACHE_PIECES:
                self.cache.clear()
                new = set().union(*(x for x in cut if x))
            self.learn(sorted(new))
            known = self.cache.__getitem__
            for text, pieces in zip(part, cut):
                data = self.whole(text) if pieces is None else b"".join(map(known, pieces))
                out.append(np.frombuffer(data, dtype=self.kind))
        return out


_ENCODERS: dict[tuple[str, bool], CachedEncoder] = {}


def encoder(path: str, literal_markers: bool = False) -> CachedEncoder:
    """One encoder per worker, so that the cache lasts from task to task."""
    key = (path, literal_markers)
    if key not in _ENCODERS:
        _ENCODERS[key] = CachedEncoder(*key)
    return _ENCODERS[key]
