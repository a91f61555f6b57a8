"""Byte-level pre-tokens of a text as the tokenizers library cuts them, and a bounded cache of their ids."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers.pre_tokenizers import ByteLevel

#: The split pattern and the two ranges of bytes that stand for themselves, of public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = ((33, 126), (161, 172), (174, 255))
#: Distinct pre-tokens and distinct pieces that a worker holds; it starts afresh beyond that.
CACHE, PIECES = 600_000, 300_000


def byte_chars() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    own = [b for low, high in PRINTABLE for b in range(low, high + 1)]
    out = {chr(b): b for b in own}
    rest = sorted(set(range(256)) - set(own))
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(1)
def splitter():
    """text -> pre-tokens. The regex module may know letters of a later Unicode than the tokenizers library: of the
    characters that are new to either, the library itself is asked once, and texts that hold one it takes for no letter
    or digit get the same pattern with those taken out of its classes."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    new = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    asked = ByteLevel(add_prefix_space=False).pre_tokenize_str
    code = np.array([ord(c) for c in new if len(asked("a" + c)) == 2 and len(asked("1" + c)) == 2])
    runs = np.split(code, np.flatnonzero(np.diff(code) > 1) + 1) if len(code) else []
    odd = "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs)
    plain = regex.compile(PATTERN).findall
    if not odd:
        return plain
    has_odd = re.compile(f"[{odd}]").search
    out = f"[{odd}]"
    letter, digit, other = rf"[\p{{L}}--{out}]", rf"[\p{{N}}--{out}]", rf"[^\s[\p{{L}}\p{{N}}--{out}]]"
    # The same alternatives in the same order, with the three classes replaced.
    pattern = PATTERN.replace(r"[^\s\p{L}\p{N}]", "OTHER").replace(r"\p{L}", letter).replace(r"\p{N}", digit).replace("OTHER", other)
    careful = regex.compile(pattern, regex.V1).findall
    return lambda text: plain(text) if text.isascii() or not has_odd(text) else careful(text)


class Vocabulary:
    """What a tokenizers file says: byte ids, merges, bytes of each id, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(chars[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.byte_ids[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None


class CachedEncoder:
    """text -> ids, with the ids of each distinct pre-token made once by encode_words.

    A space that a character other than white space follows always begins a pre-token, whatever stands before it, and the
    pattern never looks back; so a text whose spaces are all of that kind is the sum of its space-separated pieces, which
    are looked up whole.
    """

    def __init__(self, vocabulary: Vocabulary, encode_words):
        self.vocabulary, self.encode_words = vocabulary, encode_words
        self.cache: dict[str, bytes] = {}  # of pre-tokens
        self.pieces: dict[str, bytes] = {}  # of pieces that follow a space
        self.split = splitter()
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in vocabulary.added.items()}
        self.uneven = re.compile(r" (?:\s|\Z)").search

    def _learn(self, words: set[str]) -> None:
        """Puts the ids of all words in the cache."""
        new = words.difference(self.cache)
        if new:
            if len(self.cache) + len(new) > CACHE:
                self.cache, new = {}, words
            new = list(new)
            self.cache.update(zip(new, self.encode_words(new), strict=True))

    def _learn_pieces(self, seen: set[str]) -> None:
        new = seen.difference(self.pieces)
        if new:
            if len(self.pieces) + len(new) > PIECES:
                self.pieces, new = {}, seen
            new = list(new)
            cut = self._cut([" " + p for p in new])
            self.pieces.update(zip(new, cut, strict=True))

    def _cut(self, texts: list[str]) -> list[bytes]:
        tokens = list(map(self.split, texts))
        words: set[str] = set()
        words.update(*tokens)
        self._learn(words)
        get = self.cache.__getitem__
        return [b"".join(map(get, t)) for t in tokens]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Texts without added tokens."""
        out: list[bytes] = [b""] * len(texts)
        even = [k for k, t in enumerate(texts) if t and not self.uneven(t)]
        rest = [k for k, t in enumerate(texts) if t and self.uneven(t)]
        parts = [texts[k].split(" ") for k in even]
        heads = self._cut([p[0] for p in parts])
        seen: set[str] = set()
        for p in parts:
            p[0] = p[-1]
            seen.update(p)
        self._learn_pieces(seen)
        get = self.pieces.__getitem__
        for k, head, p in zip(even, heads, parts, strict=True):
            out[k] = head + b"".join(map(get, p[1:]))
        for k, ids in zip(rest, self._cut([texts[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        special = self.vocabulary.special
        if special is None:
            return self._plain(texts)
        cut = [special.split(t) if any(a in t for a in self.added) else [t] for t in texts]
        plain = iter(self._plain([p for parts in cut for p in parts[::2]]))
        return [b"".join(self.added[p] if k % 2 else next(plain) for k, p in enumerate(parts)) for parts in cut]
