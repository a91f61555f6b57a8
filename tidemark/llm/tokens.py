"""Ids of whole texts as the tokenizers library makes them, at the speed of tiktoken where the two agree by construction.

A byte-level vocabulary whose ids are in merge order is a tiktoken vocabulary too; the same merges on the same pre-tokens
give the same ids. Texts that hold an added token, or a character that is newer than the Unicode data at hand (where the
two libraries' classes may differ), go through the tokenizers library itself, as does a vocabulary of another kind.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from .pretokens import PATTERN, Vocabulary


class Ids:
    def __init__(self, path: str):
        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        v = Vocabulary(path)
        self.size = len(v.bytes)
        self.added = list(v.added)
        self.fast = None
        if (np.diff(v.merged) > 0).all() and v.byte_ids.max() < v.merged.min():
            ranks = {b: i for i, b in enumerate(v.bytes) if i not in set(v.added.values())}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        self.new = np.zeros(0x110000, bool)
        self.new[[ord(c) for c in regex.findall(r"[\p{L}\p{N}\s]", every) if unicodedata.category(c) == "Cn"]] = True

    def unsure(self, text: str) -> bool:
        return bool(self.new[np.frombuffer(text.encode("utf-32-le"), "<u4")].any())

    def __call__(self, text: str) -> np.ndarray:
        """Unsigned 32-bit ids."""
        if self.fast is None or any(a in text for a in self.added) or not text.isascii() and self.unsure(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


@lru_cache(2)
def ids_of(path: str) -> Ids:
    """One for each worker process."""
    return Ids(path)
