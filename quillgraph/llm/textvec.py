"""Words of a batch of texts as arrays: no Python object for each word.

A word is a run of letters, digits and marks, lower-cased code point by code point, so offsets stay those of the text. Its
hash is a polynomial over its code points modulo 2**64, then mixed; the same in every process.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = 0x20000
_state: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if "word" not in _state:
        chars = [chr(c) for c in range(_TABLE)]
        _state["word"] = np.array([c.isalnum() or unicodedata.category(c)[0] == "M" for c in chars])
        _state["lower"] = np.array([ord(low) if len(low := c.lower()) == 1 else ord(c) for c in chars], dtype=np.uint32)
    return _state["word"], _state["lower"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_state.get("p", ())) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        for name, base in (("p", _P), ("i", inverse)):
            powers = np.full(size, base, dtype=np.uint64)
            powers[0] = 1
            _state[name] = np.multiply.accumulate(powers)
    return _state["p"], _state["i"]


@dataclass
class Words:
    """Words in order; start and end are code points of the own text, doc is the text's number in the batch."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first[d] .. first[d + 1] are the words of text d


def words(texts: list[str | None]) -> Words:
    word, lower = _tables()
    texts = [t or "" for t in texts]
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begins = np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)
    if len(code) and int(code.max()) >= _TABLE:
        beyond = code >= _TABLE
        safe = np.where(beyond, 0, code)
        is_word, low = word[safe] | beyond, np.where(beyond, code, lower[safe])
    else:
        is_word, low = word[code], lower[code]
    edge = np.flatnonzero(np.diff(np.r_[False, is_word, False]))
    start, end = edge[::2], edge[1::2]
    p, inverse = _powers(len(code) + 1)
    total = np.r_[np.uint64(0), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p[: len(code)], dtype=np.uint64)]
    hashes = mix((total[end] - total[start]) * inverse[start])
    doc = np.searchsorted(begins, start, side="right") - 1
    first = np.searchsorted(start, begins)
    return Words(hashes, doc, start - begins[doc], end - begins[doc], first)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of every run of n words; a text with fewer words has the run of all its words."""
    counts = np.diff(w.first)
    code, mult = np.zeros(max(0, len(w.hash) - n + 1), dtype=np.uint64), np.uint64(0xD6E8FEB86659FD93)
    for k in range(n):
        code = code * mult + w.hash[k : k + len(code)]
    whole = w.doc[: len(code)] == w.doc[n - 1 :] if len(code) else np.zeros(0, bool)
    code, doc = mix(code[whole]), w.doc[: len(whole)][whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            extra[has] = extra[has] * mult + w.hash[w.first[short[has]] + k]
        code, doc = np.r_[code, mix(extra ^ np.uint64(0x5851F42D4C957F2D))], np.r_[doc, short]
    return code, doc
