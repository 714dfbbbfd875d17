"""Words of a text exactly as a tokenizers file splits them, and their ids.

``tokenizers`` normalises a text, splits it into words and encodes each word for itself. Splitting is done here with a
plain pattern where that provably gives the same words (code points below U+0230, where NFC changes nothing and lower
case goes code point by code point and stays below U+0300); other texts go through the library's own normaliser and splitter. Strings of special
tokens are cut out of the raw text first, as the library does.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
import unicodedata
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_BEYOND = re.compile("[^\x00-\u022f]")
#: Split patterns that the fast path covers (fixed value, it must equal the file's).
_KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] == kind)


def _byte_chars() -> dict[int, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes for the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(others)}


class WordCodec:
    """Splits texts into words and turns words into ids; ids of seen words are kept, up to ``keep`` words."""

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added, self.keep = set(added), keep
        steps = spec["pre_tokenizer"].get("pretokenizers", [{}])
        plain = [n["type"] for n in spec["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.fast = None
        if plain and steps[0].get("pattern", {}).get("Regex") == _KNOWN:
            letters, numbers = _class("L"), _class("N")
            space = r"\t\n\x0b\x0c\r \x85\xa0"
            self.fast = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")
        #: The byte-level alphabet, where the file's second step is just that.
        self.byte_chars = None
        if self.fast is not None and steps[1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}] and sys.byteorder == "little":
            self.byte_chars = _byte_chars()
        self.vocab_size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}

    def _segment(self, text: str) -> list[str]:
        if self.fast is not None and (text.isascii() or not _BEYOND.search(text)):
            return self.fast.findall(text.lower())
        text = self.tok.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.special is None or "<" not in text:
            return self._segment(text)
        out: list[str] = []
        for k, piece in enumerate(self.special.split(text)):
            if k % 2:
                out.append(piece)
            elif piece:
                out += self._segment(piece)
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian integers of ``dtype``."""
        if self.byte_chars is not None:  # straight to the model, without the library's alignment of every character
            tokenize, chars, kind, added = self.tok.model.tokenize, self.byte_chars, "H" if self.dtype.itemsize == 2 else "I", self.added
            ids = ([self.tok.token_to_id(w)] if w in added else [t.id for t in tokenize(w.encode().decode("latin-1").translate(chars))] for w in words)
            return [array(kind, x).tobytes() for x in ids]
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tok.encode_batch(words, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text; every word new to this codec is encoded once."""
        split = [self.split(t) for t in texts]
        if len(self.cache) > self.keep:
            self.cache.clear()
        new = list({w for words in split for w in words if w not in self.cache})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.cache.update(zip(part, self.encode_words(part), strict=True))
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def pieces(self) -> list[str]:
        """Token strings by id."""
        out = [""] * self.vocab_size
        for token, k in self.tok.get_vocab(with_added_tokens=True).items():
            out[k] = token
        return out


def release() -> None:
    """Give freed memory back to the system: a worker waits for its next task with what it still uses, not with its peak."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def release_if_large(most: int = 300 << 20) -> None:
    """``release`` where the process holds more than ``most`` bytes: for functions that are called once for each group."""
    try:
        with open("/proc/self/statm") as f:
            held = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except OSError:
        return
    if held > most:
        release()


def releasing(run):
    """A function over batches that releases memory at its end."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """One codec for each worker process and file."""
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def text_slices(texts: list, most_chars: int = 4_000_000):
    """(start, stop) over a batch such that a slice has about ``most_chars`` characters, one text at least."""
    start, chars = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if k > start and chars + n > most_chars:
            yield start, k
            start, chars = k, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)


def column_slices(column, most_bytes: int):
    """(start, stop, texts) over an Arrow string column: Python strings of one slice at a time."""
    import pyarrow.compute as pc

    size = np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))]
    start, n = 0, len(column)
    while start < n:
        stop = max(start + 1, int(np.searchsorted(size, size[start] + most_bytes, side="right")) - 1)
        stop = min(stop, n)
        yield start, stop, column.slice(start, stop - start).to_pylist()
        start = stop
