"""Exact, cached encoding with the tokenizers library.

A tokenizer that splits text before its merges never merges across such a split, so a text's ids are the ids of its
chunks one after another, where chunks are cut only where the tokenizer always cuts: around white space. Words repeat,
so each worker encodes a chunk once, through the library, and looks it up from then on.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: White space as the tokenizer's patterns know it (Unicode White_Space).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters, and marks after which a new piece begins in both kinds of vocabulary: a run of letters that marks or white
#: space follow is a piece by itself.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?*#$%&|"
_WORD, _TAIL = rf"[{_LETTERS}]++(?![^{_SPACE}{_MARKS}])", rf"(?<=[{_LETTERS}])[{_MARKS}]++(?![^{_SPACE}])"
#: How a text falls into chunks. "spaced": a word keeps the one space before it, runs of white space stay by
#: themselves but for that space (byte-level vocabularies). "bare": white space counts for nothing.
CHUNKS = {
    "spaced": re.compile(rf" ?{_WORD}|{_TAIL}| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"),
    "bare": re.compile(rf"{_WORD}|{_TAIL}|[^{_SPACE}]+"),
}
_PLAIN = re.compile(rf" ?[{_LETTERS}]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: a printable byte stands for itself, the others count up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTES = _byte_letters()
#: Chunks that a worker remembers, and ids of chunks; all are forgotten when either is reached.
REMEMBERED, REMEMBERED_IDS = 800_000, 6_000_000


class _Known(dict):
    """Chunk -> number; a new chunk gets the next number and waits in `new` to be encoded. Number 0 is the end id."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self[chunk] = n = len(self) + 1
        return n


class Encoder:
    """encode(texts) -> (ids uint32, ends): ids of all texts, each followed by the end id, and where each text ends."""

    def __init__(self, path: str, chunks: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.find, self.end_id = Tokenizer.from_file(path), CHUNKS[chunks].findall, end_id
        self.model, self.lower = self.library.model, chunks == "bare"
        self._forget()

    def _forget(self) -> None:
        self.known = _Known()
        self.flat, self.filled = np.empty(1 << 16, np.uint32), 1
        self.flat[0] = self.end_id
        self.starts, self.sizes, self.chunks = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 1
        self.sizes[0] = 1

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk. A run of letters is one piece for certain, and goes straight to the library's model."""
        out: list[list[int]] = [[]] * len(chunks)
        rest = []
        for i, c in enumerate(chunks):
            if _PLAIN(c):
                c = c.lower() if self.lower else c
                piece = c if c.isascii() and c[0] != " " else c.encode().decode("latin-1").translate(_BYTES)
                out[i] = [t.id for t in self.model.tokenize(piece)]
            else:
                rest.append(i)
        for i, e in zip(rest, self.library.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def _learn(self) -> None:
        """Encode the new chunks, a few thousand at a time."""
        new, self.known.new = self.known.new, []
        for at in range(0, len(new), 4096):
            ids = self._encode(new[at : at + 4096])
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
            while self.filled + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            while self.chunks + len(ids) > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
                self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            to = slice(self.chunks, self.chunks + len(ids))
            self.flat[self.filled : self.filled + len(flat)] = flat
            self.sizes[to] = sizes
            self.starts[to] = self.filled + np.cumsum(sizes, dtype=np.int64) - sizes
            self.filled += len(flat)
            self.chunks += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED or self.filled > REMEMBERED_IDS:
            self._forget()
        number, find, parts = self.known.__getitem__, self.find, []
        for t in texts:
            parts.append(np.array([*map(number, find(t)), 0], np.int64))
        if not parts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if self.known.new:
            self._learn()
        which = np.concatenate(parts)
        last = np.cumsum([len(x) for x in parts]) - 1
        size = self.sizes[which].astype(np.int64)
        to = np.cumsum(size)
        index = np.arange(int(to[-1]))
        index += np.repeat(self.starts[which] - (to - size), size)
        return self.flat[index], to[last]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, chunks: str, end_id: int) -> Encoder:
    """The worker's encoder of this kind; it lives as long as the worker."""
    key = (path, chunks, end_id)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, chunks, end_id)
    return _ENCODERS[key]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
