"""Tokens of many texts at once, as arrays, for steps that run in Python tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ragmill.functions.text import STOPWORDS

_LETTERS, _DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"0123456789"


def _table(kept: bytes, lower: bool) -> bytes:
    return bytes(b + 32 if lower and 65 <= b <= 90 else b if b in kept else 32 for b in range(256))


_PLAIN, _WORDS = _table(_LETTERS + _DIGITS, False), _table(_LETTERS + _DIGITS + b"'-", True)
_STOP = {w.encode() for w in STOPWORDS}


def _listed(words: pa.Array) -> list[bytes]:
    """to_pylist of an array without offset or nulls, many times as fast."""
    if not len(words):
        return []
    ends, body = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].tolist(), words.buffers()[2].to_pybytes()
    return [body[i:j] for i, j in zip(ends, ends[1:], strict=False)]


@dataclass
class Tokens:
    """Tokens in order: the text of each, its place in terms; the distinct terms; the number of texts."""

    rows: np.ndarray
    codes: np.ndarray
    terms: list[bytes]
    texts: int

    def lengths(self) -> np.ndarray:
        return np.bincount(self.rows, minlength=self.texts)

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, codes, times) of the distinct terms of each text."""
        pairs, times = np.unique(self.rows * max(1, len(self.terms)) + self.codes, return_counts=True)
        return pairs // max(1, len(self.terms)), pairs % max(1, len(self.terms)), times


def tokens(texts: list[str | None], content: bool = False) -> Tokens:
    """Runs [a-z0-9]+ of the lower-cased texts, as bm25_tokens of functions.text; with content its content_tokens: words from a
    letter on, ASCII in lower case, longer than one character, without stopwords."""
    raw = [(t or "").encode(errors="replace") if content else (t or "").lower().encode(errors="replace") for t in texts]
    data = np.frombuffer((b"\n".join(raw) + b"\n").translate(_WORDS if content else _PLAIN), np.uint8)
    step = np.diff((data != 32).astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if content:
        letters = np.flatnonzero((data >= 97) & (data <= 122))
        at = np.searchsorted(letters, starts)
        starts = np.append(letters, len(data))[at]
        starts, ends = starts[ends - starts > 1], ends[ends - starts > 1]
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    body = data[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())]).dictionary_encode()
    rows = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
    codes, terms = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), _listed(found.dictionary)
    if content and terms:
        good = np.array([t not in _STOP for t in terms])[codes]
        rows, codes = rows[good], codes[good]
    return Tokens(rows, codes, terms, len(texts))
