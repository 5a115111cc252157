"""Vectorised words of Arrow text columns: byte masks, 64-bit word hashes and rolling n-gram hashes in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that belong to a word, for `[^\x20\x09-\x0D]+`.
PLAIN = np.ones(256, dtype=bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
#: The same for `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, small letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=U)
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * _B
    h = (h ^ (h >> U(27))) * _C
    return h ^ (h >> U(31))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes a step."""
    n = len(data)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = data
    words = np.ndarray((n + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = (end - start).astype(np.int64)
    out = mix(left.astype(U) * _A + _C)
    live, at, h = np.flatnonzero(left > 0), start[left > 0], out[left > 0]
    left = left[left > 0]
    while len(live):
        h = mix((h ^ (words[at] & _TAIL[np.minimum(left, 8)])) + _A)
        more = left > 8
        if not more.all():
            done = ~more
            out[live[done]] = h[done]
            live, at, left, h = live[more], at[more], left[more], h[more]
        at, left = at + 8, left - 8
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the column's texts end to end, and where each begins, plus the end; a null has none."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


@dataclass
class Words:
    """Words of several texts: byte range and text of each, and the first word of each text."""

    data: np.ndarray
    texts: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.start, self.end)


def runs(mark: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of True, none across a cut."""
    n = len(mark)
    before = np.zeros(n, dtype=bool)
    before[1:] = mark[:-1]
    before[cuts[cuts < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = mark[1:]
    after[cuts[(cuts > 0) & (cuts <= n)] - 1] = False
    return np.flatnonzero(mark & ~before), np.flatnonzero(mark & ~after) + 1


def words_of(column: pa.Array, alphabet: np.ndarray = PLAIN, lower: bool = False) -> Words:
    data, texts = column_bytes(column)
    if lower:
        data = LOWER[data]
    start, end = runs(alphabet[data], texts)
    return Words(data, texts, start, end, np.searchsorted(start, texts))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every n consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, dtype=U)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= _A
        out += h[j : len(h) - n + 1 + j]
    return mix(out)


def gram_inside(words: Words, n: int) -> np.ndarray:
    """Which of the n-grams by gram_hashes lie within one text."""
    of = words.of
    return of[: len(of) - n + 1] == of[n - 1 :] if len(of) >= n else np.zeros(0, dtype=bool)
