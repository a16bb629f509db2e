"""Vectorised word tokens of Arrow string columns.

A token is a maximal run of word characters of the UTF-8 text: ASCII letters and digits and every
character from U+00C0 on, but for U+2000..U+206F and U+3000..U+303F. Upper case is folded for ASCII
and for U+00C0..U+00DE, so that byte offsets of the folded and of the given text agree. Tokens are
represented by a 64-bit hash of their folded bytes and by their byte range in their own row.
A null row is an empty one: it has no token.

On demand, scripts that are written without blanks (Chinese, Japanese, Thai and the like) are split by character, and signs of
theirs and fullwidth signs are no word characters. On demand, signs that stand between blanks without a word character are a token, too, so
that a text has no fewer tokens than it has pieces between blanks.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_CHUNK = 1 << 18
_LIBC = ctypes.CDLL(_NAME) if (_NAME := ctypes.util.find_library("c")) and "libc.so.6" in _NAME else None
_POWERS = np.ones(1 << 12, dtype=np.uint64)
_POWERS[1:] = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.multiply.accumulate(_POWERS)

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _script_table() -> np.ndarray:
    """For each code point up to U+FFFF 1 if it is a word by itself, 2 if it ends words, else 0."""
    table = np.zeros(1 << 16, dtype=np.uint8)
    blocks = ((0x0E00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x1950, 0x1AB0), (0x2E80, 0x2FE0), (0x3040, 0x3130), (0x31A0, 0x4DC0), (0x4E00, 0xA000), (0xA9E0, 0xAA80), (0xF900, 0xFB00), (0xFF66, 0xFFA0))
    for low, high in blocks:
        table[low:high] = 1
    for low, high in (*blocks, (0xFE10, 0xFE20), (0xFE30, 0xFE70), (0xFF00, 0xFFF0)):
        for c in range(low, high):
            if unicodedata.category(chr(c))[0] in "PSZ":
                table[c] = 2
    return table


_SCRIPTS = _script_table()


@dataclass
class Tokens:
    """Tokens of a column: those of row i are bounds[i] to bounds[i + 1]; start and end are bytes in the row."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the offsets of its rows in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_mask(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and the case-folded bytes."""
    word, low, n = _WORD[raw], _LOWER[raw], len(raw)
    for lead, width, following in ((0xC2, 2, None), (0xE2, 3, (0x80, 0x81)), (0xE3, 3, (0x80,))):
        at = np.flatnonzero(raw == lead)
        at = at[at + width <= n]
        if following:
            at = at[np.isin(raw[at + 1], following)]
        for k in range(width):
            word[at + k] = False
    at = np.flatnonzero(raw == 0xC3)
    at = at[at + 1 < n] + 1
    at = at[(raw[at] >= 0x80) & (raw[at] <= 0x9E) & (raw[at] != 0x97)]
    low[at] += 0x20
    return word, low


def _alone(raw: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Bytes at which a word begins because the character there, or the one before, is a word by itself; signs are taken from the mask."""
    at = np.flatnonzero(raw >= 0xE0)
    three, four = at[raw[at] < 0xF0], at[raw[at] >= 0xF0]
    code = (raw[three].astype(np.int64) & 15) << 12 | (raw[three + 1].astype(np.int64) & 63) << 6 | raw[three + 2] & 63
    kind = _SCRIPTS[code]
    for k in range(3):
        word[three[kind == 2] + k] = False
    three = three[kind == 1]
    plane = (raw[four].astype(np.int64) & 7) << 2 | (raw[four + 1] & 63) >> 4
    four = four[(plane == 2) | (plane == 3)]
    at = np.concatenate([three, three + 3, four, four + 4])
    return at[at < len(raw)]


def _alone_signs(raw: np.ndarray, word: np.ndarray, first: np.ndarray) -> None:
    """Marks signs between blanks, or a row's ends, that have no word character as if they were a word."""
    blank = _BLANK[raw]
    for lead, second, third in ((0xC2, (0x85, 0xA0), None), (0xE2, (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, (0x81,), (0x9F,)), (0xE3, (0x80,), (0x80,))):
        at = np.flatnonzero(raw == lead)
        at = at[at + (2 if third else 1) < len(raw)]
        at = at[np.isin(raw[at + 1], second)]
        if third:
            at = at[np.isin(raw[at + 2], third)]
        for k in range(3 if third else 2):
            blank[at + k] = True
    there = np.flatnonzero(~blank)
    if not len(there):
        return
    begins = np.concatenate([[True], blank[there[1:] - 1]]) | first[there]
    head = np.flatnonzero(begins)
    lonely = ~np.logical_or.reduceat(word[there], head)
    word[there[np.repeat(lonely, np.diff(np.append(head, len(there))))]] = True


def _cuts(raw: np.ndarray, limit: int, end: np.ndarray) -> list[int]:
    """Places to cut at, just after an ASCII byte that ends tokens, about limit bytes apart."""
    cuts, at = [0], 0
    while len(raw) - at > limit:
        stop, step = at + limit, limit
        while True:
            other = np.flatnonzero(end[raw[stop : stop + step]])
            if len(other):
                stop += int(other[0]) + 1
                break
            if stop + step >= len(raw):
                return [*cuts, len(raw)]
            stop += step
        at = stop
        cuts.append(at)
    return [*cuts, len(raw)]


def tokenize(column: pa.Array, scripts: bool = False, signs: bool = False) -> Tokens:
    """Tokens of a column; with scripts, those written without blanks are split by character; with signs, signs between blanks are tokens."""
    raw, offsets = utf8(column)
    hashes, starts, ends = [], [], []
    cuts = _cuts(raw, _CHUNK, _BLANK if signs else ~_WORD)
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        word, low = word_mask(raw[a:b])
        alone = _alone(raw[a:b], word) if scripts else None
        first = np.zeros(b - a, dtype=bool)
        rows = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        first[rows] = True
        if signs:
            _alone_signs(raw[a:b], word, first)
        start = word & first
        start[0] |= word[0]
        start[1:] |= word[1:] & ~word[:-1]
        if alone is not None:
            start[alone] = word[alone]
        at = np.flatnonzero(word)
        if not len(at):
            continue
        head = np.flatnonzero(start[at])
        length = np.diff(np.append(head, len(at)))
        inside = np.arange(len(at)) - np.repeat(head, length)
        with np.errstate(over="ignore"):
            codes = (low[at].astype(np.uint64) + np.uint64(1)) * _POWERS[inside & 4095]
            hashes.append(mix(np.add.reduceat(codes, head) + length.astype(np.uint64)))
        starts.append(at[head] + a)
        ends.append(at[head] + length + a)
    if not hashes:
        none = np.zeros(0, dtype=np.int64)
        return Tokens(none.astype(np.uint64), none, none, np.zeros(len(offsets), dtype=np.int64))
    start, end = np.concatenate(starts), np.concatenate(ends)
    bounds = np.searchsorted(start, offsets)
    base = np.repeat(offsets[:-1], np.diff(bounds))
    return Tokens(np.concatenate(hashes), start - base, end - base, bounds)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of so many tokens; the last size - 1 places have none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += hashes[k : k + n]
    return mix(out)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Parts of a batch with about so many bytes of text each, at least one row. Memory that they took is given back at the end."""
    offsets = utf8(batch.column(column))[1]
    at = 0
    while at < len(offsets) - 1:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop
    release()


def release() -> None:
    """Gives memory that isn't used back to the system: a Python worker lives on from task to task."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)
