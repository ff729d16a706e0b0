"""64-bit hashes of the words of whole texts, computed on Arrow's byte buffers.

A word is a run of word bytes; its hash is a polynomial over a fixed random code
per byte, taken from prefix sums of the whole buffer, so no word becomes a Python
object.  Long buffers are worked through in blocks that end between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (xor-shift and multiply, twice)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; a null row is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    kind = "int64" if pa.types.is_large_string(texts.type) else "int32"
    at = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype("int64") if len(texts) else np.zeros(1, "int64")
    raw = np.frombuffer(data, "u1") if data is not None and data.size else np.zeros(0, "u1")
    return raw[at[0]:at[-1]], at - at[0]


def byte_slices(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Runs of rows of at most ``limit`` bytes together, or one longer row."""
    _, at = buffers(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield texts.slice(start, end - start)
        start = end


class WordHasher:
    """Hashes words made of the bytes for which ``is_word`` (256 booleans) is true;
    ASCII letters count as lower case."""

    def __init__(self, is_word: np.ndarray) -> None:
        self.is_word = is_word
        fold = np.arange(256, dtype="u8")
        fold[65:91] += 32
        with np.errstate(over="ignore"):
            self.code = mix((fold + U64(1)) * U64(_BASE)) | U64(1)
            steps = np.full(_BLOCK, _BASE, "u8")
            steps[0] = 1
            self.power = np.cumprod(steps)
            steps[1:] = _INVERSE
            self.inverse = np.cumprod(steps)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= len(self.power):
            return self.power, self.inverse
        steps = np.full(n, _BASE, "u8")
        steps[0] = 1
        power = np.cumprod(steps)
        steps[1:] = _INVERSE
        return power, np.cumprod(steps)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all words in order, their byte lengths, and the offset of each row's first word."""
        raw, at = buffers(texts)
        hashes, lengths, starts, lo = [], [], [], 0
        with np.errstate(over="ignore"):
            while lo < len(raw):
                hi = min(lo + _BLOCK, len(raw))
                while hi < len(raw):  # end between words: before the first byte after a non-word byte, or at a row's start
                    back = np.flatnonzero(~self.is_word[raw[lo:hi]])
                    row = int(at[np.searchsorted(at, hi, "right") - 1])
                    cut = max(lo + int(back[-1]) + 1 if len(back) else lo, row)
                    if cut > lo:
                        hi = cut
                        break
                    hi = min(hi + _BLOCK, len(raw))
                part = raw[lo:hi]
                inside = self.is_word[part]
                first = inside.copy()
                first[1:] &= ~inside[:-1]
                rows = at[np.searchsorted(at, lo):np.searchsorted(at, hi)] - lo
                first[rows] |= inside[rows]
                last = np.zeros(len(part), bool)
                last[:-1] = inside[:-1] & (~inside[1:] | first[1:])
                last[-1:] = inside[-1:]
                begin, end = np.flatnonzero(first), np.flatnonzero(last)
                power, inverse = self._powers(len(part))
                sums = np.cumsum(self.code[part] * power[:len(part)])
                before = np.where(begin > 0, sums[begin - 1], U64(0))
                hashes.append(mix((sums[end] - before) * inverse[begin] + (end - begin).astype("u8")))
                lengths.append(end - begin + 1)
                starts.append(begin + lo)
                lo = hi
        if not hashes:
            return np.zeros(0, "u8"), np.zeros(0, "int64"), np.zeros(len(texts) + 1, "int64")
        return np.concatenate(hashes), np.concatenate(lengths), np.searchsorted(np.concatenate(starts), at)


def between_spaces() -> np.ndarray:
    """Word bytes of the contract: all but space and 0x09 to 0x0D."""
    out = np.ones(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = False
    return out


def alphanumeric() -> np.ndarray:
    """ASCII letters and digits, and every byte of a non-ASCII character."""
    out = np.zeros(256, bool)
    out[48:58] = out[65:91] = out[97:123] = out[128:] = True
    return out


def grams(hashes: np.ndarray, row: np.ndarray, *steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word groups (i, i + step, ...) that lie within one row, and their rows."""
    far = steps[-1]
    if len(hashes) <= far:
        return hashes[:0], row[:0]
    n = len(hashes) - far
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for s in steps:
            out = mix(out * U64(_BASE) + hashes[s:s + n] + U64(s))
    same = row[:n] == row[far:]
    return out[same], row[:n][same]


def distinct(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key) pairs, ordered by row and key."""
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[keep], row[keep]
