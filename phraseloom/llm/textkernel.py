"""Vectorised text kernels shared by the operators of this subpackage.

Texts arrive as Arrow string columns.  The kernels look at the UTF-8 bytes of many documents at once
with numpy: word borders come from a 256-entry byte table, word hashes from eight bytes at a time, window hashes from
folding neighbours in pairs, so the cost is a few machine operations per word and no Python object for one.

``blocks`` cuts a column into pieces of about one MB (a longer document is a piece of its own), which
bounds the memory of every caller whatever the Arrow batch size is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 20

#: Bytes of white space: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words of letters and digits: 0-9, A-Z, a-z and everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def chunks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of the data as an integer; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))


#: What is kept of a chunk of 0 to 8 bytes.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer runs of bytes are hashed and compared one by one.
LONG = 64


class WordHash:
    """A 64-bit hash of byte runs: their length, then eight bytes at a time, go through a bijective mixer; runs above ``LONG`` bytes through XXH3."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.seed, self.factor = (_U(int(x) | 1) for x in rng.integers(1 << 62, 1 << 63, 2, dtype=np.uint64))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for each run; equal runs have equal hashes wherever they stand."""
        size, wide = ends - starts, chunks(data)
        out = mix64((self.seed + size.astype(np.uint64) * self.factor) ^ (wide[starts] & _KEPT[np.minimum(size, 8)]))
        of, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(of):
            out[of] = mix64((out[of] ^ (wide[starts[of] + k] & _KEPT[np.minimum(size[of] - k, 8)])) * self.factor)
            k += 8
            of = of[size[of] > k]
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), int(self.seed))
        return out


def equal_runs(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[at : at + size] and b[to : to + size] are equal bytes."""
    same, left, right, of, k = np.ones(len(size), bool), chunks(a), chunks(b), np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(of):
        differ = (left[at[of] + k] ^ right[to[of] + k]) & _KEPT[np.minimum(size[of] - k, 8)]
        same[of] &= differ == 0
        k += 8
        of = of[size[of] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        same[i] = np.array_equal(a[at[i] : at[i] + size[i]], b[to[i] : to[i] + size[i]])
    return same


class WindowHash:
    """A 64-bit hash of every run of so many values: runs of 1, 2, 4 ... values are folded in pairs, and those that make up the size together."""

    def __init__(self, seed: int):
        self.factor = _U(int(np.random.default_rng(seed).integers(1 << 61, 1 << 62, dtype=np.uint64)) * 4 + 3)

    def _fold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64(a * self.factor + b)

    def runs(self, values: np.ndarray, size: int) -> np.ndarray:
        """The hash of values[i : i + size] for every i."""
        n, out, done, width, power = len(values) - size + 1, None, 0, 1, values
        if n <= 0:
            return np.zeros(0, np.uint64)
        while True:
            if size & width:
                part = power[done : done + n]
                out = self._fold(np.full(n, _U(size)) if out is None else out, part)
                done += width
            if 2 * width > size:
                return out
            power = self._fold(power[:-width], power[width:])
            width *= 2


class KarpRabin:
    """A polynomial rolling hash of runs of any length, modulo 2**64, by prefix sums.  Some unequal runs collide whatever the base is, so whoever uses it compares the runs."""

    def __init__(self, seed: int):
        base = int(np.random.default_rng(seed).integers(1 << 32, 1 << 60)) * 8 + 5
        self.base, self.inverse = _U(base), _U(pow(base, -1, 1 << 64))
        self.up, self.down = self._powers(1 << 12)

    def _powers(self, n: int) -> list[np.ndarray]:
        return [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)])) for base in (self.base, self.inverse)]

    def runs(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values)
        up, down = (self.up, self.down) if n < len(self.up) else self._powers(n + 1)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * up[:n], out=prefix[1:])
        return mix64((prefix[ends] - prefix[starts]) * down[starts])


WORD_HASH = WordHash(20250101)
WORD_HASH_2 = WordHash(20250202)
WINDOW_HASH = WindowHash(20250303)
WINDOW_HASH_2 = WindowHash(20250404)
KARP_RABIN = KarpRabin(20250505)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 borders of its texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, borders, data = column.buffers()
    borders = np.frombuffer(borders, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data, borders


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, borders from 0) of pieces of about ``limit`` bytes."""
    data, borders = utf8(column)
    n, lo = len(borders) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(borders, borders[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[borders[lo] : borders[hi]], borders[lo : hi + 1] - borders[lo]
        lo = hi


def word_spans(data: np.ndarray, borders: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the number of the first of its words (n+1 values).

    ``is_word`` is a 256-entry table.  A word never crosses from one document to the next.
    """
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = is_word[data]
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    cut = borders[:-1]
    cut = cut[cut < n]
    first[cut] = inside[cut]
    last = inside[:n].copy()  # the last byte of a word
    last &= ~inside[1:]
    cut = cut[cut > 0] - 1
    last[cut] = inside[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, borders)


def window_hashes(words: np.ndarray, first: np.ndarray, size: int, hashed: WindowHash) -> tuple[np.ndarray, np.ndarray]:
    """Positions (word numbers) at which ``size`` words of one document start, and the hashes of those windows."""
    counts = np.diff(first)
    n_windows = np.maximum(counts - size + 1, 0)
    total = int(n_windows.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    shift = np.repeat(first[:-1] - (np.cumsum(n_windows) - n_windows), n_windows)
    at = np.arange(total, dtype=np.int64) + shift
    return at, hashed.runs(words, size)[at]


def owners(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The document of each word number."""
    return np.searchsorted(first, at, side="right") - 1


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte runs data[start:end], which are whole UTF-8 characters, as an Arrow string column."""
    size = ends - starts
    borders = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=borders[1:])
    at = np.repeat(starts - borders[:-1], size) + np.arange(borders[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(borders), pa.py_buffer(data[at]))


def equal_groups(keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts equal byte runs with equal tags together, given a 64-bit hash of run and tag: (order, first place of each group in it).

    The order is by hash and, in a group, by place.  Every run is compared with the first of its group; if a hash ever covers two different runs, the
    runs get a second hash on top, so groups are exact.
    """
    seed = 1
    while True:
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(keys)))
        model = np.repeat(order[first], size)
        same = (ends - starts)[model] == (ends - starts)[order]
        same &= tag[model] == tag[order]
        same &= equal_runs(data, starts[model], data, starts[order], np.where(same, (ends - starts)[order], 0))
        if same.all():
            return order, first
        seed += 1
        keys = mix64(keys ^ WordHash(seed).words(data, starts, ends) ^ mix64(tag.astype(np.uint64)))
