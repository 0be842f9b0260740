"""Words of a batch of texts and their rolling hashes, as numpy arrays.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``.  Everything here works on one
Arrow batch inside a task; nothing is kept between batches.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_M64 = (1 << 64) - 1


#: The prime of the rolling hashes, and their bases.
PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_LOW30, _LOW31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_BASES = [int(x) for x in np.random.default_rng(20250613).integers(1 << 60, PRIME, size=2)]


def _fold(x: np.ndarray) -> np.ndarray:
    return (x & _P) + (x >> np.uint64(61))


def _times(x: np.ndarray, factor: int) -> np.ndarray:
    """x * factor modulo PRIME, up to a few units beyond it."""
    high, low = np.uint64(factor >> 31), np.uint64(factor & ((1 << 31) - 1))
    x1, x0 = x >> np.uint64(31), x & _LOW31
    middle = x1 * low + x0 * high
    return _fold(((x1 * high) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31)) + x0 * low)


def rolled(codes: np.ndarray, width: int, base: int = 0) -> np.ndarray:
    """Rabin-Karp hashes below PRIME of all runs of ``width`` codes: polynomials of the codes' high 61 bits, at one of two random bases.

    Runs of 2k codes are made of two runs of k, so that it takes some steps for each bit of the width.
    """
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    one = codes >> np.uint64(3)
    out, done = None, 0
    size = 1
    while True:
        if width & size:  # the run's first ``done`` codes are in out, the next ``size`` in one
            out = one[:n] if out is None else _fold(_times(out, pow(_BASES[base], size, PRIME)) + one[done : done + n])
            done += size
        size *= 2
        if size > width:
            break
        half = size // 2
        one = _fold(_times(one[:-half], pow(_BASES[base], half, PRIME)) + one[half:])
    out = _fold(out)
    return np.where(out >= _P, out - _P, out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(values: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each value, as columns: a cryptographic hash's first 128 bits."""
    joined = b"".join([hashlib.blake2b(v, digest_size=16).digest() for v in values])
    return np.frombuffer(joined, dtype="<u8").reshape(-1, 2).T


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


LOWER = _lower()


_BYTES = np.random.default_rng(20250101).integers(1, _M64, size=256, dtype=np.uint64)
#: The first bytes of a word of eight, by their number; keys of the rounds that permute words.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_KEYS = np.random.default_rng(20250714).integers(1, _M64, size=4, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Word spans of a run of texts (null: no words), and two independent 64-bit hashes of each word.

    Words of up to 15 bytes have hashes of their own, since these are a permutation of their
    bytes and length; longer ones have a cryptographic hash's first 128 bits.  ``lower`` turns
    A-Z into a-z first; ``gaps`` is a table of the bytes between words.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, hashes: bool = True, lower: bool = False, gaps: np.ndarray = _SPACE):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        self.offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if n else None
        self.data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        first, last = int(self.offsets[0]), int(self.offsets[-1])
        self.data, self.offsets = self.data[first:last], self.offsets - first
        if lower:
            self.data = LOWER[self.data]
        inside = ~gaps[self.data]
        edge = np.zeros(len(inside) + 1, dtype=bool)  # a text begins here
        edge[self.offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)  # index of the first word of each text, and the end
        self.counts = np.diff(self.first)
        if hashes:
            self.hashes, self.also = self._hashes()

    def _hashes(self) -> tuple[np.ndarray, np.ndarray]:
        eights = np.ndarray(len(self.data) + 8, dtype="<u8", buffer=np.concatenate([self.data, np.zeros(15, np.uint8)]), strides=(1,))
        size = self.ends - self.starts
        one = eights[self.starts] & _FIRST[np.minimum(size, 8)]
        two = eights[np.minimum(self.starts + 8, len(self.data))] & _FIRST[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)
        for key in _KEYS:
            one, two = two, one ^ mix(two + key)
        long = np.flatnonzero(size > 15)
        if len(long):
            one[long], two[long] = digests([self.data[a:b].tobytes() for a, b in zip(self.starts[long].tolist(), self.ends[long].tolist())])
        return one, two

    def distinct(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words, and the number of each word among them."""
        ends = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        inside = np.zeros(len(self.data) + 1, dtype=np.int8)
        inside[self.starts] += 1
        inside[self.ends] -= 1
        letters = pa.py_buffer(self.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)])
        coded = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(ends), letters]).dictionary_encode()
        return coded.dictionary, np.asarray(coded.indices)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Fast hashes of any spans of bytes, for counts that may be rough: two spans may collide."""
        power = np.cumprod(np.full(len(self.data) + 1, _ODD, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[self.data] * power[:-1], dtype=np.uint64)])
        return mix((sums[ends] - sums[starts]) * power[len(self.data) - starts] + (ends - starts).astype(np.uint64))

    def texts_hashes(self, texts: np.ndarray) -> np.ndarray:
        """Two independent 64-bit hashes of the words in order of each of some texts."""
        return digests([b" ".join(self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().split()) for i in texts])

    def texts_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(first: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word of every window of ``width`` words inside one text, and its text."""
    many = np.maximum(counts - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), many)
    before = np.cumsum(many) - many
    start = np.arange(many.sum()) - np.repeat(before, many) + np.repeat(first[:-1], many)
    return start, text


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def give_back() -> None:
    """Returns freed memory to the system: workers stay after a stage, and else keep all that they ever took."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def pieces(texts: pa.Array, most: int = 2 << 20):
    """(start, stop) runs of rows of at most ``most`` bytes each, or one long row; after the last, freed memory is given back."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    at, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += int(n)
    if len(lengths) > at:
        yield at, len(lengths)
    give_back()
