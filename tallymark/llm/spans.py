"""Words of many texts at once, as positions and hashes in numpy: no Python object for each word.

A word's hashes don't depend on how it is built (see Words.hashes): no sums over its letters. Sums over several words have
their own odd factor for each place."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space: what bytes.split() splits at.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
U = np.uint64
#: Two odd bases (the first of polynomial hashes over a few bytes), and multipliers of the words of a window.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
FACTORS = [np.array([pow(b, 3 + 2 * i, 1 << 64) | 1 for i in range(64)], "u8") for b in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Masks of a number's first bytes, by how many.
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], "u8")
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        x = np.full(max(n, 1 << 16), base, "u8")
        x[0] = 1
        _POWERS[base] = np.multiply.accumulate(x)
    return _POWERS[base][:n]


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def layout(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text begins (one more for the end); a null is an empty text."""
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    if not len(texts):
        return np.zeros(0, "u1"), np.zeros(1, "i8")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    at = np.frombuffer(texts.buffers()[1], "i8" if wide else "i4")[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    data = np.frombuffer(texts.buffers()[2], "u1")[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, "u1")
    return data, at - at[0]


class Words:
    """The words of a layout: begin and end (bytes), doc (the text's number), first (of each text, one more for the end)."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        solid = ~SPACE[data]
        new = np.zeros(len(data) + 1, bool)
        new[at] = True
        gap = np.ones(len(data) + 1, bool)
        gap[1:] = ~solid
        self.begin = np.flatnonzero(solid & (gap[:-1] | new[:-1]))
        gap[:-1], gap[-1] = ~solid, True
        self.end = np.flatnonzero(solid & (gap[1:] | new[1:])) + 1
        self.first = np.searchsorted(self.begin, at)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self._packed: tuple | None = None
        self._hashes: dict[int, np.ndarray] = {}

    def hashes(self, which: int) -> np.ndarray:
        """A 64-bit hash of each word; the two are independent. Up to 23 bytes and the length make three numbers without loss,
        which are mixed; of longer words BLAKE2b halves are taken. Equal in both: the same word."""
        if which not in self._hashes:
            if self._packed is None:
                self._packed = self._pack()
            a, more, long, digests = self._packed
            h = scramble(a * FACTORS[which][60] + FACTORS[which][61])
            for at, x, k in more:
                h[at] = scramble(h[at] ^ scramble(x * FACTORS[which][62] + FACTORS[which][k]))
            h[long] = digests[:, which]
            self._hashes[which] = h
        return self._hashes[which]

    def _pack(self) -> tuple:
        size = self.end - self.begin
        long = np.flatnonzero(size > 23)
        digests = [blake2b(self.data[b:e].tobytes(), digest_size=16).digest() for b, e in zip(self.begin[long].tolist(), self.end[long].tolist())]
        data, more = np.concatenate([self.data, np.zeros(24, "u1")]), []
        eight = np.ndarray(len(self.data) + 17, "<u8", data, strides=(1,))  # the eight bytes from each place on
        a = (size.astype("u8") << U(56)) | (eight[self.begin] & LOW[np.minimum(size, 7)])
        for k, start in ((58, 7), (59, 15)):
            at = np.flatnonzero((size > start) & (size <= 23))
            more.append((at, eight[self.begin[at] + start] & LOW[np.minimum(size[at] - start, 8)], k))
        return a, more, long, np.frombuffer(b"".join(digests) + bytes(16), "<u8").reshape(-1, 2)[: len(long)]

    def windows(self, size: int) -> np.ndarray:
        """The first words of all windows of so many words within a text."""
        i = np.arange(max(len(self.doc) - size + 1, 0))
        return i[self.doc[i] == self.doc[i + size - 1]]


def grams(h: np.ndarray, size: int, which: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of each `size` consecutive word hashes, or of those that begin at `at`."""
    n = max(len(h) - size + 1, 0)
    out = np.zeros(n if at is None else len(at), "u8")
    for j in range(size):
        out += (h[j : j + n] if at is None else h[at + j]) * FACTORS[which][j]
    return scramble(out)
