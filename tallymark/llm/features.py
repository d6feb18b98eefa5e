"""Hashed n-grams of many texts at once, in numpy.

Four families, each hashed to 4096 columns and divided by the text's number of such n-grams: three and four bytes in a
row (characters, as UTF-8 writes them), one and two words in a row. A few columns on style follow. A text without any
n-gram has zeros. Everything is computed over whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tallymark.llm.spans import BASES, FACTORS, U, Words, layout, powers, scramble

BITS = 12
FAMILIES = 4
SYMBOLS, UPPER, DIGIT, LETTER, MARK = (np.zeros(256, bool) for _ in range(5))
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER[65:91], DIGIT[48:58], LETTER[65:91], LETTER[97:123] = True, True, True, True
LETTER[128:] = True
MARK[list(b".,;:!?'\"-()")] = True
#: The kinds of bytes that are counted, line feeds last.
KINDS = np.stack([SYMBOLS, UPPER, DIGIT, LETTER, MARK, np.arange(256) == 10], 1).astype("i8")
STYLE = 10
COLUMNS = (FAMILIES << BITS) + STYLE
REPEAT_WINDOW = 8


def sums(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of x from each `begin` up to its `end`; the stretches rise and don't overlap."""
    if not len(begin):
        return np.zeros(0, x.dtype)
    got = np.add.reduceat(np.append(x, x.dtype.type(0)), np.stack([begin, np.maximum(begin, end)], 1).ravel())[::2]
    return np.where(end > begin, got, x.dtype.type(0))


def counts(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often mask is set between the bounds `first`."""
    return sums(mask.astype("i8"), first[:-1], first[1:])


class Texts:
    """The features of a step's texts."""

    def __init__(self, texts: pa.Array):
        self.words = w = Words(*layout(texts))
        self.n = len(w.n)
        self.h = w.hashes(0)
        self.repeated = self._repeated()

    def _repeated(self) -> np.ndarray:
        """Which words stand in a window of eight that the same text has twice or more."""
        w, n = self.words, max(len(self.h) - REPEAT_WINDOW + 1, 0)
        at = w.windows(REPEAT_WINDOW)
        key = np.zeros(n, "u8")
        for j in range(REPEAT_WINDOW):
            key += self.h[j : j + n] * FACTORS[0][j]
        key = scramble(key[at]) ^ (w.doc[at].astype("u8") * U(0x9FB21C651E98DF25))
        order = np.sort(key)
        again = np.zeros(1 << 16, bool)  # the keys found twice, by their last bits: few windows are left to be put in order
        again[order[1:][order[1:] == order[:-1]] & U(0xFFFF)] = True
        some = np.flatnonzero(again[key & U(0xFFFF)])
        at, key = at[some], key[some]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        pair = np.flatnonzero(same)
        if len(pair):  # the words themselves decide
            a, b, other = at[order[pair]], at[order[pair + 1]], w.hashes(1)
            equal = w.doc[a] == w.doc[b]
            for j in range(REPEAT_WINDOW):
                equal &= (self.h[a + j] == self.h[b + j]) & (other[a + j] == other[b + j])
            same[pair] = equal
        twice = np.zeros(len(at) + 1, bool)
        twice[1:-1] |= same
        twice[:-2] |= same
        hit = np.zeros(len(w.doc) + 1, "i4")
        if len(at):
            hits = at[order[twice[:-1]]]
            hit[: len(w.doc)] += np.bincount(hits, minlength=len(w.doc)).astype("i4")
            hit -= np.bincount(hits + REPEAT_WINDOW, minlength=len(hit)).astype("i4")
        return np.cumsum(hit)[:-1] > 0

    def families(self):
        """(columns, bounds of each text) of the families."""
        w, shift = self.words, U(64 - BITS)
        upto = np.zeros(len(w.data) + 1, "u8")
        x = w.data.astype("u8")
        x += U(1)
        x *= powers(BASES[0], len(x))
        np.cumsum(x, out=upto[1:])
        inverse = powers(pow(BASES[0], -1, 1 << 64), len(w.data) + 1)
        for size in (3, 4):
            n = max(len(w.data) - size + 1, 0)
            h = upto[size : size + n] - upto[:n]
            h *= inverse[:n]
            h ^= h >> U(29)
            h *= U(BASES[1])
            h >>= shift
            # grams that begin in one text and end in the next belong to none
            yield h.view("i8"), np.minimum(w.at, n), np.minimum(np.maximum(w.at[1:] - size + 1, w.at[:-1]), n)
        yield ((self.h * U(BASES[1])) >> shift).view("i8"), w.first, w.first[1:]
        pair = scramble(self.h[:-1] * FACTORS[1][0] + self.h[1:] * FACTORS[1][1]) if len(self.h) > 1 else self.h[:0]
        yield (pair >> shift).view("i8"), np.minimum(w.first, len(pair)), np.minimum(np.maximum(w.first[1:] - 1, w.first[:-1]), len(pair))

    def style(self) -> np.ndarray:
        w = self.words
        found = np.zeros((self.n, 256), "i8")
        for i in np.flatnonzero(np.diff(w.at)).tolist():
            found[i] = np.bincount(w.data[w.at[i] : w.at[i + 1]], minlength=256)
        kinds = found @ KINDS
        part = kinds[:, :-1] / np.maximum(np.diff(w.at), 1)[:, None]
        words = np.maximum(w.n, 1)
        length = np.log1p(w.n)
        again = counts(self.repeated, w.first) / words
        lines = kinds[:, -1] / words
        wide = sums((w.end - w.begin) ** 2, w.first[:-1], w.first[1:]) / words / 50
        return np.column_stack([part, length / 5, again, lines, wide, w.n < 20])

    def matrix(self) -> np.ndarray:
        """One row of COLUMNS for each text."""
        out = np.zeros((self.n, COLUMNS), "f4")
        for k, (col, begin, end) in enumerate(self.families()):
            for i in range(self.n):
                s, e = begin[i], end[i]
                if e > s:
                    out[i, k << BITS : k + 1 << BITS] = np.bincount(col[s:e], minlength=1 << BITS) / (e - s)
        out[:, FAMILIES << BITS :] = self.style()
        return out

    def scores(self, weights: np.ndarray, style: np.ndarray | None = None, families: list | None = None) -> np.ndarray:
        """matrix() @ weights, without the matrix. style, families: these, if they are known."""
        total = (self.style() if style is None else style) @ weights[FAMILIES << BITS :]
        for k, (col, begin, end) in enumerate(self.families() if families is None else families):
            total += sums(np.take(weights[k << BITS : k + 1 << BITS], col, mode="clip"), begin[:-1], end) / np.maximum(end - begin[:-1], 1)
        return total

    def softplus(self, weights: np.ndarray, bias: float, bins: np.ndarray | None = None) -> np.ndarray:
        """Sums over the texts: their number, log(1 + exp(score)), its slope by the bias, and by each weight; then, with bins, how
        many have their score in each (those beyond the ends at the ends)."""
        style, families = self.style(), list(self.families())
        s = self.scores(weights, style, families) + bias
        d = 0.5 * (1 + np.tanh(0.5 * s))
        by_weight = np.empty(COLUMNS)
        by_weight[FAMILIES << BITS :] = d @ style
        for k, (col, begin, end) in enumerate(families):
            size, gap = end - begin[:-1], np.append(begin[1:-1], len(col))[: self.n] - end
            each = np.repeat(np.stack([d / np.maximum(size, 1), np.zeros(self.n)], 1).ravel(), np.stack([size, gap], 1).ravel())
            by_weight[k << BITS : k + 1 << BITS] = np.bincount(col, weights=each, minlength=1 << BITS)
        counts = [] if bins is None else np.histogram(np.clip(s, bins[0], bins[-1]), bins)[0]
        return np.concatenate([[self.n, np.logaddexp(0, s).sum(), d.sum()], by_weight, counts])
