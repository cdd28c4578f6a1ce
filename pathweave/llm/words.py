"""Words and shingles of whole texts as numpy arrays of 64-bit hashes.

Texts stay in the Arrow buffer they arrive in.  They are hashed in pieces of about half
a megabyte, so memory depends neither on the batch nor on the length of a text.  A word
is a run of bytes other than space and ``\\x09-\\x0D``; UTF-8 has these bytes in no
other character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE[_LOWER]
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD1342543DE82EF95 | 1
_K1, _K2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole hash."""
    h = h ^ (h >> np.uint64(33))
    h *= _K1
    h ^= h >> np.uint64(29)
    h *= _K2
    h ^= h >> np.uint64(32)
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 4096)
        inverse = pow(base, -1, 2**64)
        have = tuple(
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (base, inverse)
        )
        _powers[base] = have
    return have[0][:n], have[1][:n]


def _piece_words(b: np.ndarray, breaks: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of the bytes; ``breaks`` are where texts start."""
    space = _SPACE[b]
    first = ~space
    first[1:] &= space[:-1]
    at = breaks[breaks < len(b)]
    first[at] = ~space[at]
    starts = np.flatnonzero(first)
    last = ~space
    last[:-1] &= space[1:]
    inner = breaks[(breaks > 0) & (breaks <= len(b))]
    last[inner - 1] = ~space[inner - 1]
    ends = np.flatnonzero(last) + 1
    up, down = powers(_BASE, PIECE * 2 if len(b) <= PIECE * 2 else len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[b] * up[: len(b)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts])


def _long_words(b: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _piece_words for one long text, cut at white space into pieces."""
    out, at = [], 0
    while at < len(b):
        end = min(at + PIECE, len(b))
        while end < len(b):  # up to the next white space
            gap = np.flatnonzero(_SPACE[b[end : end + PIECE]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + PIECE, len(b))
        s, e, h = _piece_words(b[at:end], np.zeros(1, np.int64), lower)
        out.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Texts:
    """Some texts of a batch: rows [first, last), the words of all of them, and where each text's words are."""

    def __init__(self, first: int, last: int, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
        self.first, self.last, self.starts, self.ends, self.hashes = first, last, starts, ends, hashes
        self.offsets = np.searchsorted(starts, at)  # of each text's words, and the end
        self.at = at

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def texts(column: pa.Array, lower: bool) -> Iterator[Texts]:
    """The words of a batch's texts, about half a megabyte of text at a time; null is no text."""
    n = len(column)
    if not n:
        return
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        lo, hi = offsets[first], offsets[last]
        at = offsets[first : last + 1] - lo
        b = data[lo:hi]
        words = _piece_words(b, at[:-1], lower) if hi - lo <= PIECE else _long_words(b, lower)
        yield Texts(first, last, at, *words)
        first = last


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, wherever texts begin: h[i], ..., h[i + size - 1]."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 8:
        out = h[:n] * _PLACE[0]
        for k in range(1, size):
            out += h[k : k + n] * _PLACE[k]
        return mix(out)
    up, down = powers(_WORD_BASE, len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[size:] - sums[:-size])[:n] * down[:n])


def shingle_sets(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes of each text's distinct shingles, ascending.

    Texts of fewer words have their whole sequence as one; those without words have none.
    """
    counts, offsets, h = t.counts, t.offsets, t.hashes
    many = np.maximum(counts - size + 1, 0)
    total = int(many.sum())
    short = np.flatnonzero((counts > 0) & (counts < size))
    sizes = many.copy()
    sizes[short] = 1
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    values = np.empty(out[-1], np.uint64)
    if total:
        all_runs = runs(h, size)
        index = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(total)
        to = np.repeat(out[:-1] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(total)
        values[to] = all_runs[index]
    for i in short:
        w = h[offsets[i] : offsets[i + 1]]
        values[out[i]] = mix((w * _PLACE[: len(w)]).sum(keepdims=True) + np.array([len(w)], np.uint64) * _PLACE[-1])[0]
    for i in np.flatnonzero(many > 1):
        values[out[i] : out[i + 1]].sort()
    doc = np.repeat(np.arange(len(sizes)), sizes)
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    new = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(np.bincount(doc[keep], minlength=len(sizes)), out=new[1:])
    return new, values[keep]
