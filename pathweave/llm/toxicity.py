"""Toxicity from bags of subword embeddings.

A word is the bag of its character n-grams (3 to 5, with marks at both ends), each hashed to a row of an embedding
table; words average their n-grams, a window of WINDOW words averages its words, and a linear softmax tells toxic
from clean.  A word that repeats within a window counts once.  Table and softmax are trained together in numpy, so a misspelt or unseen word scores by the n-grams it
shares.  A few insults in a long text would vanish in its average, so windows slide over the whole text, the most toxic
one decides, and training picks the windows of toxic texts that carry the label (multiple-instance learning).

Once trained, a row of the table only matters through its product with the softmax's weights: one number per row, 256 KB
in all, is what the executors get.  Scoring is numpy over whole batches of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.shared import attach, tidy

ROWS = 1 << 16  # of the embedding table
DIM = 8
SMOOTH = 3  # n-grams of no weight that each word has besides its own, so that those of few cannot stand out
WINDOW = 32
NGRAMS = (3, 4, 5)
PIECE = 1 << 18  # characters scored at once
TOXIC, CLEAN = 1500, 3000  # labelled texts of each kind that are fitted at most
LONGEST = 20_000  # characters of a text that is fitted at most; scoring reads texts of any length whole
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint64)
_NAMES = np.random.default_rng(11).integers(1, 2**63, ROWS, dtype=np.uint64)
_BREAK_RANGES = "\x00-\x20.,;:!?()\\[\\]{}\"|<>\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # as _BREAKS
BREAK, WORD = re.compile(f"[{_BREAK_RANGES}]"), re.compile(f"[^{_BREAK_RANGES}]+")
_BREAKS = np.zeros(0x110000, bool)
_BREAKS[[*range(33), *map(ord, ".,;:!?()[]{}\"|<>")]] = True
_BREAKS[[0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


@dataclass
class Words:
    """The words of some texts: where the text's words begin, and for each n-gram size hashes and each word's stretch of them."""

    offsets: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    fresh: np.ndarray  # not a repetition of one of its text's WINDOW - 1 words before it: a repeated word counts once

    @property
    def n_grams(self) -> np.ndarray:
        return sum(hi - lo for _, lo, hi in self.grams)


def words_of(texts: list[str]) -> Words:
    joined = "\n" + "\n".join(texts) + "\n"
    lowered = joined.lower()
    if len(lowered) != len(joined):  # some capitals have longer small forms
        texts = [x.lower() for x in texts]
        lowered = "\n" + "\n".join(texts) + "\n"
    c = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    text_start = np.cumsum([1] + [len(x) + 1 for x in texts])
    space = _BREAKS[c]
    c = np.where(space, 32, c).astype(np.uint64)
    edge = np.diff(space.astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    grams = []
    for n in NGRAMS:
        size = len(c) - n + 1
        if size <= 0:
            h = np.zeros(0, np.uint16)
        else:
            h = c[:size] * _MULTIPLIERS[0]
            for k in range(1, n):
                h = (h ^ (h >> np.uint64(15))) * _MULTIPLIERS[k] + c[k : k + size]
            h = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
        lo = np.minimum(starts - 1, len(h))
        grams.append((h, lo.astype(np.int32), np.maximum(ends + 2 - n, lo).astype(np.int32)))
    h, lo, hi = grams[0]
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(_NAMES[h], out=sums[1:])
    name = sums[hi] - sums[lo]
    order = np.argsort(name, kind="stable")
    text = np.searchsorted(text_start, starts, "right")[order]
    near = (name[order][1:] == name[order][:-1]) & (np.diff(order) < WINDOW) & (text[1:] == text[:-1])
    fresh = np.ones(len(name), bool)
    fresh[order[1:][near]] = False
    return Words(np.searchsorted(starts, text_start), grams, fresh)


def joined_words(texts: list[str]) -> Words:
    """words_of many texts, read a piece at a time."""
    parts, held, size = [], [], 0
    for x in texts:
        held.append(x)
        size += len(x)
        if size >= PIECE:
            parts.append(words_of(held))
            held, size = [], 0
    parts.append(words_of(held))
    words = np.cumsum([0] + [len(p.fresh) for p in parts])
    offsets = np.concatenate([[0], *[p.offsets[1:] + at for p, at in zip(parts, words[:-1], strict=True)]])
    grams = []
    for k in range(len(NGRAMS)):
        starts = np.cumsum([0] + [len(p.grams[k][0]) for p in parts], dtype=np.int32)[:-1]
        grams.append(tuple(np.concatenate([p.grams[k][j] + at if j else p.grams[k][j] for p, at in zip(parts, starts, strict=True)]) for j in range(3)))
        for p in parts:  # not needed any more
            p.grams[k] = None
    return Words(offsets, grams, np.concatenate([p.fresh for p in parts]))


def word_scores(w: Words, table: np.ndarray) -> np.ndarray:
    """Each word's mean over its n-grams, some words at a time."""
    total = np.zeros(len(w.fresh))
    for h, lo, hi in w.grams:
        for first in range(0, len(lo), 50_000):
            a, b = lo[first : first + 50_000], hi[first : first + 50_000]
            start, end = int(a[0]), int(b.max())
            sums = np.zeros(max(end - start, 0) + 1)
            np.cumsum(table[h[start:end]], out=sums[1:])
            total[first : first + 50_000] += sums[b - start] - sums[a - start]
    return total * w.fresh / (w.n_grams + SMOOTH)


def window_sums(scores: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sum of every WINDOW neighbouring words of each text; of all its words if it has fewer."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        out.append(sums[a + WINDOW : b + 1] - sums[a : b + 1 - WINDOW] if b - a > WINDOW else sums[b : b + 1] - sums[a : a + 1])
    return out


def stretches_of(text: str, size: int) -> Iterator[tuple[str, int, bool]]:
    """A lower-cased text in pieces of about ``size`` characters, cut at breaks: the piece, how many of its first words only
    tell which later ones are repetitions, and whether it is the last.  Every window lies in one piece, with the words before it that count.
    """
    at = end = 0
    while end < len(text):
        gap = BREAK.search(text, end + size) if end + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end], WINDOW - 1 if at else 0, end == len(text)
        back = 4096
        while True:  # the start of the word that is 2 * WINDOW - 2 words before the end
            lo = max(0, end - back)
            found = [m.start() for m in WORD.finditer(text, lo, end)]
            if len(found) > 2 * WINDOW - 2 or lo == 0:
                at = found[2 - 2 * WINDOW] if len(found) > 2 * WINDOW - 2 else 0
                break
            back *= 4


@dataclass
class Model:
    table: np.ndarray  # the embedding rows' products with the softmax weights
    bias: float
    slope: float  # calibration of the top window's logit
    shift: float

    def logits(self, texts: list[str], piece: int = PIECE) -> np.ndarray:
        if any(len(x) > 2 * piece for x in texts):
            return np.array([self._long(x, piece) if len(x) > 2 * piece else self.logits([x], piece)[0] for x in texts])
        w = words_of(texts)
        sums = window_sums(word_scores(w, self.table), w.offsets)
        return np.array([x.max() for x in sums]) / WINDOW + self.bias

    def _long(self, text: str, piece: int) -> float:
        """As ``logits`` of one text, which is read a piece at a time."""
        top = -np.inf
        for part, known, last in stretches_of(text.lower(), piece):
            w = words_of([part])
            own = word_scores(w, self.table)[known:]
            if len(own) >= WINDOW or (last and not known):  # a piece of fewer words holds no window
                top = max(top, float(window_sums(own, np.array([0, len(own)]))[0].max()))
        return top / WINDOW + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -30, 30)))


def _segments(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First words of consecutive windows, and their texts."""
    first, text = [], []
    for i, (a, b) in enumerate(zip(w.offsets[:-1], w.offsets[1:], strict=True)):
        at = np.arange(a, max(b, a + 1), WINDOW) if b > a else np.zeros(0, np.int64)
        first.append(at)
        text.append(np.full(len(at), i))
    return np.concatenate(first).astype(np.int64), np.concatenate(text).astype(np.int64)


def _stretches(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    n = hi - lo
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))


def train(texts: list[str], labels: np.ndarray, seed: int = 0, passes: int = 6) -> Model:
    """Fit table and softmax together (Adagrad on the log loss), then calibrate the top window's logit."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.int64)
    if len(texts) == 0 or len(np.unique(y)) < 2:  # nothing to tell apart
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(ROWS), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    w = joined_words(texts)
    first, of = _segments(w)
    last = np.minimum(first + WINDOW, w.offsets[1:][of])
    aligned = len(first)
    counts = w.n_grams + SMOOTH
    e = rng.normal(0, 0.1, (ROWS, DIM))
    u = rng.normal(0, 0.5, (DIM, 2))
    c = np.zeros(2)
    squares = [np.full_like(x, 1e-6) for x in (e, u, c)]
    rate = 0.5

    def step(batch: np.ndarray, weight: np.ndarray) -> None:
        words = _stretches(first[batch], last[batch])
        segment = np.repeat(np.arange(len(batch)), (last - first)[batch])
        words, segment = words[w.fresh[words]], segment[w.fresh[words]]
        rows, owner, share = [], [], []
        for h, lo, hi in w.grams:
            rows.append(h[_stretches(lo[words], hi[words])])
            n = (hi - lo)[words]
            owner.append(np.repeat(segment, n))
            share.append(np.repeat(1 / (counts[words] * WINDOW), n))
        rows, owner, share = map(np.concatenate, (rows, owner, share))
        x = np.stack([np.bincount(owner, e[rows, k] * share, len(batch)) for k in range(DIM)], axis=1)
        z = x @ u + c
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - np.eye(2)[y[of[batch]]]) * weight[:, None]
        dx = d @ u.T
        de = np.stack([np.bincount(rows, dx[owner, k] * share, ROWS) for k in range(DIM)], axis=1)
        for value, gradient, square in zip((e, u, c), (de, x.T @ d, d.sum(axis=0)), squares, strict=True):
            square += gradient**2
            value -= rate * gradient / np.sqrt(square)

    def model() -> Model:
        return Model(e @ (u[:, 1] - u[:, 0]), float(c[1] - c[0]), 1.0, 0.0)

    for k in range(passes):
        use = np.arange(aligned)
        if k >= passes // 2:  # of toxic texts the windows that now look toxic; of all texts the most toxic one anywhere
            m = model()
            scores = word_scores(w, m.table)
            sums = np.concatenate([[0.0], np.cumsum(scores)])
            look = (sums[last[:aligned]] - sums[first[:aligned]]) / WINDOW + m.bias > 0
            use = np.flatnonzero((y[of[:aligned]] == 0) | look)
            tops = [(w.offsets[i] + int(x.argmax()), i) for i, x in enumerate(window_sums(scores, w.offsets)) if w.offsets[i + 1] > w.offsets[i]]
            top, text = (np.array(x, np.int64) for x in zip(*tops, strict=True))
            first, of = np.concatenate([first[:aligned], top]), np.concatenate([of[:aligned], text])
            last = np.minimum(first + WINDOW, w.offsets[1:][of])
            use = np.concatenate([use, np.arange(aligned, len(first))])
        positive = y[of[use]] == 1
        weight = np.where(positive, len(use) / (2 * max(1, positive.sum())), len(use) / (2 * max(1, (~positive).sum())))
        order = rng.permutation(len(use))
        for i in range(0, len(order), 256):
            at = order[i : i + 256]
            step(use[at], weight[at] / len(at))
    m = model()
    x = np.concatenate([m.logits(texts[i : i + 256]) for i in range(0, len(texts), 256)])
    centre, scale = float(x.mean()), float(x.std()) or 1.0
    x = (x - centre) / scale
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton on a slightly ridged logistic loss
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = p - y, p * (1 - p)
        gradient = np.array([(g * x).sum() + 1e-2 * a, g.sum()])
        hessian = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        change = np.linalg.solve(hessian, gradient)
        a, b = a - float(np.clip(change[0], -2, 2)), b - float(np.clip(change[1], -2, 2))
        if np.abs(change).max() < 1e-9:
            break
    a = max(a, 0.0)
    return Model(m.table, m.bias, a / scale, b - a * centre / scale)


def fit(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on a bounded sample of labelled texts: at most TOXIC and CLEAN texts of up to LONGEST characters.

    ``usable`` is a condition on the id column: labels of other rows are not read.  The sample is the first rows in the
    order of the ids' MD5, so it does not depend on partitions; rows without an id, label or text are not in it.
    """
    known = labels.where(usable & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).cast("int").alias("y")).where("id is not null")
    order = (F.md5(F.col("id").cast("string")), "id")
    # more ids than are wanted: some of them may be of long texts or of none
    chosen = [known.where(F.col("y") == y).orderBy(*order).limit(2 * n) for y, n in ((1, TOXIC), (0, CLEAN))]
    sample = F.broadcast(chosen[0].union(chosen[1]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where((F.length("text") > 0) & (F.length("text") <= LONGEST))
    rows = sorted({(r["key"], r["text"], r["y"]) for r in texts.join(sample, "id").select(F.md5(F.col("id").cast("string")).alias("key"), "text", "y").toLocalIterator()})
    taken: dict[str, int] = {}
    for y, n in ((1, TOXIC), (0, CLEAN)):
        for _, text, label in rows:
            if label == y and n and text not in taken:
                taken[text] = y
                n -= 1
    return train(list(taken), np.array(list(taken.values()), np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1, higher: likelier toxic) and predicted (1 from ``threshold`` on).

    Columns of these names are replaced.  Null texts and texts without words get the score of no evidence.  Whole texts
    are read, in pieces of about a quarter of a million characters (a longer text in pieces that overlap by the words that its
    windows need); an empty table gives an empty result.
    """
    made = ("score", "predicted")
    shared = attach(docs).sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c not in made]
    own = docs.select(*columns, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [x or "" for x in batch.column(len(columns)).to_pylist()]
            first = 0
            while first < len(values):
                last, size = first, 0
                while last < len(values) and (last == first or size + len(values[last]) <= PIECE):
                    size += len(values[last])
                    last += 1
                s = shared.value.scores(values[first:last])
                part = batch.slice(first, last - first)
                new = [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*columns, *made])
                first = last

    schema = docs.select(*columns).schema.add("score", "double").add("predicted", "integer")
    return own.mapInArrow(tidy(run), schema)
