"""Removal of long passages that an earlier document has, with suffix automata of reference shards.

A window is ``length`` consecutive words.  Words covered by a window that also starts in a document with a smaller
id go.  Which references a document has to be streamed against is found first:

1. *Anchors.*  Each window has the least hash of its 10-word runs; a shared window shares it, and one anchor serves
   about twenty windows.  Anchors of two or more documents go into a bitmap of bounded size.
2. *References.*  Texts are cut into shards of bounded size that overlap by length - 1 words, so each window belongs to one
   shard.  A task gathers the windows whose anchor may be shared; of a window that it met in several documents the one with
   the smallest id becomes the reference of the others, and only that one is sent on, by hash.  Where the windows
   meet, the smallest id is the reference of those that were sent.  One (shard, reference's shard) pair per meeting is
   kept, however many windows it is made of.
3. *Matching statistics.*  The reference's shard becomes a suffix automaton, and the shards that were sent to it are
   streamed through: after each word the automaton's state tells how long a suffix of what was read occurs in it.  Where
   that is ``length`` or more, those words go.

Every document that has a window, but for its smallest owner, meets one with a smaller id that has it, so nothing is
missed; the automata compare words, so a hash never decides.  A passage in a third of all documents is one entry per
gathering of a task where it is sent, however many documents that gathering read; it gives one pair per document, and the join
on the reference is one that Spark can split.  A task holds one automaton of one shard, however long the texts are.  An
automaton goes to the shards that share a window with its own instead of to all, because broadcasting every shard to
every document would grow with the square of the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.shared import IdFilter, attach, cut, tidy
from pathweave.llm.words import Texts, runs, texts

WORD = re.compile("[^\x20\x09-\x0d]+")
SPACE = re.compile("[\x20\x09-\x0d]")
ANCHOR = 10  # words in an anchor
SHARD = 1 << 15  # words in one automaton, and of a text that are streamed through one at a time
STRETCH = 1 << 18  # words whose windows are worked out at once
APPLY = 1 << 20  # characters of a text whose words are held at once in the end
PER_BUCKET = 1 << 22  # hashes that one group is to receive
FLUSH = 1 << 20  # hashes that a task gathers before it sends them


def window_minima(h: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours: running minima of blocks from both ends."""
    n = len(h) - size + 1
    if n <= 0:
        return h[:0]
    padded = np.full(-(-len(h) // size) * size, np.iinfo(h.dtype).max, h.dtype)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[size - 1 : size - 1 + n])


def _windows(t: Texts, length: int, step: int, hashed: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Text and shard of each window within one text, its anchor and (hashed) its hash; those of some words at a time."""
    k = min(ANCHOR, length)
    for lo in range(0, len(t.hashes) - length + 1, STRETCH):
        own = t.hashes[lo : lo + STRETCH + length - 1]
        at = np.arange(lo, lo + len(own) - length + 1)
        doc = np.searchsorted(t.offsets, at, "right") - 1
        inside = np.flatnonzero(at + length <= t.offsets[1:][doc])
        doc = doc[inside]
        shard = (at[inside] - t.offsets[:-1][doc]) // step
        yield doc, shard, window_minima(runs(own, k), length - k + 1)[inside], runs(own, length)[inside] if hashed else None


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where the stretches of equal values begin in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _ranked(ids: np.ndarray, shards: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of each (id, shard) among the distinct ones in order, and these."""
    order = np.lexsort((shards, ids))
    i, s = ids[order], shards[order]
    new = np.concatenate([[True], (i[1:] != i[:-1]) | (s[1:] != s[:-1])])
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, i[new], s[new]


def _met(h: np.ndarray, unit: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, unit) in order, with the place of the hash's first unit and whether the unit is of that unit's document."""
    order = np.argsort(h)
    h, unit = h[order], unit[order]
    first = _firsts(h)
    size = np.diff(np.append(first, len(h)))
    many = np.flatnonzero(np.repeat(size > 1, size))
    if len(many):
        unit[many] = unit[many][np.lexsort((unit[many], h[many]))]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (unit[1:] != unit[:-1])])
        h, unit = h[new], unit[new]
        first = _firsts(h)
        size = np.diff(np.append(first, len(h)))
    owner = np.repeat(first, size)
    return h, unit, owner, ids[unit] == ids[unit[owner]]


def _pairs(unit: np.ndarray, owner: np.ndarray, own: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a unit and its reference among the places of ``_met``."""
    pairs = np.unique(unit[~own] * units + unit[owner[~own]])
    return pairs // units, pairs % units


_KINDS = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int8(), pa.binary())
_SENT_NAMES = ["bucket", "hashes", "ids", "shards", "which", "width", "several"]
_SENT = "bucket int, hashes binary, ids binary, shards binary, which binary, width byte, several binary"


def _by_bucket(h: np.ndarray, unit: np.ndarray, ids: np.ndarray, shards: np.ndarray, several: np.ndarray, buckets: int) -> Iterator[tuple]:
    """One row per range of the sorted hashes."""
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    at = np.append(_firsts(bucket), len(h))
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        used = np.zeros(len(ids), bool)
        used[unit[lo:hi]] = True
        which = (np.cumsum(used) - 1)[unit[lo:hi]].astype(np.uint16 if used.sum() <= 65536 else np.uint32)
        marks = np.packbits(several[lo:hi]).tobytes() if several[lo:hi].any() else b""
        yield (int(bucket[lo]), h[lo:hi].tobytes(), ids[used].tobytes(), shards[used].tobytes(), which.tobytes(), which.itemsize, marks)


def _received(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Hashes and units of a bucket, ids and shards of the units, and marks of the hashes."""
    hashes, ids, shards, units, marks, n = [], [], [], [], [], 0
    for h, i, s, which, width, several in zip(*(table.column(c).to_pylist() for c in _SENT_NAMES[1:]), strict=True):
        hashes.append(np.frombuffer(h, np.uint64))
        ids.append(np.frombuffer(i, np.int64))
        shards.append(np.frombuffer(s, np.int64))
        units.append(np.frombuffer(which, f"<u{width}").astype(np.int64) + n)
        n += len(ids[-1])
        size = len(hashes[-1])
        marks.append(np.unpackbits(np.frombuffer(several, np.uint8), count=size).astype(bool) if several else np.zeros(size, bool))
    rank, i, s = _ranked(np.concatenate(ids), np.concatenate(shards))
    return np.concatenate(hashes), rank[np.concatenate(units)], i, s, np.concatenate(marks)


def _sender(length: int, step: int, buckets: int, wanted: IdFilter | None):
    """Anchors of all windows, or (wanted) the windows whose anchor may be shared and, in buckets below zero, pairs of those met here."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, units, sent = [], 0, 0, 0

        def gathered() -> pa.RecordBatch:
            h, unit, ids, shards = (np.concatenate(x) for x in zip(*held, strict=True))
            rank, ids, shards = _ranked(ids, shards)
            h, unit, owner, own = _met(h, rank[unit], ids)
            several = np.zeros(len(h), bool)
            several[owner[~own]] = True
            rows = list(_by_bucket(h[own], unit[own], ids, shards, several[own], buckets))
            if wanted is not None and not own.all():
                d, o = _pairs(unit, owner, own, len(ids))
                rows.append((-1 - int(ids[d[0]] + sent) % buckets, ids[d].tobytes(), shards[d].tobytes(), ids[o].tobytes(), shards[o].tobytes(), 8, b""))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_SENT_NAMES)

        for batch in batches:
            ids = np.asarray(batch.column(0))
            for t, (doc, shard, anchor, h) in ((t, w) for t in texts(batch.column(1), lower=False) for w in _windows(t, length, step, wanted is not None)):
                if wanted is None:  # an anchor once for the neighbouring windows that have it
                    take = np.ones(len(doc), bool)
                    take[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                    h, shard = anchor, np.zeros(len(doc), np.int64)
                else:
                    take = wanted(anchor.view(np.int64))
                doc, shard, h = doc[take], shard[take], h[take]
                if not len(doc):
                    continue
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (shard[1:] != shard[:-1])])
                held.append((h, units + np.cumsum(new) - 1, ids[t.first : t.last][doc[new]], shard[new]))
                size, units = size + len(h), units + int(new.sum())
                if size >= FLUSH:
                    yield gathered()
                    held, size, units, sent = [], 0, 0, sent + 1
        if size:
            yield gathered()

    return send


def _shared_anchors(table: pa.Table) -> pa.Table:
    h, unit, ids, _, several = _received(table)
    order = np.argsort(h)
    h, id_of, several = h[order], ids[unit[order]], several[order]
    at = _firsts(h)
    shared = (np.minimum.reduceat(id_of, at) != np.maximum.reduceat(id_of, at)) | np.logical_or.reduceat(several, at)
    places = np.diff(np.append(at, len(h)))
    return pa.table({"anchor": pa.array(h[at[shared]].view(np.int64), pa.int64()), "places": pa.array(places[shared], pa.int64())})


_PAIR = "d long, ds long, o long, os long"


def _references(table: pa.Table) -> pa.Table:
    if table.column("bucket")[0].as_py() < 0:
        columns = [np.frombuffer(b"".join(x.as_py() for x in table.column(c)), np.int64) for c in _SENT_NAMES[1:5]]
    else:
        h, unit, ids, shards, _ = _received(table)
        _, unit, owner, own = _met(h, unit, ids)
        d, o = _pairs(unit, owner, own, len(ids))
        columns = [ids[d], shards[d], ids[o], shards[o]]
    return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("d", "ds", "o", "os"), columns, strict=True)})


def shards_of(text: str, length: int, size: int) -> Iterator[tuple[int, str]]:
    """Number and text of each shard: ``size`` words, of which the last length - 1 are the next one's first."""
    step = size - length + 1
    if len(text) < 2 * size:  # too short for more words than a shard has
        yield 0, text
        return
    starts: list[int] = []  # of the words that shards begin with
    ends: list[int] = []
    n = 0
    for n, m in enumerate(WORD.finditer(text), 1):
        if (n - 1) % step == 0:
            starts.append(m.start())
        if n >= size and (n - size) % step == 0:
            ends.append(m.end())
    if n <= size:
        yield 0, text
        return
    for k, at in enumerate(starts):
        if n - k * step >= length:
            yield k, text[at : ends[k] if k < len(ends) else len(text)]


class Automaton:
    """Suffix automaton of a sequence of words."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, word: str) -> int:
        step, link, length = self.next, self.link, self.length
        new = len(length)
        length.append(length[last] + 1)
        step.append({})
        link.append(0)
        p = last
        while p != -1 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p == -1:
            return new
        q = step[p][word]
        if length[p] + 1 == length[q]:
            link[new] = q
            return new
        copy = len(length)
        length.append(length[p] + 1)
        step.append(step[q].copy())
        link.append(link[q])
        while p != -1 and step[p].get(word) == q:
            step[p][word] = copy
            p = link[p]
        link[q] = link[new] = copy
        return new

    def spans(self, words: list[str], least: int) -> list[tuple[int, int]]:
        """Maximal stretches of ``words`` covered by matches of at least ``least`` words."""
        step, link, length = self.next, self.link, self.length
        state = matched = 0
        out: list[tuple[int, int]] = []
        for i, w in enumerate(words):
            while state and w not in step[state]:
                state = link[state]
                matched = length[state]
            if w in step[state]:
                state = step[state][w]
                matched += 1
                if matched >= least:
                    start = i + 1 - matched
                    while out and out[-1][1] >= start:
                        start = min(start, out.pop()[0])
                    out.append((start, i + 1))
        return out


def _match(length: int, step: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str | None, Automaton | None] = (None, None)
        for batch in batches:
            rows = {"d": [], "text_hash": [], "starts": [], "ends": []}
            for d, text_hash, shard, text, reference in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = WORD.findall(text)
                if text == reference:
                    spans = [(0, len(words))] if len(words) >= length else []
                else:
                    if held[0] != reference:
                        held = None, None  # not two automata at a time
                        held = reference, Automaton(WORD.findall(reference))
                    spans = held[1].spans(words, length)
                if spans:
                    first = shard * step
                    for name, x in zip(rows, (d, text_hash, [first + s for s, _ in spans], [first + e for _, e in spans]), strict=True):
                        rows[name].append(x)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

    return match


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, length: int, shard_words: int = SHARD) -> DataFrame:
    """d, text_hash, starts, ends: the words of each document that an earlier one has."""
    attach(docs)
    shard_words = max(shard_words, length)
    step = shard_words - length + 1
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    # the number of groups follows what they will hold: about one anchor per 64 bytes of text, 32 windows per shared anchor
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    anchors = source.mapInArrow(tidy(_sender(length, step, 1 + size // 64 // PER_BUCKET, None)), _SENT).groupBy("bucket").applyInArrow(_shared_anchors, "anchor long, places long")
    anchors = cut(anchors)
    places = anchors.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    wanted = IdFilter(anchors, "anchor")
    found = source.mapInArrow(tidy(_sender(length, step, 1 + 32 * places // PER_BUCKET, wanted)), _SENT).groupBy("bucket").applyInArrow(_references, _PAIR)
    pairs = cut(found.distinct())
    involved = IdFilter(pairs.select(F.explode(F.array("d", "o")).alias("id")).distinct(), "id")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chosen = b.filter(pa.array(involved(np.asarray(b.column(0)))))
            for lo in range(0, chosen.num_rows, 64):
                rows = [
                    (i, text_hash, *shard)
                    for i, text_hash, text in zip(*(c.to_pylist() for c in chosen.slice(lo, 64).columns), strict=True)
                    for shard in shards_of(text, length, shard_words)
                ]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "text_hash", "shard", "text"])

    chosen = source.select("id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(tidy(keep), "id long, text_hash long, shard long, text string")
    documents = pairs.join(chosen.select(F.col("id").alias("d"), "text_hash", F.col("shard").alias("ds"), "text"), ["d", "ds"])
    both = documents.join(chosen.select(F.col("id").alias("o"), F.col("shard").alias("os"), F.col("text").alias("reference")), ["o", "os"])
    spans = both.select("d", "text_hash", "ds", "text", "reference").mapInArrow(tidy(_match(length, step)), "d long, text_hash long, starts array<int>, ends array<int>")
    return spans.groupBy("d", "text_hash").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


def _pieces(text: str) -> Iterator[list[str]]:
    """The words of a text, those of about a megabyte at a time."""
    at = 0
    while at < len(text):
        gap = SPACE.search(text, at + APPLY) if at + APPLY < len(text) else None
        end = gap.start() if gap else len(text)
        yield WORD.findall(text, at, end)
        at = end


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, shard_words: int = SHARD) -> DataFrame:
    """``docs`` with n_words, n_removed and kept: the words that stay, joined by one space.

    Columns of these three names are replaced, all others stay.  A null text has no words; a null id is neither searched
    nor searched in; rows that repeat an id never remove each other's words.  A text shorter than ``length`` words stays
    whole.  Repeats within one document stay.  An empty table gives an empty result.  ``shard_words`` bounds the words of
    one automaton and changes no result.
    """
    made = ("n_words", "n_removed", "kept")
    own = docs.select(*[c for c in docs.columns if c not in made])
    spans = repeated_spans(docs, id_col, text_col, length, shard_words).withColumnsRenamed({"d": "__d", "text_hash": "__hash", "starts": "__starts", "ends": "__ends"})
    joined = own.join(
        spans, (F.col(id_col).cast("long") == F.col("__d")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__hash")), "left"
    ).select(*own.columns, F.col(text_col).cast("string").alias("__text"), "__starts", "__ends")

    names = [*own.columns, *made]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                n_words, n_removed, kept = [], [], []
                for text, starts, ends in zip(*(c.to_pylist() for c in batch.columns[-3:]), strict=True):
                    stay = np.ones(max(ends), bool) if starts else None
                    for a, b in zip(starts or (), ends or (), strict=True):
                        stay[a:b] = False
                    n, parts = 0, []
                    for words in _pieces(text or ""):
                        own = stay[n : n + len(words)] if starts else ()
                        n += len(words)
                        if not all(own):
                            words = [w for w, k in zip(words, own, strict=False) if k] + words[len(own) :]
                        if words:
                            parts.append(" ".join(words))
                    n_words.append(n)
                    n_removed.append(0 if stay is None else int((~stay).sum()))
                    kept.append(" ".join(parts))
                new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *new], names=names)

    schema = own.schema
    for name, kind in zip(made, ("long", "long", "string"), strict=True):
        schema = schema.add(name, kind)
    return joined.mapInArrow(tidy(apply), schema)
