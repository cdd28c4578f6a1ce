"""Counting which channel came before which along paths, with numpy.

What is known of a run of touches is a summary: how often each channel occurs, and how often each pair of channels occurs in
order.  Summaries of runs that follow one another merge: counts (c1 + c2) and pairs (m1 + m2 + c1 x c2) add up, in
any grouping.  So runs are counted wherever they are, and only summaries are brought together.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle

# the functions travel by value, so workers need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# bounds the table of running counts, which has one row per touch of a run and one column per channel in it
CELLS = 1 << 22


def _codes(channels: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Small numbers of the channels, and their names."""
    coded = (channels.combine_chunks() if isinstance(channels, pa.ChunkedArray) else channels).dictionary_encode("encode")
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary.to_pylist()


def _inside(channel: np.ndarray, first: np.ndarray, kind: np.ndarray, kinds: int) -> tuple[np.ndarray, ...]:
    """(kind, earlier, later, n) over the pairs of touches of each path: ``first`` is where a touch's path begins."""
    used, channel = np.unique(channel, return_inverse=True)
    n, c = len(channel), len(used)
    seen = np.zeros((n + 1, c), dtype=np.int64)
    seen[np.arange(1, n + 1), channel] = 1
    np.cumsum(seen, axis=0, out=seen)
    before = seen[:-1] - seen[first]
    group = kind * c + channel
    sums = np.stack([np.bincount(group, before[:, k], kinds * c) for k in range(c)], axis=1)
    row, earlier = np.nonzero(sums)
    return row // c, used[earlier], used[row % c], sums[row, earlier].astype(np.int64)


def _runs(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive paths of about ``most`` touches together."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        reached = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, reached + most, "right")))
        yield slice(start, stop)
        start = stop


class Summary:
    """The summary of a run that grows at its end; its size depends on the channels met, not on the touches."""

    def __init__(self):
        self.counts = np.zeros(0, np.int64)
        self.pairs = np.zeros((0, 0), np.int64)

    def add(self, channel: np.ndarray) -> None:
        if len(channel) == 0:
            return
        new = int(channel.max()) + 1
        if new > len(self.counts):
            new = max(new, 2 * len(self.counts))
            grown = np.zeros((new, new), np.int64)
            grown[: len(self.counts), : len(self.counts)] = self.pairs
            self.pairs, self.counts = grown, np.concatenate([self.counts, np.zeros(new - len(self.counts), np.int64)])
        step = max(1, CELLS // (int(channel.max()) + 1))
        for at in range(0, len(channel), step):
            part = channel[at : at + step]
            none = np.zeros(len(part), np.int64)
            _, a, b, n = _inside(part, none, none, 1)
            self.pairs[a, b] += n
            later, many = np.unique(part, return_counts=True)
            earlier = np.flatnonzero(self.counts)
            if len(earlier):  # what came before precedes all of the part
                self.pairs[np.ix_(earlier, later)] += np.outer(self.counts[earlier], many)
            self.counts[later] += many


PAIRS = pa.schema([("path_length", pa.int64()), ("channel_1", pa.string()), ("channel_2", pa.string()), ("n", pa.int64())])


def pairs_of_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (earlier, later) of whole paths (path_length, list of channels), summed per path length."""
    for batch in batches:
        lists = batch.column(1)
        sizes = np.diff(np.asarray(lists.offsets, dtype=np.int64))
        channel, names = _codes(lists.flatten())
        names = np.array(names, dtype=object)
        length = np.asarray(batch.column(0), dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        for run in _runs(sizes, max(1, CELLS // max(1, len(names)))):
            own, at = sizes[run], begins[run]
            part = channel[at[0] : at[-1] + own[-1]]
            if len(own) == 1 and len(part) * len(names) > CELLS:
                summary = Summary()
                summary.add(part)
                a, b = np.nonzero(summary.pairs)
                found = np.full(len(a), length[run.start]), a, b, summary.pairs[a, b]
            else:
                kinds, kind = np.unique(length[run], return_inverse=True)
                k, a, b, n = _inside(part, np.repeat(at - at[0], own), np.repeat(kind, own), len(kinds))
                found = kinds[k], a, b, n
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(names[found[1]], pa.string()), pa.array(names[found[2]], pa.string()), pa.array(found[3])], schema=PAIRS)


def _changes(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Where a row differs from the row before in one of the first columns; the first row is not marked."""
    marks = np.zeros(len(batch), dtype=bool)
    for i in range(width):
        now, before = batch.column(i).slice(1), batch.column(i).slice(0, len(batch) - 1)
        other = pc.fill_null(pc.not_equal(now, before), False)
        marks[1:] |= np.asarray(pc.or_(other, pc.not_equal(now.is_null(), before.is_null())))
    return np.flatnonzero(marks)


def summaries_of_slices(width: int, schema: pa.Schema):
    """A function for mapInArrow over sorted rows (``width`` columns that name a path, path_length, channel).

    For each path of a slice: its pairs, and rows without ``channel_2`` with the count of each channel.  A path may begin or end in
    other slices, and is not gathered.
    """

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        path, names, place, summary = None, [], {}, Summary()

        def found() -> pa.RecordBatch:
            a, b = np.nonzero(summary.pairs)
            c = np.flatnonzero(summary.counts)
            text, rows = np.array([*names, None], dtype=object), len(a) + len(c)
            columns = [pa.array([v] * rows, t.type) for v, t in zip((*path, at), schema)]
            first, second = np.concatenate([a, c]), np.concatenate([b, np.full(len(c), len(names))])
            n = np.concatenate([summary.pairs[a, b], summary.counts[c]])
            return pa.RecordBatch.from_arrays([*columns, pa.array(text[first], pa.string()), pa.array(text[second], pa.string()), pa.array(n)], schema=schema)

        for batch in batches:
            codes, known = _codes(batch.column(width + 1))
            cuts = [0, *_changes(batch, width).tolist(), len(batch)]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                own = tuple(batch.column(i)[start].as_py() for i in range(width + 1))
                if path is not None and own != path:
                    yield found()
                    names, place, summary = [], {}, Summary()
                path = own
                part, used = codes[start:stop], {}
                for code in np.unique(part).tolist():
                    if known[code] not in place:
                        place[known[code]] = len(names)
                        names.append(known[code])
                    used[code] = place[known[code]]
                to = np.zeros(len(known), np.int64)
                to[list(used)] = list(used.values())
                summary.add(to[part])
        if path is not None:
            yield found()

    return summarised
