"""Product quantisation of vectors by Lloyd's rounds over cover trees.

Vectors are floored to integers and cut into equal parts; each part has a codebook of its own.  Tasks pack the vectors that
they read into blocks and build, once, a cover tree per block and part: nets of halving radius, each point the child of
a point of the net before it.  Points are laid out so that a subtree is a range, with the radius that holds it.

A round sends the codebooks (fixed in size) to the blocks.  A node whose nearest entry is nearer than any other by more than
twice its radius gives that entry its whole subtree: count and coordinate sums are differences of two cumulative sums.
Only where that is not certain is the node's own point compared exactly and its children are looked at.  Sums per entry are added up by
Spark; the driver sees one row per coordinate of the codebooks, whatever the number of vectors.

Distances are sums of integers below 2**53, so exact in doubles; where the components are too large for that, Python
integers take their place.

What is defined: vectors that are null or empty, hold null or non-finite components, or differ in length from that of the first
vector (by id) take no part; a length that the parts do not divide, or components of 2**52 and more, are errors.  Null
ids come last among those that start the codebooks, ties of ids in order of their vectors.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.llm.shared import attach, cut, tidy

BLOCK = 1024  # vectors of a tree: building compares each with the nets before it
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
EXACT, LIMIT = 2.0**53, 2.0**52


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to each of y, exact."""
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)


class Tree:
    """A cover tree over the rows of ``x``: ``order`` lays them out, the subtree at place i is the places i to end[i]."""

    def __init__(self, x: np.ndarray):
        n, between = len(x), _squares(x, x).astype(float)
        parent = self._cover(between)
        children: list[list[int]] = [[] for _ in range(n)]
        for i, p in enumerate(parent):
            if p >= 0:
                children[p].append(i)
        order, stack = [], [0] if n else []
        while stack:
            i = stack.pop()
            order.append(i)
            stack.extend(children[i])
        self.order = np.array(order, np.int32)
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n)
        up = np.asarray(parent, np.int64)[self.order]
        self.parent = np.where(up < 0, -1, place[up]).astype(np.int32)
        size = [1] * n
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
        self.radius = np.zeros(n)
        for i in range(n):  # the farthest of a subtree, not a bound by levels
            if size[i] > 1:
                self.radius[i] = np.sqrt(between[order[i]][self.order[i + 1 : i + size[i]]].max())
        self.end = np.arange(n, dtype=np.int32) + np.array(size, np.int32)

    @staticmethod
    def _cover(between: np.ndarray) -> list[int]:
        """The parent of each row: the next row of the net is the one farthest from it, and once the farthest is
        within half the radius a net is complete; its points are the parents of the next net's."""
        n = len(between)
        if n == 0:
            return []
        parent = [-1] * n
        far, near = between[0].copy(), np.zeros(n, np.int64)
        far[0] = -1.0  # in the net
        above, scale = near.copy(), far.max() / 4
        for _ in range(n - 1):
            k = int(far.argmax())
            if far[k] <= 0:
                break
            if far[k] <= scale:
                above = near.copy()
                while far[k] <= scale:
                    scale /= 4
            parent[k], far[k] = int(above[k]), -1.0
            closer = np.flatnonzero(between[k] < far)
            far[closer], near[closer] = between[k][closer], k
        for k in np.flatnonzero(far == 0):  # equal to a point of the last net
            parent[k] = int(near[k])
        return parent

    def assign(self, x: np.ndarray, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, end, entry): ranges of places, each once, and the nearest entry (ties: the lower) of all in it.  ``x`` is laid out."""
        kids = np.argsort(self.parent, kind="stable")[1:]  # by parent; the root comes first
        first = np.searchsorted(self.parent[kids], np.arange(len(x) + 1))
        at = np.zeros(min(1, len(x)), np.int64)
        while len(at):
            exact = _squares(x[at], book)
            entry = exact.argmin(axis=1)
            distance = np.sqrt(exact.astype(float))
            best = distance[np.arange(len(at)), entry]
            distance[np.arange(len(at)), entry] = np.inf
            margin = 1e-9 * (1 + best + self.radius[at])
            sure = distance.min(axis=1) - best > 2 * self.radius[at] + margin
            leaf = self.end[at] - at == 1
            whole = sure | leaf
            yield at[whole], self.end[at[whole]].astype(np.int64), entry[whole]
            at, entry = at[~whole], entry[~whole]
            yield at, at + 1, entry
            many = first[at + 1] - first[at]
            at = kids[np.repeat(first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())].astype(np.int64)


def _integers(lists: pa.Array, exact: bool) -> np.ndarray:
    flat = np.asarray(lists.flatten().cast(pa.float64())).reshape(len(lists), -1)
    whole = np.floor(flat * SCALE)
    return whole if exact else np.array([[int(c) for c in row] for row in whole], object).reshape(whole.shape)


def _blocks(batches: Iterator[pa.RecordBatch], parts: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """Rows of (vectors, trees): BLOCK vectors each, with their other columns."""

    def packed(table: pa.Table) -> pa.RecordBatch:
        x = _integers(table.column("vector").combine_chunks(), exact)
        small = x.astype(np.int32) if exact and np.abs(x).max(initial=0) < 2**31 else x
        trees = [Tree(p) for p in np.split(x, parts, axis=1)]
        rows = table.drop_columns(["vector"]).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps((sink.getvalue().to_pybytes(), small, trees), 5)], pa.binary())], names=["block"])

    waiting: list[pa.RecordBatch] = []
    for b in batches:
        waiting.append(b)
        if sum(len(w) for w in waiting) >= BLOCK:
            table = pa.Table.from_batches(waiting)
            for at in range(0, len(table) - BLOCK + 1, BLOCK):
                yield packed(table.slice(at, BLOCK))
            rest = len(table) % BLOCK
            waiting = table.slice(len(table) - rest).to_batches() if rest else []
    if waiting:
        yield packed(pa.Table.from_batches(waiting))


def _opened(batches: Iterator[pa.RecordBatch], exact: bool):
    for b in batches:
        for block in b.column(0):
            rows, x, trees = pickle.loads(block.as_py())
            yield rows, (x.astype(float) if exact else x), trees


class Codes:
    """Codebooks fitted to the vectors of a table, and the codes of these vectors."""

    def __init__(
        self, vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", columns: tuple[str, ...] = (),
        parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    ):
        self.spark = attach(vectors)
        self.parts, self.entries = parts, entries
        other = {f"c{i}": F.col(c) for i, c in enumerate((vec_id, *columns))}
        self.names = dict(zip(other, (vec_id, *columns)))
        x = F.col("vector")
        finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        rows = vectors.select(*[c.alias(name) for name, c in other.items()], F.col(vector).cast("array<double>").alias("vector"))
        rows = rows.where(x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)))
        start = rows.orderBy(F.col("c0").asc_nulls_last(), "vector").limit(entries).collect()
        self.schema = rows.drop("vector").schema
        self.books: list[np.ndarray] = []
        if not start:
            self.table = None
            return
        length = len(start[0]["vector"])
        if length % parts:
            raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
        rows = rows.where(F.size(x) == length)
        largest = (rows.agg(F.max(F.array_max(F.transform(x, F.abs)))).first()[0] + 1) * SCALE
        if not largest < LIMIT:
            raise ValueError("components too large for exact distances")
        self.exact = exact = 4 * (length // parts) * largest**2 < EXACT
        self.table = cut(rows.mapInArrow(tidy(lambda batches: _blocks(batches, parts, exact)), "block binary"))
        first = _integers(pa.array([r["vector"] for r in start if len(r["vector"]) == length], pa.list_(pa.float64())), exact)
        self.books = np.split(first, parts, axis=1)
        for _ in range(rounds):
            self.books = self._moved()

    def _moved(self) -> list[np.ndarray]:
        """Each entry at the floored mean of the parts that are nearest to it."""
        books, exact = self.books, self.exact

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = [np.zeros(len(book), np.int64) for book in books]
            total = [np.zeros(book.shape, float if exact else object) for book in books]
            whole = [np.zeros(book.shape, object) for book in books]
            for k, (_, x, trees) in enumerate(_opened(batches, exact)):
                for part, (tree, x) in enumerate(zip(trees, np.split(x, len(books), axis=1))):
                    laid = x[tree.order]
                    before = np.concatenate([np.zeros((1, x.shape[1]), x.dtype), np.cumsum(laid, axis=0)])
                    for at, end, entry in tree.assign(laid, books[part]):
                        np.add.at(count[part], entry, end - at)
                        np.add.at(total[part], entry, before[end] - before[at])
                if k % 256 == 255:  # before sums of doubles can be inexact
                    for part, t in enumerate(total):
                        whole[part] += _python(t)
                        t[:] = 0
            found = []
            for part, t in enumerate(total):
                whole[part] += _python(t)
                for e in np.flatnonzero(count[part]):
                    found.append((part, int(e), -1, str(count[part][e])))
                    found += [(part, int(e), k, str(v)) for k, v in enumerate(whole[part][e])]
            names = ["part", "entry", "place", "total"]
            yield pa.RecordBatch.from_pylist([dict(zip(names, f)) for f in found], pa.schema([*[(c, pa.int32()) for c in names[:3]], ("total", pa.string())]))

        found = self.table.mapInArrow(tidy(sums), "part int, entry int, place int, total string")
        summed = found.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        by_place = {(r.part, r.entry, r.place): int(r.total) for r in summed}  # at most a row for each component of the codebooks
        moved = [book.copy() for book in books]
        for (part, entry, place), total in by_place.items():
            if place >= 0:
                moved[part][entry, place] = total // by_place[part, entry, -1]
        return moved

    def codes(self) -> DataFrame:
        """The id and other columns of each vector with its ``code`` (two hex digits a part) and ``error``, its squared distance from what the code stands for."""
        out = T.StructType([*self.schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        renamed = lambda df: df.withColumnsRenamed(self.names)
        if self.table is None:
            return renamed(self.spark.createDataFrame([], out))
        books, exact, digits = self.books, self.exact, max(2, len(f"{self.entries - 1:x}"))

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for stored, x, trees in _opened(batches, exact):
                entries = np.empty((len(x), len(books)), np.int64)
                error = np.zeros(len(x), np.int64 if exact else object)
                for part, (tree, x_part) in enumerate(zip(trees, np.split(x, len(books), axis=1))):
                    laid, nearest = x_part[tree.order], np.empty(len(x), np.int64)
                    for at, end, entry in tree.assign(laid, books[part]):
                        many = end - at
                        nearest[np.repeat(at - np.cumsum(many) + many, many) + np.arange(many.sum())] = np.repeat(entry, many)
                    entries[tree.order, part] = nearest
                    error[tree.order] += ((laid - books[part][nearest]) ** 2).sum(axis=1).astype(error.dtype)
                rows = pa.ipc.open_stream(stored).read_all().combine_chunks()
                code = pa.array(["".join(f"{e:0{digits}x}" for e in row) for row in entries], pa.string())
                columns = [rows.column(c) for c in rows.column_names]
                table = pa.table([*columns, code, pa.array([int(e) for e in error], pa.int64())], names=[*rows.column_names, "code", "error"])
                yield from table.to_batches()

        return renamed(self.table.mapInArrow(tidy(coded), out))

    def books_sha256(self) -> str:
        """SHA-256 of all integer components of the codebooks, by part, entry and place."""
        text = ",".join(str(int(v)) for book in self.books for row in book for v in row)
        return hashlib.sha256(text.encode()).hexdigest()


def _python(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
