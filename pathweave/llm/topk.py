"""Exact top-k inner-product search by block-max pruning.

The index packs vectors in ranges of their ids: a pack holds up to PACK vectors in blocks of BLOCK, and for each block the
largest and least value of every component.  A query bounds a block's scores by summing, over components, the larger of its
products with these two, orders the blocks by that bound, and scores whole blocks (their rows are the forward index) until
the next bound falls below its k-th score so far.  What is skipped cannot be in the result, so the result is exact.

Queries come in packs too; a pack of queries meets every pack of vectors once, on an equi-join over parts.  Tasks keep the
k best of each query over the packs they have seen, so later packs start with a high bound and little is sent on.

Scores are sums of doubles as long as these are exact.  Vectors too large for that are scored apart, in 64-bit
or unbounded integers.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathweave.llm.shared import attach, cut

PACK, BLOCK, QUERIES = 4096, 64, 512
STEP = 4  # blocks that a query scores before it looks at its bound again
KEPT = 128  # packs of queries whose best a task holds
EXACT = 2.0**53  # sums of doubles below it are exact


def _vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and floor(256 x) / 256 of each vector without null or non-finite components; others are left out."""
    lists = column.cast(pa.list_(pa.float64())) if not pa.types.is_float64(column.type.value_type) else column
    valid = np.asarray(lists.is_valid())
    offsets = np.asarray(lists.offsets)
    flat = lists.values
    null = np.asarray(flat.is_null())
    values = np.asarray(flat.fill_null(0.0))
    bad = null | ~np.isfinite(values)
    before = np.concatenate([[0], np.cumsum(bad)])
    for i in np.flatnonzero(valid):
        a, b = offsets[i], offsets[i + 1]
        if before[a] == before[b] and b > a:
            x = values[a:b]
            yield int(i), np.where(np.abs(x) < EXACT, np.floor(256.0 * np.clip(x, -EXACT, EXACT)) / 256.0, x)


def _packer(size: int, first: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, number = [], [], 0

        def send() -> pa.RecordBatch:
            m = np.stack(rows)
            row = (TaskContext.get().partitionId() * (1 << 32) + number, len(m[0]), np.array(ids, np.int64).tobytes(), m.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=[first, "dim", f"{first}_ids", f"{first}_values"])

        for batch in batches:
            keys = batch.column(0)
            for i, v in _vectors(batch.column(1)):
                key = keys[i].as_py()
                if key is None:
                    continue
                if rows and (len(rows) == size or len(rows[0]) != len(v)):
                    yield send()
                    ids, rows, number = [], [], number + 1
                ids.append(key)
                rows.append(v)
        if rows:
            yield send()

    return pack


class _Best:
    """The k best of each query of a pack: higher scores first, then smaller ids."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.large: dict[int, list[tuple[int, int]]] = {}  # of a query's place: score with its sign turned, and id

    def add(self, at: np.ndarray, scores: np.ndarray, found: np.ndarray) -> None:
        scores = np.where(found == self.ids[at][:, None], -np.inf, scores)
        s, f = np.concatenate([self.scores[at], scores], axis=1), np.concatenate([self.found[at], found], axis=1)
        order = np.lexsort((f, -s), axis=1)[:, : self.k]
        self.scores[at], self.found[at] = np.take_along_axis(s, order, 1), np.take_along_axis(f, order, 1)

    def add_large(self, at: int, scores: list[int], found: np.ndarray) -> None:
        own = int(self.ids[at])
        new = [(-s, i) for s, i in zip(scores, found.tolist(), strict=True) if i != own]
        self.large[at] = heapq.nsmallest(self.k, self.large.get(at, []) + new)

    def rows(self) -> pa.RecordBatch:
        """The best found; ``beyond`` tells scores above (1) or below (-1) what a long holds."""
        good = np.isfinite(self.scores)
        large = [(int(self.ids[at]), i, -s) for at, best in self.large.items() for s, i in best]
        beyond = [int(s >= 2**63) - int(s < -(2**63)) for _, _, s in large]
        queries = np.concatenate([np.repeat(self.ids, good.sum(axis=1)), np.array([q for q, _, _ in large], np.int64)])
        found = np.concatenate([self.found[good], np.array([i for _, i, _ in large], np.int64)])
        scores = np.concatenate([self.scores[good].astype(np.int64), np.array([0 if b else s for (_, _, s), b in zip(large, beyond, strict=True)], np.int64)])
        sides = np.concatenate([np.zeros(int(good.sum()), np.int32), np.array(beyond, np.int32)])
        return pa.RecordBatch.from_arrays(list(map(pa.array, (queries, found, sides, scores))), names=["query_id", "vec_id", "beyond", "score"])


def _integers(v: np.ndarray) -> np.ndarray:
    """256 v as unbounded integers."""
    return np.frompyfunc(lambda x: int(x) * 256 if abs(x) >= EXACT else int(x * 256.0), 1, 1)(v)


def _search_large(q: np.ndarray, best: _Best, queries: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
    """Score the queries at some places of a pack against all of some vectors, in integers."""
    if not len(queries) or not len(v):
        return
    fits = float(np.abs(q[queries]).max()) * float(np.abs(v).max()) * v.shape[1] < 2.0**46  # so that sums are below 2**62
    whole = (lambda x: (256.0 * x).astype(np.int64)) if fits else _integers
    columns = whole(v).T
    for at in queries.tolist():
        best.add_large(at, (whole(q[at : at + 1]) @ columns)[0].tolist(), ids)


def _search_any(q: np.ndarray, best: _Best, ids: np.ndarray, v: np.ndarray) -> None:
    """Score a pack of queries against a pack of vectors, both divided by 256 and of any size."""
    dim = v.shape[1]
    a, b = np.abs(q).max(axis=1), np.abs(v).max(axis=1)
    with np.errstate(over="ignore"):
        small = 65536.0 * a.max() * b.max() * dim < EXACT
    if small:
        _search(256.0 * q, best, np.arange(len(q)), ids, 256.0 * v)
        return
    limit = np.sqrt(EXACT / dim) / 512.0  # two such components' products sum below EXACT
    few, many = np.flatnonzero(a > limit), np.flatnonzero(a <= limit)
    low = b <= limit
    if len(many) and low.any():
        _search(256.0 * q, best, many, ids[low], 256.0 * v[low])
    _search_large(q, best, few, ids, v)
    _search_large(q, best, many, ids[~low], v[~low])


def _search(q: np.ndarray, best: _Best, active: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
    """Score the queries at the places ``active`` of a pack against the blocks of a pack of vectors that can still matter."""
    n_blocks = -(-len(v) // BLOCK)
    padded = np.zeros((n_blocks * BLOCK, v.shape[1]))
    padded[: len(v)] = v
    padded[len(v) :] = v[-1]
    blocks = padded.reshape(n_blocks, BLOCK, -1)
    block_ids = np.concatenate([ids, np.full(len(padded) - len(v), -1)]).reshape(n_blocks, BLOCK)
    real = (np.arange(len(padded)) < len(v)).reshape(n_blocks, BLOCK)
    bounds = np.full((len(q), n_blocks), -np.inf)
    bounds[active] = np.maximum(q[active], 0) @ blocks.max(axis=1).T + np.minimum(q[active], 0) @ blocks.min(axis=1).T
    order = np.argsort(-bounds, axis=1, kind="stable")
    for r in range(0, n_blocks, STEP):
        active = active[bounds[active, order[active, r]] >= best.scores[active, -1]]
        if not len(active):
            break
        for lo in range(0, len(active), 64):
            at = active[lo : lo + 64]
            chosen = order[at, r : r + STEP]
            scores = np.einsum("qbnd,qd->qbn", blocks[chosen], q[at], optimize=True).reshape(len(at), -1)
            found = block_ids[chosen].reshape(len(at), -1)
            best.add(at, np.where(real[chosen].reshape(len(at), -1), scores, -np.inf), found)


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, tuple[np.ndarray, _Best]] = OrderedDict()
        for batch in batches:
            for q_pack, q_ids, q_values, dim, v_ids, v_values in zip(*batch.columns, strict=True):
                key, dim = q_pack.as_py(), dim.as_py()
                if key not in kept:
                    ids = np.frombuffer(q_ids.as_py(), np.int64)
                    kept[key] = np.frombuffer(q_values.as_py(), np.float64).reshape(-1, dim), _Best(ids, k)
                    if len(kept) > KEPT:
                        yield kept.popitem(last=False)[1][1].rows()
                kept.move_to_end(key)
                q, best = kept[key]
                v = np.frombuffer(v_values.as_py(), np.float64).reshape(-1, dim)
                _search_any(q, best, np.frombuffer(v_ids.as_py(), np.int64), v)
        for _, best in kept.values():
            yield best.rows()

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k largest inner products of each query with the other rows.

    Components become floor(256 x).  Ties go to the smaller id.  Vectors that are null or empty, hold null or non-finite
    components or have a null id take no part, and vectors only meet those of their own length; rows with a query's own id
    are no candidates for it.  Queries with fewer than k candidates give them all.  Components may have any size;
    only a score among the k best that BIGINT cannot hold is an error.
    """
    attach(vectors)

    def packs(rows: DataFrame, size: int, first: str) -> DataFrame:
        own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
        ordered = own.repartitionByRange("id").sortWithinPartitions("id")
        return cut(ordered.mapInArrow(_packer(size, first), f"{first} long, dim int, {first}_ids binary, {first}_values binary"))

    blocks, asked = packs(vectors, PACK, "p"), packs(queries, QUERIES, "q")
    parts = min(max(1, blocks.count()), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = blocks.withColumn("part", F.pmod(F.xxhash64("p"), F.lit(parts)))
    spread = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    met = spread.join(dealt, ["part", "dim"]).select("q", "q_ids", "q_values", "dim", "p_ids", "p_values")
    found = met.mapInArrow(_searcher(k), "query_id long, vec_id long, beyond int, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), "vec_id"))
    best = found.select("query_id", rank.alias("rank"), "vec_id", "beyond", "score").where(F.col("rank") <= k)
    score = F.when(F.col("beyond") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score among the k best exceeds BIGINT")).cast("long"))
    return best.select("query_id", "rank", "vec_id", score.alias("score"))
