"""Exact Jaccard join on word n-grams, as a size-aware heavy-light join.

Texts with the same set of shingles are one *set* from the start, represented by the smallest id.

* Light sets (at most ``boundary`` shingles) enumerate, for each size m a partner can have, their
  subsets of exactly the overlap that sizes (n, m) need.  Two light sets share such a key if and
  only if they are similar, so the members of a key are tied to its smallest member: no pairs, no check.
* Heavy sets scan inverted lists.  In any fixed order of all shingles, similar sets share one of their
  first n - ceil(t n) + 1, so only these are listed; light sets are listed too where a heavy set can
  be similar to them.  The order puts the shingles found in many sets last (document frequencies are
  counted over all sets), so boilerplate is listed only by sets that are mostly boilerplate.  Any order
  gives the same result.
* The boundary is the size at which the two ways cost the same: keys enumerated against postings
  listed and checked, summed over the histogram of set sizes.

Lists of rare shingles are short and pair their members inside one task.  Lists of frequent shingles
are never gathered: each member is paired with the list's first member; what is then connected needs
no further pair; pairs between members of a list that are still in different components follow from a join of the
rest, on the list and the size: the smaller set goes to the sizes that it can still be similar to with what it has left of the order.
Sets of a template with words of their own, too many for a link, thus meet nobody.  Every pair is checked on the two
whole sets.

The work moves as packed arrays: a task sorts the hashes of many texts at once and sends one row
per range of hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.shared import IdFilter, attach, components, cut, tidy
from pathweave.llm.words import mix, shingle_sets, texts

FREQUENT = 16  # sets in which a shingle must be found to be put last in the order
MAX_FREQUENT = 1 << 17  # the most frequent ones that are broadcast (2 MB)
PER_BUCKET = 1 << 21  # hashes that one group is to receive
FLUSH = 1 << 20  # hashes that a task gathers before it sends them
MAX_LIGHT = 16  # largest boundary considered
CHECK_COST = 4.0  # of a candidate's check, in keys


def overlap(n: int, m: int, num: int, den: int) -> int:
    """Shared shingles that sets of n and m need for num/den of their union."""
    return -(-num * (n + m) // (num + den))


def prefix_length(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def partner_sizes(n: int, num: int, den: int) -> range:
    return range(-(-num * n // den), den * n // num + 1)


def subset_keys(n: int, boundary: int, num: int, den: int) -> int:
    return sum(math.comb(n, overlap(n, m, num, den)) for m in partner_sizes(n, num, den) if m <= boundary)


def choose_boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """The size up to which enumerating subsets is the cheaper way; sizes: sets of each size up to 2 * MAX_LIGHT."""

    def cost(boundary: int) -> float:
        return sum(
            count
            * (
                (subset_keys(n, boundary, num, den) if n <= boundary else 0)
                + (CHECK_COST * prefix_length(n, num, den) if den * n >= num * (boundary + 1) else 0)
            )
            for n, count in sizes.items()
        )

    return min(range(MAX_LIGHT + 1), key=cost)


def _profiles(n_words: int, columns: str):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for t in texts(batch.column(1), lower=True):
                offsets, h = shingle_sets(t, n_words)
                n = np.diff(offsets)
                sums = [np.zeros(len(h) + 1, np.uint64) for _ in range(2)]
                np.cumsum(h, out=sums[0][1:])
                np.cumsum(mix(h + np.uint64(0x5851F42D4C957F2D)), out=sums[1][1:])
                a, b = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(t.first, t.last - t.first), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=columns.split()
                )

    return profile


def _place(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (a range of the high half) and key (the low half) of each hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), h.astype(np.uint32)


def _split(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The stretches of equal values in a sorted array."""
    at = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi > lo:
            yield int(bucket[lo]), slice(int(lo), int(hi))


def _chosen(batches: Iterator[pa.RecordBatch], wanted: IdFilter, n_words: int):
    """Ids, offsets and hashes of the wanted texts' sets."""
    for batch in batches:
        ids = np.asarray(batch.column(0))
        keep = wanted(ids)
        if not keep.any():
            continue
        ids, column = ids[keep], batch.column(1).filter(pa.array(keep))
        for t in texts(column, lower=True):
            yield ids[t.first : t.last], *shingle_sets(t, n_words)


def frequent(docs: DataFrame, wanted: IdFilter, total: int, n_words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The shingles of at least FREQUENT sets, as sorted codes, with these counts; and the number of buckets."""
    buckets = max(1, -(-total // PER_BUCKET))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            h, times = np.unique(np.concatenate(held), return_counts=True)
            bucket, key = _place(h, buckets)
            rows = []
            for b, at in _split(bucket):
                more = times[at] > 1
                rows.append((b, key[at].tobytes(), key[at][more].tobytes(), (times[at][more] - 1).astype(np.int64).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["bucket", "keys", "again", "times"])

        for _, _, h in _chosen(batches, wanted, n_words):
            if len(h):
                held.append(h)
                size += len(h)
            if size >= FLUSH:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    def add(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)
        keys, times = np.unique(join("keys", np.uint32), return_counts=True)
        again = join("again", np.uint32)
        np.add.at(times, np.searchsorted(keys, again), join("times", np.int64))
        many = times >= FREQUENT
        code = (np.int64(table.column("bucket")[0].as_py()) << 32) | keys[many].astype(np.int64)
        return pa.table({"code": pa.array(code, pa.int64()), "sets": pa.array(times[many], pa.int64())})

    counted = docs.mapInArrow(tidy(count), "bucket int, keys binary, again binary, times binary").groupBy("bucket").applyInArrow(add, "code long, sets long")
    top = counted.orderBy(F.desc("sets"), "code").limit(MAX_FREQUENT).toArrow()
    codes, sets = (top.column(c).to_numpy() for c in ("code", "sets"))
    order = np.argsort(codes)
    return codes[order], sets[order], buckets


def _pack(n, left):
    """A set's size, and how many of its shingles come from here on in the order."""
    return (np.asarray(n, np.int64) << 32) | np.asarray(left, np.int64)


def _unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x >> 32, x & 0xFFFFFFFF


PAIR, LISTED, LIGHT = 0, 1, 2
_ENTRY = "bucket int, kind byte, keys binary, ids binary, sizes binary"
_ROW = "kind byte, h long, a long, b long, n long"  # of a list's member b is what is left of the order


def _entries(wanted, n_words, num, den, boundary, buckets, codes):
    """Postings of the sets' prefixes and keys of light sets, packed by bucket (negative: nothing to pair in there)."""

    def light(i: int, s: np.ndarray, into: list) -> None:
        n = len(s)
        for m in partner_sizes(n, num, den):
            if m <= boundary:
                need = overlap(n, m, num, den)
                salt = np.uint64(min(n, m) * 4096 + max(n, m))
                for subset in combinations(s.tolist(), need):
                    x = sum(subset) & 0xFFFFFFFFFFFFFFFF
                    into.append((int(mix(np.array([x], np.uint64) ^ mix(np.array([salt])))[0].view(np.int64)), i, int(_pack(n, n))))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, at_code = codes.value
        seen = np.zeros(1 << 20, bool)
        seen[coded & 0xFFFFF] = True
        rare, other, size, sent = [], [], 0, 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal sent
            rows = []
            if rare:
                h, ids, n = (np.concatenate(x) for x in zip(*rare, strict=True))
                order = np.argsort(h)
                bucket, key = _place(h[order], buckets)
                for b, at in _split(bucket):
                    take = order[at]
                    rows.append((b, PAIR, key[at].tobytes(), ids[take].tobytes(), n[take].astype(np.int64).tobytes()))
            for kind in (LISTED, LIGHT):
                own = [x for k, x in other if k == kind]
                if own:
                    h, ids, n = (np.concatenate(x) for x in zip(*own, strict=True))
                    sent += 1
                    rows.append((-1 - int(ids[0] + sent) % buckets, kind, h.tobytes(), ids.tobytes(), n.astype(np.int64).tobytes()))
            if rows:
                kinds = (pa.int32(), pa.int8(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "kind", "keys", "ids", "sizes"])

        for ids, offsets, h in _chosen(batches, wanted, n_words):
            n = np.diff(offsets)
            doc = np.repeat(np.arange(len(n)), n)
            bucket, key = _place(h, buckets)
            code = (bucket.astype(np.int64) << 32) | key.astype(np.int64)
            many = seen[code & 0xFFFFF]
            where = np.zeros(len(h), np.int64)
            at = np.flatnonzero(many)
            if len(at):
                found = np.searchsorted(coded, code[at])
                found[found == len(coded)] = 0
                many[at] = coded[found] == code[at]
                where[at] = found
            listed = den * n >= num * (boundary + 1)
            length = np.where(listed, prefix_length(n, num, den), 0)
            cold = ~many
            before = np.cumsum(cold) - cold
            rank = before - before[offsets[:-1][doc]] if len(doc) else before
            take = cold & (rank < length[doc])
            rare.append((h[take], ids[doc[take]], _pack(n[doc[take]], n[doc[take]] - rank[take])))
            left = length - np.bincount(doc[take], minlength=len(n))
            for i in np.flatnonzero(left > 0):
                own = np.flatnonzero(many[offsets[i] : offsets[i + 1]]) + offsets[i]
                own = own[np.lexsort((code[own], at_code[where[own]]))][: left[i]]
                rest = n[i] - (length[i] - left[i]) - np.arange(len(own))
                other.append((LISTED, (code[own], np.full(len(own), ids[i]), _pack(n[i], rest))))
                size += len(own)
            keys: list = []
            for i in np.flatnonzero((n > 0) & (n <= boundary)):
                light(int(ids[i]), h[offsets[i] : offsets[i + 1]], keys)
            if keys:
                other.append((LIGHT, tuple(np.array(x, np.int64) for x in zip(*keys, strict=True))))
            size += int(take.sum()) + len(keys)
            if size >= FLUSH // 2:
                yield from send()
                rare, other, size = [], [], 0
        yield from send()

    return prefixes


def _pairs(num: int, den: int):
    """What a bucket's entries give: candidate pairs from its short lists, the rest as they are."""

    def pairs(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)
        bucket = table.column("bucket")[0].as_py()
        ids = join("ids", np.int64)
        n, left = _unpack(join("sizes", np.int64))
        if bucket < 0:
            h = join("keys", np.int64)
            lengths = [len(x.as_py()) // 8 for x in table.column("keys")]
            kind = np.repeat(table.column("kind").to_numpy(), lengths)
            return _rows(kind, h, ids, left, n)
        key = join("keys", np.uint32)
        order = np.argsort(key, kind="stable")
        key, ids, n, left = key[order], ids[order], n[order], left[order]
        at = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        size = np.diff(at)
        found = []
        for length in np.unique(size[(size > 1) & (size <= 2 * FREQUENT)]):
            lists = at[:-1][size == length][:, None] + np.arange(length)
            i, j = np.triu_indices(length, 1)
            i, j = lists[:, i].ravel(), lists[:, j].ravel()
            near = (num * np.maximum(n[i], n[j]) <= den * np.minimum(n[i], n[j])) & (ids[i] != ids[j])
            near &= (num + den) * np.minimum(left[i], left[j]) >= num * (n[i] + n[j])
            i, j = i[near], j[near]
            found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], axis=1))
        out = []
        if found:
            two = np.unique(np.concatenate(found), axis=0)
            out.append(_rows(np.full(len(two), PAIR, np.int8), None, two[:, 0], two[:, 1], None))
        long = np.repeat(size > 2 * FREQUENT, size)  # a frequent shingle beyond those that are broadcast
        if long.any():
            out.append(_rows(np.full(long.sum(), LISTED, np.int8), (np.int64(bucket) << 32) | key[long].astype(np.int64), ids[long], left[long], n[long]))
        return pa.concat_tables(out) if out else _rows(*[np.zeros(0, np.int64)] * 5)

    return pairs


def _rows(kind, h, a, b, n) -> pa.Table:
    size = len(a)
    return pa.table({"kind": pa.array(kind, pa.int8())} | {c: pa.nulls(size, pa.int64()) if x is None else pa.array(x, pa.int64()) for c, x in zip("habn", (h, a, b, n), strict=True)})


def verified(pairs: DataFrame, docs: DataFrame, n_words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of ids whose whole sets are similar.  Texts, not sets, are shuffled: they are smaller."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = IdFilter(ids, "id")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chosen = b.filter(pa.array(wanted(np.asarray(b.column(0)))))
            if chosen.num_rows:
                yield chosen

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sides = []
                for c in (2, 3):
                    sets = []
                    for t in texts(part.column(c), lower=True):
                        offsets, h = shingle_sets(t, n_words)
                        sets += [h[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                    sides.append(sets)
                good = []
                for x, y in zip(*sides, strict=True):
                    both = np.concatenate([x, y])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    good.append(len(x) > 0 and den * shared >= num * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    chosen = docs.mapInArrow(tidy(keep), "id long, text string")
    with_a = pairs.join(chosen.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(chosen.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(tidy(check), "a long, b long")


def size_band(n):
    """A number that grows with the size: sizes below 64 have their own, others share one with those within a 64th."""
    return F.when(n < 64, n).otherwise(64 + F.floor(64 * F.log(n / F.lit(64.0)))).cast("int")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles and component_id, the smallest id that links reach.

    Two texts are linked when their sets of ``n_words``-word shingles (A-Z lower-cased) share at least
    num/den of their union.  A text of fewer words has its whole sequence as one shingle; null texts
    and texts without words have none (n_shingles 0) and stay alone.  Rows that repeat an id are
    each returned, the links of any of them count for the id; a null id gets n_shingles and a null component.
    Other columns are ignored.  An empty table gives an empty result.
    """
    num, den = threshold
    spark = attach(docs)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profiles = cut(source.mapInArrow(tidy(_profiles(n_words, "id n sig_a sig_b")), "id long, n long, sig_a long, sig_b long"))
    known = profiles.where("id is not null and n > 0")
    source = source.where("id is not null")
    sets = known.groupBy("sig_a", "sig_b", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    total, reps = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    result = profiles.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"))
    if reps == 0:
        return result.withColumn("component_id", F.col(id_col))

    sizes = {r["n"]: r["count"] for r in sets.where(F.col("n") <= 2 * MAX_LIGHT).groupBy("n").count().collect()}
    boundary = choose_boundary(sizes, num, den)
    wanted = IdFilter(sets, "rep")
    codes, counts, buckets = frequent(source, wanted, total, n_words)
    shared = spark.sparkContext.broadcast((codes, counts))
    made = _entries(wanted, n_words, num, den, boundary, buckets, shared)
    rows = cut(source.mapInArrow(tidy(made), _ENTRY).groupBy("bucket").applyInArrow(_pairs(num, den), _ROW))

    def star(listed: DataFrame, by: str) -> DataFrame:
        return listed.join(listed.groupBy(by).agg(F.min_by(F.struct("a", "n", "b"), "a").alias("first")), by)

    light = star(rows.where(f"kind = {LIGHT}"), "h").select(F.col("first.a").alias("b"), "a").where("a <> b")
    copies = known.join(sets.where("copies > 1"), ["sig_a", "sig_b", "n"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    listed = rows.where(f"kind = {LISTED}")

    def may_link(x: str, y: str):
        """Sizes, and what both sets still have from the shingle they share on, allow the overlap that is needed.
        It holds where a linked pair's first common shingle is listed, so every such pair is found there."""
        n, m, left, other = (F.col(c) for c in (f"{x}n", f"{y}n", f"{x}b", f"{y}b"))
        return (num * F.greatest(n, m) <= den * F.least(n, m)) & ((num + den) * F.least(left, other) >= num * (n + m))

    stars = star(listed, "h").where(may_link("", "first.")).select(F.least("a", "first.a").alias("a"), F.greatest("a", "first.a").alias("b"))
    pairs = rows.where(f"kind = {PAIR}").select("a", "b").union(stars).where("a <> b").distinct()
    edges = cut(reduce(DataFrame.union, [light.select("a", "b").distinct(), copies, verified(cut(pairs), source, n_words, num, den)]))
    roots = cut(components(edges))

    # lists whose members are not yet connected: the pairs between different components
    rest = listed.join(roots, listed["a"] == roots["node"], "left").select("h", "a", "n", "b", F.coalesce("root", "a").alias("root"))
    open_lists = rest.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    rest = rest.join(open_lists, "h", "left_semi")
    size, left = F.col("n"), F.col("b")
    largest = F.least(F.floor(F.lit(den) * size / F.lit(num)), F.floor(F.lit(num + den) * left / F.lit(num)) - size)
    smaller = rest.where(largest >= size).withColumn("band", F.explode(F.sequence(size_band(size), size_band(largest))))
    x, y = smaller.alias("x"), rest.withColumn("band", size_band(size)).alias("y")
    order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.a") < F.col("y.a")))
    across = (
        x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.band") == F.col("y.band")) & order & (F.col("x.root") != F.col("y.root")) & may_link("x.", "y."))
        .select(F.least("x.a", "y.a").alias("a"), F.greatest("x.a", "y.a").alias("b"))
        .distinct()
        .join(pairs, ["a", "b"], "left_anti")
    )
    across = cut(across)
    if not across.isEmpty():
        more = verified(across, source, n_words, num, den)
        ends = more.join(roots.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left").join(roots.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left")
        ends = ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(ends))
    return result.join(roots, result[id_col] == roots["node"], "left").select(id_col, "n_shingles", F.coalesce("root", id_col).alias("component_id"))
