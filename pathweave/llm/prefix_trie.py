"""The prefix trie of conversations from padded matrices of turn ids.

A turn is known by 128 bits of SHA-256 over its role and text, so texts are read once and never shuffled.  A conversation is
a row of turn ids, cut into segments of WIDTH turns; a segment carries the xor of the ids before it, which with its
first j ids names the node after j more turns.  Segments are range-partitioned by (segment, prefix, ids, conversation):
neighbours in that order share nodes, and equal conversations, however many, lie in as many shards as it takes.

A shard is a batch of Arrow rows.  There numpy sorts the padded matrix (lexsort), marks where a row differs from the one before
in some column, and accumulates these marks over the columns: a node starts where the accumulated mark is set.  Then
reduceat over the starts of a depth gives members, least conversation, children and the sums over subtrees of that depth.

Nodes that hold the first or last row of a shard, or go on in a further segment, are *open*: what shards know of them is
added up by node, and subtree sums flow along open parents by pointer doubling (a number of rounds logarithmic in the depth).
Their number depends on that of shards, not of conversations, unless conversations are longer than a segment.

The digest of the conversations that end at a node runs over their ids in order.  Inside a shard it is made there; ids of open nodes
come as one block of text per shard, in order, and a task feeds them to the hash one after the other without keeping them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathweave.llm.shared import attach, cut, tidy
from pathweave.operators.ordered import numbered

WIDTH = 64
GROUP_OF_SEGMENTS = 1024
NO_ENDS = hashlib.sha256(b"").hexdigest()
PAD = np.iinfo(np.int64).min

_NODES = (
    "depth long, k0 long, k1 long, open boolean, conv_id long, n_convs long, n_children long, n_leaves long, saved long, more_leaves long,"
    " more_saved long, chars long, p0 long, p1 long, parent_open boolean, parent_conv_id long, first_end long, ends string"
)


def turn_ids(role: Column, text: Column) -> tuple[Column, Column]:
    """128 bits of a digest of a turn; null role or text is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return tuple(F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, k0, k1, chars): the turns of each conversation in order, from 1.

    Order is by turn, nulls first; turns of one number are in the order of their ids.  Rows without conv_id are no
    conversation's.  A conversation may hold any share of all rows.
    """
    k0, k1 = turn_ids(F.col("role"), F.col("text"))
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", k0.alias("k0"), k1.alias("k1"), chars.alias("chars"), F.monotonically_increasing_id().alias("row")
    )
    found = numbered(cut(turns), ["conv_id"], ["turn", "k0", "k1", "row"], "place")
    return cut(found.select("conv_id", F.col("place").cast("long").alias("place"), "k0", "k1", "chars"))


def rebuilt(turns: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations with the head of another, and all conversation ids.

    Conversation c gets the first h turns of conversation c - c % ``every`` (all if fewer, none if that is absent) and
    then its own turns after its first h; h = crc32(c as text) % ``heads``.  At most ``heads`` - 1 turns of a conversation are copied.
    """
    def head(c: str) -> Column:
        return F.crc32(F.col(c).cast("string")) % heads

    convs = cut(turns.select("conv_id").distinct())
    bases = turns.where((F.col("conv_id") % every == 0) & (F.col("place") < heads)).withColumnRenamed("conv_id", "base")
    wanting = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": head("conv_id")}).where("h > 0")
    copied = wanting.join(bases, "base").where("place <= h").select("conv_id", F.col("place").alias("depth"), "k0", "k1", "chars")
    there = bases.groupBy("base").agg(F.count(F.lit(1)).alias("there"))
    lacking = wanting.join(there, "base", "left").select("conv_id", (F.col("h") - F.least(F.coalesce("there", F.lit(0)), F.col("h"))).alias("lack")).where("lack > 0")
    own = turns.where(F.col("place") > head("conv_id")).join(lacking, "conv_id", "left")
    own = own.select("conv_id", (F.col("place") - F.coalesce("lack", F.lit(0))).alias("depth"), "k0", "k1", "chars")
    return copied.unionByName(own), convs


def _segments(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """(conv_id, segment, h0, h1, path, chars, last): ``path`` has two numbers a turn, h0 and h1 the xor of those before it.

    The numbers depend on the depth, so that their xor depends on the order of turns.
    """
    ids = [F.xxhash64("k0", "k1", "depth"), F.xxhash64("depth", "k1", "k0")]
    step = F.struct("depth", ids[0].alias("e0"), ids[1].alias("e1"), "chars")
    rows = turns.select("conv_id", F.floor((F.col("depth") - 1) / width).alias("segment"), step.alias("step"))
    # a conversation without turns has a segment too
    rows = rows.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("segment"), F.lit(None).cast(rows.schema["step"].dataType).alias("step")))
    found = rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("step")).alias("steps"), F.bit_xor("step.e0").alias("x0"), F.bit_xor("step.e1").alias("x1"))
    path = F.flatten(F.transform("steps", lambda s: F.array(s["e0"], s["e1"])))
    found = cut(found.select("conv_id", "segment", path.alias("path"), F.col("steps.chars").alias("chars"), "x0", "x1"))
    zero = F.lit(0).cast("long")
    if found.where("segment > 0").isEmpty():
        return found.select("conv_id", "segment", zero.alias("h0"), zero.alias("h1"), "path", "chars", F.lit(True).alias("last"))
    found = found.withColumn("run", F.floor(F.col("segment") / GROUP_OF_SEGMENTS))
    runs = found.groupBy("conv_id", "run").agg(F.bit_xor("x0").alias("r0"), F.bit_xor("x1").alias("r1"), F.max("segment").alias("final"))
    before = W.partitionBy("conv_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        "conv_id", "run", F.max("final").over(W.partitionBy("conv_id")).alias("final"),
        *[F.coalesce(F.bit_xor(f"r{i}").over(before), zero).alias(f"b{i}") for i in (0, 1)],
    )
    inside = W.partitionBy("conv_id", "run").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumns({f"h{i}": F.coalesce(F.bit_xor(f"x{i}").over(inside), zero) for i in (0, 1)}).join(runs, ["conv_id", "run"])
    heads = [F.col(f"h{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in (0, 1)]
    return cut(found.select("conv_id", "segment", *heads, "path", "chars", (F.col("segment") == F.col("final")).alias("last")))


def _matrix(lists: pa.Array, width: int, step: int = 1, at: int = 0) -> np.ndarray:
    """Every ``step``-th number of each list, padded."""
    offsets = np.asarray(lists.offsets, np.int64)
    flat = np.asarray(lists.values, np.int64)
    size = np.diff(offsets) // step
    out = np.full((len(lists), width), PAD)
    row = np.repeat(np.arange(len(lists)), size)
    column = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[row, column] = flat[offsets[row] + column * step + at]
    return out


def _shard(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
    conv, segment, h0, h1 = (np.asarray(column[c], np.int64) for c in ("conv_id", "segment", "h0", "h1"))
    last = np.asarray(column["last"].cast(pa.uint8())) > 0
    length = np.diff(np.asarray(column["chars"].offsets, np.int64))
    n, m = len(conv), int(length.max())
    first, second, chars = _matrix(column["path"], m, 2, 0), _matrix(column["path"], m, 2, 1), _matrix(column["chars"], m)
    keys = [conv, ~last, *[x[:, j] for j in range(m - 1, -1, -1) for x in (second, first)], h1, h0, segment]
    order = np.lexsort(keys)
    conv, segment, h0, h1, last, length = (x[order] for x in (conv, segment, h0, h1, last, length))
    first, second, chars = first[order], second[order], chars[order]

    marks = np.zeros((n, m + 1), bool)
    marks[0, 0] = True
    for x in (segment, h0, h1):
        marks[1:, 0] |= x[1:] != x[:-1]
    marks[1:, 1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    marks = np.logical_or.accumulate(marks, axis=1)
    k0, k1 = (np.bitwise_xor.accumulate(np.column_stack([h, np.where(x == PAD, 0, x)]), axis=1) for h, x in ((h0, first), (h1, second)))
    goes_on = (length == width) & ~last

    starts, members, least, is_open = [], [], [], []
    for j in range(m + 1):
        at = np.flatnonzero(marks[:, j])
        end = np.append(at[1:], n)
        starts.append(at)
        members.append(end - at)
        least.append(np.minimum.reduceat(conv, at))
        is_open.append((at == 0) | (end == n) | np.logical_or.reduceat(goes_on, at) | (j == 0))
    leaves, saved, children = (np.zeros(n, np.int64) for _ in range(3))
    for j in range(m, -1, -1):
        at, size, open_ = starts[j], members[j], is_open[j]
        there = length[at] >= j
        n_children = np.add.reduceat(children, at)
        own = (size - 1) * (chars[at, j - 1] if j else 0)
        whole = there & ~open_
        leaves[at[whole]] += n_children[whole] == 0
        saved[at[whole]] += own[whole]
        sums = np.add.reduceat(leaves, at), np.add.reduceat(saved, at)
        children[:] = 0
        children[at[whole]] = 1
        ending = np.add.reduceat((length == j) & last, at)
        again = (j == 0) & (segment[at] > 0)  # these are the ends of the segment before
        ends: list[str | None] = []
        for a, e, o in zip(at[there].tolist(), ending[there].tolist(), open_[there].tolist()):
            text = ",".join(map(str, conv[a : a + e].tolist())) if e else None
            ends.append(text if o else hashlib.sha256(text.encode()).hexdigest() if e else NO_ENDS)
        if j:
            up = np.searchsorted(starts[j - 1], at, "right") - 1
            parent, parent_open, parent_least = starts[j - 1][up], is_open[j - 1][up], least[j - 1][up]
            p0, p1, rooted = k0[parent, j - 1], k1[parent, j - 1], np.zeros(len(at), bool)
        else:
            p0 = p1 = parent_least = np.zeros(len(at), np.int64)
            parent_open, rooted = np.zeros(len(at), bool), np.ones(len(at), bool)

        def numbers(x: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
            return pa.array(x[there].astype(np.int64), pa.int64(), mask=None if null is None else null[there])

        zero = np.zeros(len(at), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                numbers(segment[at] * width + j), numbers(k0[at, j]), numbers(k1[at, j]), pa.array(open_[there]), numbers(least[j], again),
                numbers(np.where(again, 0, size)), numbers(n_children), numbers(np.where(again, 0, sums[0])), numbers(np.where(again, 0, sums[1])),
                numbers(np.where(again, sums[0], 0)), numbers(np.where(again, sums[1], 0)), numbers(chars[at, j - 1] if j else zero, again), numbers(p0, rooted), numbers(p1, rooted),
                pa.array(parent_open[there]), numbers(parent_least, rooted | parent_open), numbers(conv[at], ending == 0), pa.array(ends, pa.string()),
            ],
            names=[x.split()[0] for x in _NODES.split(",")],
        )


def _ordered_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, k0, k1, sha) of rows (depth, k0, k1, ends) in order, one block of ids in memory at a time."""
    node, running = None, None

    def row():
        return pa.RecordBatch.from_pylist([dict(zip(("depth", "k0", "k1", "sha"), (*node, running.hexdigest())))], pa.schema([("depth", pa.int64()), ("k0", pa.int64()), ("k1", pa.int64()), ("sha", pa.string())]))

    for b in batches:
        for depth, k0, k1, ends in zip(*[c.to_pylist() for c in b.columns]):
            if (depth, k0, k1) != node:
                if node is not None:
                    yield row()
                node, running = (depth, k0, k1), hashlib.sha256(ends.encode())
            else:
                running.update(b"," + ends.encode())
    if node is not None:
        yield row()


def _flowed(nodes: DataFrame) -> DataFrame:
    """(node, leaves, saved): sums of the values of (node, parent, leaves, saved) over subtrees, by pointer doubling."""
    state = cut(nodes.select("node", F.col("parent").alias("up"), "leaves", "saved"))
    while not state.where("up is not null").isEmpty():
        risen = state.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        further = state.select(F.col("node").alias("up"), F.col("up").alias("next"))
        joined = state.join(risen, "node", "left").join(further, "up", "left")
        state = cut(
            joined.select(
                "node", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")
            )
        )
    return state.drop("up")


def trie(turns: DataFrame, convs: DataFrame, width: int = WIDTH, shards: int | None = None) -> DataFrame:
    """One row per distinct sequence of first turns of ``turns`` (conv_id, depth from 1, k0, k1, chars).

    Columns: conv_id (the least member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, (members - 1) x chars of the last turn) and ends_sha256 (ids of the members that
    end there, ascending, comma-joined).  ``convs`` has all conversations, also those without turns.  No conversations, no rows.
    """
    attach(turns)
    rows = _segments(turns, convs, width)
    by = [*[F.col(c) for c in ("segment", "h0", "h1", "path")], ~F.col("last"), F.col("conv_id")]  # those that end at a node first
    ranged = (rows.repartitionByRange(*by) if shards is None else rows.repartitionByRange(shards, *by)).sortWithinPartitions(*by)

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield from _shard(b, width)

    found = cut(ranged.mapInArrow(tidy(sharded), _NODES))
    node, up = F.struct("depth", "k0", "k1"), F.when(F.col("p0").isNotNull(), F.struct((F.col("depth") - 1).alias("depth"), F.col("p0").alias("k0"), F.col("p1").alias("k1")))
    sums = ("n_convs", "n_children", "n_leaves", "saved", "more_leaves", "more_saved")
    border = found.where("open").groupBy("depth", "k0", "k1").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums], F.max("chars").alias("chars"), F.max("p0").alias("p0"), F.max("p1").alias("p1")
    )
    border = cut(border.select(node.alias("node"), up.alias("parent"), "conv_id", *sums, "chars"))
    inner = border.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("open_children"))
    border = border.join(inner, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)))
    own = F.when(F.col("parent").isNull(), 0).otherwise((F.col("n_convs") - 1) * F.col("chars"))
    border = cut(
        border.withColumns({"leaves": F.when(F.col("n_children") == 0, 1).otherwise(0) + F.col("more_leaves"), "own_saved": own + F.col("more_saved")})
    )
    flowed = _flowed(border.select("node", "parent", "leaves", F.col("own_saved").alias("saved"))).select("node", F.col("leaves").alias("l"), F.col("saved").alias("s"))
    blocks = found.where("open and ends is not null").select("depth", "k0", "k1", "first_end", "ends")
    digests = blocks.repartition("depth", "k0", "k1").sortWithinPartitions("depth", "k0", "k1", "first_end").drop("first_end")
    digests = digests.mapInArrow(_ordered_digests, "depth long, k0 long, k1 long, sha string").select(node.alias("node"), "sha")
    parents = border.select(F.col("node").alias("parent"), F.col("conv_id").alias("of_parent"))
    opened = border.join(flowed, "node").join(digests, "node", "left").join(parents, "parent", "left").select(
        "conv_id", F.col("node.depth").alias("depth"), F.col("of_parent").alias("parent_conv_id"), "n_convs", "n_children", (F.col("n_leaves") + F.col("l")).alias("n_leaves"),
        (F.col("saved") + F.col("s")).alias("saved_tokens"), F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    whole = found.where("not open").withColumn("parent", F.when(F.col("parent_open"), up)).join(parents, "parent", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "of_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
    return opened.unionByName(whole)
