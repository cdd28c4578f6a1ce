"""Checkpoints, id filters and connected components for the operators of this package."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.sources.sinks import checkpoint_folder

MAX_FILTER_BITS = 1 << 27  # 16 MB: the most that an id filter broadcasts


_shipped: set[str] = set()


def attach(df: DataFrame) -> SparkSession:
    """The session of ``df``, whose Python workers can import this package from now on."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="pathweave-"), "pathweave.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for at, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), os.path.dirname(package)))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    return spark


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediate data: spark.checkpoint.dir; where that is unset one of our own in local mode, else an error."""
    return checkpoint_folder(spark)


def new_path(spark: SparkSession, kind: str) -> str:
    return os.path.join(folder(spark), f"{kind}-{uuid.uuid4().hex}")


def release() -> None:
    """Give memory that is not used any more back to the system: workers wait for the next task with little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A function for mapInArrow that ends with ``release``."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` and go on from its copy in the shared folder, which outlives the executors."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _bit(h: np.ndarray, bits: int) -> np.ndarray:
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)


class IdFilter:
    """Which ids may be in ``ids`` (a long column): a bitmap of at most 16 MB, whatever the number of ids.

    Never false for an id that is there; sometimes true for another, so an exact step has to follow.
    """

    SEGMENT = 1 << 15

    def __init__(self, ids: DataFrame, column: str):
        spark = ids.sparkSession
        n = ids.count()
        bits = 1 << min(max(16, int(np.ceil(np.log2(max(n, 1) * 16)))), MAX_FILTER_BITS.bit_length() - 1)
        segment = self.SEGMENT

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(bits, bool)
            for b in batches:
                found[_bit(np.asarray(b.column(0)), bits)] = True
            rows = found.reshape(-1, segment)
            at = np.flatnonzero(rows.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array([np.packbits(rows[i]).tobytes() for i in at], pa.binary())], names=["at", "bits"]
            )

        def merge(table: pa.Table) -> pa.Table:
            both = np.zeros(segment // 8, np.uint8)
            for x in table.column("bits"):
                both |= np.frombuffer(x.as_py(), np.uint8)
            return pa.table({"at": table.column("at")[:1], "bits": pa.array([both.tobytes()], pa.binary())})

        parts = ids.select(F.col(column).cast("long")).mapInArrow(fill, "at long, bits binary").groupBy("at").applyInArrow(merge, "at long, bits binary")
        packed = np.zeros(bits // 8, np.uint8)
        for at, part in parts.collect():
            packed[at * segment // 8 : (at + 1) * segment // 8] = np.frombuffer(bytes(part), np.uint8)
        self.bits = bits
        self.shared = spark.sparkContext.broadcast(packed.tobytes())

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        at = _bit(ids, self.bits)
        packed = np.frombuffer(self.shared.value, np.uint8)
        return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b): root is the component's smallest node.

    Alternating large-star and small-star steps.  Each is a minimum per node (combined before the
    shuffle) joined back to the edges, so a node with very many neighbours is never one group in one
    task.  The loop ends when a pass changes nothing; the number of passes is logarithmic.
    """
    e = cut(
        edges.where("a <> b and a is not null and b is not null")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select("a", F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = cut(small.distinct())
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
