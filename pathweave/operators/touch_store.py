"""Touches stored the way look-backs join them.

A daily look-back joins one day's anchors to weeks of touches, and the next day's to nearly the same weeks.  The store lists
each touch once per usable key when its day arrives, in files that are partitioned by day and bucketed by (key rank, key).  A look-back then
reads the days of its window where they lie and shuffles only the anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import skew
from .lookback import Key, Side, Window, by_key, strongest

BUCKETED_BY = ("_rank", "_key", "_part")


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class TouchStore:
    """A folder of touches, one partition a day, bucketed by what they are joined on.

    Writing a day again replaces it.  A key that owns more than ``min_rows`` rows of a write is dealt over several parts, so that a bucket
    stays small; which keys these are is kept beside the rows, at most ``skew.MAX_HOT`` for a write.
    ``buckets`` has to be the same whenever a folder is opened, and should be at least the session's number of shuffle
    partitions: with fewer buckets Spark may prefer to shuffle.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[Key], touch: Side, buckets: int | None = None, min_rows: int = skew.HOT_ROWS):
        self.spark, self.path, self.keys, self.touch, self.min_rows = spark, path.rstrip("/"), tuple(keys), touch, min_rows
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.hot_path = f"{self.path}-hot"
        self.name = "touches_" + hashlib.md5(self.path.encode()).hexdigest()[:16]

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _attach(self, df: DataFrame | None = None) -> None:
        """Name the folder as a table of this session."""
        if self.spark.catalog.tableExists(self.name):
            return
        rows = df if df is not None else self.spark.read.parquet(self.path)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        self.spark.sql(
            f"CREATE TABLE {self.name} ({columns}) USING parquet PARTITIONED BY (`{self.touch.dt}`)"
            f" CLUSTERED BY ({', '.join(BUCKETED_BY)}) SORTED BY (_rank, _key) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        if self._exists(self.path):
            self.spark.catalog.recoverPartitions(self.name)

    def write(self, touches: DataFrame) -> None:
        """Add the days of ``touches``, in place of what the store has of them."""
        listed = by_key(touches, [(i, k.touch, k.kind) for i, k in enumerate(self.keys)], "_rank", "_key")
        hot = skew.hot_keys(listed.select("_rank", "_key"), ["_rank", "_key"], min_rows=self.min_rows)
        hot.write.mode("append").parquet(self.hot_path)  # parts only ever make copies of anchors, so old ones may stay
        part = F.coalesce(F.pmod(F.xxhash64(*self.touch.ids), F.col("_parts")), F.lit(0)).cast("int")
        rows = listed.join(F.broadcast(hot), ["_rank", "_key"], "left").withColumn("_part", part).drop("_parts")
        columns = [c for c in rows.columns if c != self.touch.dt] + [self.touch.dt]
        rows = rows.select(*columns)
        self._attach(rows)
        with _setting(self.spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            # one task a bucket, so a day has one file a bucket
            rows.repartition(self.buckets, *BUCKETED_BY).write.insertInto(self.name, overwrite=True)

    def touches(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Stored rows of some days, one per usable key of a touch."""
        self._attach()
        rows = self.spark.table(self.name)
        if start is not None:
            rows = rows.where(F.col(self.touch.dt) >= F.lit(start).cast("date"))
        return rows if end is None else rows.where(F.col(self.touch.dt) <= F.lit(end).cast("date"))

    def matches(self, anchors: DataFrame, window: Window, anchor: Side, start: str | None = None, end: str | None = None) -> DataFrame:
        """All (touch, anchor, key rank) in the window; anchors are those of ``start`` to ``end``, and so only days they can reach are read."""
        if start is not None:
            anchors = anchors.where(F.col(anchor.dt) >= F.lit(start).cast("date"))
        if end is not None:
            anchors = anchors.where(F.col(anchor.dt) <= F.lit(end).cast("date"))
        first = None if start is None else self.spark.range(1).select((F.lit(start).cast("date") - window.date_gap).cast("string")).first()[0]
        b = by_key(anchors, [(i, k.anchor, k.kind) for i, k in enumerate(self.keys)], "_arank", "_akey").withColumn("_apart", F.lit(0))
        if self._exists(self.hot_path):
            hot = self.spark.read.parquet(self.hot_path).groupBy("_rank", "_key").agg(F.max("_parts").alias("_parts"))
            b = b.drop("_apart").join(hot.withColumnsRenamed({"_rank": "_arank", "_key": "_akey"}), ["_arank", "_akey"], "left")
            b = b.withColumn("_apart", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        a = self.touches(first, end)
        fits = window.accepts(*[F.col(c) for c in (self.touch.ts, self.touch.dt, anchor.ts, anchor.dt)])
        on = (F.col("_rank") == F.col("_arank")) & (F.col("_key") == F.col("_akey")) & (F.col("_part") == F.col("_apart"))
        return a.join(b, on & fits).drop("_part", "_apart")

    def link(
        self, anchors: DataFrame, window: Window, anchor: Side, start: str | None = None, end: str | None = None, tie_break: Sequence[Column] = ()
    ) -> DataFrame:
        """What ``lookback.link`` gives for the stored touches: one row per (touch, anchor), by its strongest key."""
        return strongest(self.matches(anchors, window, anchor, start, end), self.keys, self.touch, anchor, tie_break)
