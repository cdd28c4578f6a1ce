"""Ordered scans of groups of any size.

A window over a group gathers it in one task.  Here rows are dealt in slices, which are consecutive ranges of
(group, order), so a large group lies in many; whatever depends on the order is worked out inside the
slices, and one small row per group and slice carries what lies across their borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import stage

SLICE = "_slice"


def slices(df: DataFrame, group: Sequence[str], order: Sequence[str], number: int | None = None) -> DataFrame:
    """``df`` with the slice of each row, staged; sizes of slices depend on the number of rows only.

    ``order`` should tell all rows of a group apart: rows that are equal in it lie in one slice.  Without ``number``
    there are as many as the session's shuffles have partitions, fewer where the data are small.
    """
    by = [F.col(c) for c in (*group, *order)]
    ranged = df.repartitionByRange(*by) if number is None else df.repartitionByRange(number, *by)
    return stage(ranged.withColumn(SLICE, F.spark_partition_id()))


def borders(sliced: DataFrame, group: Sequence[str], **columns) -> DataFrame:
    """One row per group and slice: ``_rows`` and the aggregates ``columns``, and ``_earlier`` and ``_later``,
    the group's rows in other slices."""
    counts = sliced.groupBy(SLICE, *group).agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(name) for name, c in columns.items()])
    whole = W.partitionBy(*group)
    earlier = F.coalesce(F.sum("_rows").over(whole.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("_earlier", earlier).withColumn("_later", F.sum("_rows").over(whole) - F.col("_rows") - F.col("_earlier"))


def long_groups(df: DataFrame, group: Sequence[str], more_than: int) -> DataFrame:
    """``group`` and ``_rows`` of the groups with more than so many rows: at most one for every ``more_than`` rows."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > more_than)


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, number: int | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... along ``order`` in each group, groups of any size."""
    sliced = slices(df, group, order, number)
    local = F.row_number().over(W.partitionBy(SLICE, *group).orderBy(*order))
    across = borders(sliced, group).where("_earlier > 0").select(SLICE, *group, "_earlier")
    rows = sliced.withColumn(name, local).join(across, [SLICE, *group], "left")
    return rows.select(*df.columns, (F.col(name) + F.coalesce("_earlier", F.lit(0))).alias(name))
