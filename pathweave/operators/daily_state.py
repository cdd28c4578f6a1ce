"""Running day tables kept as one summary per day of outcomes.

All outcomes of a day, with the touches linked to them, come down to a few rows per group and lag: how many touches lie there, and how
many outcomes have their closest touch of the group there.  Summaries of different days add up.  So a new day is summarised alone, a
day that is worked out again replaces its summary, and the curves over any range of days are sums over small tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import write_partitioned
from .paths import OUTCOME

EVERY = "all groups"


def day_summary(
    matches: DataFrame, days: DataFrame, day: str, group: str, lag: str = "day_diff", outcome: Sequence[str] = OUTCOME
) -> DataFrame:
    """(day, level, group, day_diff, cnt, no_txns) of the outcomes of ``days`` (its column ``day``).

    ``level`` is ``group`` for the rows of a group and ``EVERY`` for those over all.  A day has a row even if nothing was linked, so
    that it replaces what was known of it.
    """
    rows = matches.join(days.select(day).distinct(), day, "left_semi")
    per_lag = rows.groupBy(day, *outcome, group, F.col(lag).alias("day_diff")).agg(F.count(F.lit(1)).alias("n"))
    per_group = per_lag.groupBy(day, *outcome, group).agg(F.min("day_diff").alias("day_diff"))
    per_outcome = per_group.groupBy(day, *outcome).agg(F.min("day_diff").alias("day_diff"))
    none, zero = F.lit(None).cast(matches.schema[group].dataType).alias(group), F.lit(0).cast("bigint")

    def part(df: DataFrame, level: str, named, cnt, no_txns) -> DataFrame:
        return df.select(day, F.lit(level).alias("level"), named, "day_diff", cnt.alias("cnt"), no_txns.alias("no_txns"))

    one = F.lit(1).cast("bigint")
    together = (
        part(per_lag, group, F.col(group), F.col("n"), zero)
        .union(part(per_lag, EVERY, none, F.col("n"), zero))
        .union(part(per_group, group, F.col(group), zero, one))
        .union(part(per_outcome, EVERY, none, zero, one))
        .union(part(days.select(day).distinct().withColumn("day_diff", F.lit(0)), EVERY, none, zero, zero))
    )
    return together.groupBy(day, "level", group, "day_diff").agg(F.sum("cnt").alias("cnt"), F.sum("no_txns").alias("no_txns"))


def replace_days(summary: DataFrame, path: str, day: str) -> None:
    """Put summaries in place of those that the folder has of the same days."""
    write_partitioned(summary, path, [day])


def totals(spark: SparkSession, path: str, day: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(level, group, day_diff, cnt, no_txns) over the days from ``start`` to ``end``; only their directories are read."""
    rows = spark.read.parquet(path)
    group = next(c for c in rows.columns if c not in (day, "level", "day_diff", "cnt", "no_txns"))
    if start is not None:
        rows = rows.where(F.col(day) >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col(day) <= F.lit(end).cast("date"))
    summed = rows.groupBy("level", group, "day_diff").agg(F.sum("cnt").alias("cnt"), F.sum("no_txns").alias("no_txns"))
    return summed.where((F.col("cnt") > 0) | (F.col("no_txns") > 0))


def lag_counts(total: DataFrame, group: str) -> DataFrame:
    """Touches per group and lag, as ``curves.lag_counts`` counts them on the matches."""
    return total.where(F.col("level") == group).where("cnt > 0").select(group, "day_diff", "cnt")


def cumulative_outcomes(total: DataFrame, group: str | None = None) -> DataFrame:
    """As ``curves.cumulative_outcomes``, per group or over all."""
    by = [] if group is None else [group]
    rows = total.where(F.col("level") == (EVERY if group is None else group)).where("no_txns > 0").select(*by, "day_diff", "no_txns")
    upto = W.partitionBy(*by).orderBy("day_diff").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("cumm_txns", F.sum("no_txns").over(upto))
    return rows.withColumn("pct_of_last", F.col("cumm_txns") / F.max("cumm_txns").over(W.partitionBy(*by)) * 100.0)


def average_clicks(total: DataFrame, windows: Mapping[str, int], group: str) -> DataFrame:
    """As ``curves.average_clicks``: touches up to a lag over outcomes reached up to it."""
    rows = total.where(F.col("level") == group)

    def upto(column: str, days: int):
        return F.sum(F.when(F.col("day_diff") <= days, F.col(column)))

    return rows.groupBy(group).agg(*[F.try_divide(upto("cnt", days), upto("no_txns", days)).alias(name) for name, days in windows.items()])
