"""Neighbours and steps of the touches of an outcome."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import stage
from . import ordered
from .paths import LONG_PATH, OUTCOME, gathered_lengths, joined_lengths, short_paths, staged_by_length


def _local(touches: DataFrame, within: Sequence[str], ts: str, tie_break: str) -> DataFrame:
    group = W.partitionBy(*within)
    by_time = group.orderBy(ts, tie_break)
    so_far = group.orderBy(ts).rangeBetween(W.unboundedPreceding, W.currentRow)
    # one sort serves all: the order by time alone is a prefix, and the rank from the end follows from a running count
    return (
        touches.withColumns({"previous": F.lag("_row").over(by_time), "next": F.lead("_row").over(by_time)})
        .withColumns({"forward_step": F.rank().over(group.orderBy(ts)).cast("bigint"), "_so_far": F.count(F.lit(1)).over(so_far)})
        .withColumn("backward_step", F.count(F.lit(1)).over(group) - F.col("_so_far") + 1)
        .drop("_so_far")
    )


def with_neighbours(
    touches: DataFrame,
    current: Sequence[str],
    outcome: Sequence[str] = OUTCOME,
    ts: str = "event_ts",
    tie_break: str = "event_id",
    long_path: int | None = LONG_PATH,
    number: int | None = None,
) -> DataFrame:
    """Add ``previous``, ``next``, ``forward_step`` and ``backward_step`` to each touch.

    ``previous`` and ``next`` are structs of the ``current`` columns; steps are
    ranks by time from the start and from the end, equal times sharing a step.

    Touches are staged and counted by outcome.  Paths of up to ``long_path`` touches are windows over the outcome.  Longer ones, whatever
    their shape in time, lie in ordered slices of like size (``number``, or as many as the session's shuffles have partitions), and one
    row per outcome and slice carries what lies across the borders.  For paths known to be short ``long_path=None`` does without.
    """
    if long_path is None:
        return _local(touches.withColumn("_row", F.struct(*current)), outcome, ts, tie_break).drop("_row")
    rows = stage(touches)
    long = ordered.long_groups(rows, outcome, long_path)
    if long.isEmpty():
        return with_neighbours(rows, current, outcome, ts, tie_break, None)
    short = with_neighbours(rows.join(long, list(outcome), "left_anti"), current, outcome, ts, tie_break, None)
    return short.unionByName(_over_slices(rows.join(long, list(outcome), "left_semi"), current, outcome, ts, tie_break, number).select(*short.columns))


def _over_slices(
    touches: DataFrame, current: Sequence[str], outcome: Sequence[str], ts: str, tie_break: str, number: int | None
) -> DataFrame:
    cut = ordered.slices(touches, outcome, [ts, tie_break], number).withColumn("_row", F.struct(*current))
    key = [ordered.SLICE, *outcome]
    order = F.struct(ts, tie_break)
    borders = ordered.borders(
        cut, outcome, _first=F.min_by("_row", order), _last=F.max_by("_row", order), _from=F.min(ts), _to=F.max(ts)
    )
    along = W.partitionBy(*outcome).orderBy(ordered.SLICE)
    borders = borders.withColumns({"_before": F.lag("_last").over(along), "_after": F.lead("_first").over(along)})
    # touches of one time may lie in several slices: how many of a slice's first time come before it, of its last time after it
    ends = borders.select(*key, F.explode(F.array_distinct(F.array("_from", "_to"))).alias(ts))
    tied = cut.join(ends, [*key, ts], "left_semi").groupBy(*key, ts).agg(F.count(F.lit(1)).alias("_n"))
    same = W.partitionBy(*outcome, ts).orderBy(ordered.SLICE)
    tied = tied.select(
        *key,
        F.col(ts).alias("_ts"),
        F.coalesce(F.sum("_n").over(same.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_n_before"),
        F.coalesce(F.sum("_n").over(same.rowsBetween(1, W.unboundedFollowing)), F.lit(0)).alias("_n_after"),
    )
    for side, end in (("_n_before", "_from"), ("_n_after", "_to")):
        borders = borders.join(tied.select(*key, F.col("_ts").alias(end), F.col(side)), [*key, end])
    forward = F.col("forward_step") + F.col("_earlier") - F.when(F.col(ts) == F.col("_from"), F.col("_n_before")).otherwise(0)
    backward = F.col("backward_step") + F.col("_later") - F.when(F.col(ts) == F.col("_to"), F.col("_n_after")).otherwise(0)
    found = _local(cut, key, ts, tie_break).join(borders.drop("_rows", "_first", "_last"), key)
    return found.select(
        *touches.columns,
        F.coalesce("previous", "_before").alias("previous"),
        F.coalesce("next", "_after").alias("next"),
        forward.alias("forward_step"),
        backward.alias("backward_step"),
    )


def weighted_edges(
    steps: DataFrame, transaction: Sequence[str], current: Sequence[str], step: str = "backward_step"
) -> DataFrame:
    """How often ``current`` was followed by ``next`` at a step, per kind of outcome."""
    return steps.groupBy(
        F.struct(*transaction).alias("transaction"),
        F.struct(*current).alias("current"),
        F.col("next"),
        F.col(step).alias("step"),
    ).agg(F.count(F.lit(1)).alias("weight"))


def chrono_steps(
    touches: DataFrame,
    current: Sequence[str],
    outcome: Sequence[str] = OUTCOME,
    attributes: Sequence[str] = (),
    long_path: int = LONG_PATH,
) -> DataFrame:
    """One row per event of each outcome, with both neighbours, its steps and the ``path_length``.

    Events are those of paths of any length, staged once; paths of up to ``long_path`` of them are shuffled once, for
    lengths and neighbours alike, and longer ones never gathered.
    """
    needed = dict.fromkeys([*outcome, *attributes, "event_ts", "event_id", *current])
    short, long = staged_by_length(touches.select(*needed), outcome, long_path)
    steps = with_neighbours(gathered_lengths(short, outcome), current, outcome, long_path=None)
    if long is not None:
        steps = steps.unionByName(_over_slices(joined_lengths(long, outcome), current, outcome, "event_ts", "event_id", None))
    sides = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("previous", "next") for c in current]
    return steps.select(*outcome, *attributes, "path_length", "event_ts", "event_id", *current, *sides, "backward_step", "forward_step")


def chrono_events(
    touches: DataFrame,
    current: Sequence[str],
    max_length: int,
    outcome: Sequence[str] = OUTCOME,
    attributes: Sequence[str] = (),
) -> DataFrame:
    """One row per outcome of at most ``max_length`` events, these in order with both neighbours and steps.

    A list needs a bound; :func:`chrono_steps` has the events of all outcomes.
    """
    steps = with_neighbours(short_paths(touches, max_length, outcome), current, outcome, long_path=None)

    def names(side: str) -> list[Column]:
        return [F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in current]

    event = F.struct(
        "event_ts", "event_id", *current, *names("previous"), "backward_step", *names("next"), "forward_step"
    )
    return (
        steps.groupBy(*outcome, "path_length", *attributes)
        .agg(F.sort_array(F.collect_list(event)).alias("mktng_events"))
    )
