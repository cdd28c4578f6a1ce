"""Paths: the touches linked to one outcome, in time order."""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.sinks import stage
from . import ordered
from .path_counts import pairs_of_paths, summaries_of_slices
from .skew import HOT_ROWS, skew_join

OUTCOME = ("transaction_id", "item_id")
# more touches than this are not gathered for one path
LONG_PATH = 100_000


def path_touches(
    matches: DataFrame,
    outcome: Sequence[str] = OUTCOME,
    event: str = "event_id",
    ts: str = "event_ts",
    channel: str = "channel_name",
    unassigned: str | None = "Unassigned",
) -> DataFrame:
    """One row per (outcome, event, channel), at its first time.

    The grouping is on the touch, not the outcome, so copies collapse before
    the shuffle and one long path is spread over all tasks.
    """
    name = F.col(channel) if unassigned is None else F.coalesce(channel, F.lit(unassigned))
    return matches.groupBy(
        *outcome, F.col(event).alias("event_id"), name.alias("channel_name")
    ).agg(F.min(ts).alias("event_ts"))


def path_lengths(touches: DataFrame, outcome: Sequence[str] = OUTCOME, event: str = "event_id") -> DataFrame:
    """``path_length`` (distinct events) of each outcome; sums in two steps, so no path is gathered."""
    return touches.select(*outcome, event).distinct().groupBy(*outcome).agg(F.count(F.lit(1)).alias("path_length"))


def with_lengths(
    touches: DataFrame,
    max_length: int | None = None,
    outcome: Sequence[str] = OUTCOME,
    event: str = "event_id",
    long_path: int = LONG_PATH,
) -> DataFrame:
    """Touches with the ``path_length`` of their outcome; with ``max_length`` only those of outcomes up to it.

    Touches are staged and shuffled by outcome, those of outcomes with more than ``long_path`` of them by event too.
    Those without an outcome have no length.
    """
    if max_length is not None:
        return short_paths(touches, max_length, outcome, event)
    short, long = staged_by_length(touches, outcome, long_path)
    known = reduce(and_, [F.col(c).isNotNull() for c in outcome])
    found = gathered_lengths(short.where(known), outcome, event).unionByName(
        short.where(~known).withColumn("path_length", F.lit(None).cast("bigint"))
    )
    return found if long is None else found.unionByName(joined_lengths(long, outcome, event))


def staged_by_length(
    touches: DataFrame, outcome: Sequence[str] = OUTCOME, long_path: int = LONG_PATH
) -> tuple[DataFrame, DataFrame | None]:
    """Staged touches: those of outcomes with at most ``long_path`` of them, and the others if there are any."""
    rows = stage(touches)
    long = stage(ordered.long_groups(rows, outcome, long_path).select(*outcome))
    if long.isEmpty():
        return rows, None
    return tuple(rows.join(long, list(outcome), how).select(*rows.columns) for how in ("left_anti", "left_semi"))


def gathered_lengths(touches: DataFrame, outcome: Sequence[str] = OUTCOME, event: str = "event_id") -> DataFrame:
    """``path_length`` by windows over each outcome, null where the outcome is."""
    by_outcome = W.partitionBy(*outcome)
    known = reduce(and_, [F.col(c).isNotNull() for c in outcome])
    return (
        touches.withColumn("_nth", F.dense_rank().over(by_outcome.orderBy(event)))
        .withColumn("path_length", F.when(known, F.max("_nth").over(by_outcome).cast("bigint")))
        .drop("_nth")
    )


def joined_lengths(touches: DataFrame, outcome: Sequence[str] = OUTCOME, event: str = "event_id") -> DataFrame:
    """``path_length`` by a join with the number of events of each outcome, whose touches are spread by event."""
    lengths = path_lengths(touches, outcome, event).withColumnsRenamed({c: f"_{c}" for c in outcome})
    joined = skew_join(touches, lengths, [(c, f"_{c}") for c in outcome], how="left", spread_by=[event])
    return joined.select(*touches.columns, "path_length")


def short_paths(
    touches: DataFrame, max_length: int, outcome: Sequence[str] = OUTCOME, event: str = "event_id"
) -> DataFrame:
    """Touches of outcomes with at most ``max_length`` events, with their ``path_length``.

    The length limit is part of the analysis (60, 100 or 1000).  Events are
    ranked only up to one past the limit, which is enough to tell that a path is
    too long; Spark applies that bound inside every task before the shuffle (see
    ``plans.session``), so an endless path never reaches a single task whole.
    """
    by_outcome = W.partitionBy(*outcome)
    return (
        touches.withColumn("_nth", F.dense_rank().over(by_outcome.orderBy(event)))
        .where(F.col("_nth") <= max_length + 1)
        .withColumn("path_length", F.max("_nth").over(by_outcome).cast("bigint"))
        .where(F.col("path_length") <= max_length)
        .drop("_nth")
    )


def build_paths(
    touches: DataFrame,
    max_length: int,
    outcome: Sequence[str] = OUTCOME,
    extra: Sequence[str] = (),
) -> DataFrame:
    """One row per outcome: ``path_length`` and its touches sorted by (event_ts, event_id)."""
    step = F.struct("event_ts", "event_id", "channel_name", *extra)
    return (
        short_paths(touches, max_length, outcome)
        .groupBy(*outcome, "path_length")
        .agg(F.sort_array(F.collect_list(step)).alias("touches"))
    )


def unordered_pairs(
    touches: DataFrame, max_length: int | None = None, outcome: Sequence[str] = OUTCOME
) -> DataFrame:
    """Channel pairs (names sorted) over all pairs of touches, per path length.

    Worked out from how often each channel occurs in a path: ``n1 * n2`` for
    two channels and ``n (n - 1) / 2`` for one, so touches are never paired.
    Paths of any length count; ``max_length`` leaves longer ones out.  The touches are read once: a path's length is the
    number of those that come first in their event.
    """
    place = F.row_number().over(W.partitionBy(*outcome, "event_id").orderBy("channel_name"))
    marked = touches.select(*outcome, "channel_name", (place == 1).alias("_first"))
    counts = marked.groupBy(*outcome, "channel_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("_first").alias("_events"))
    histograms = counts.groupBy(*outcome).agg(
        F.sort_array(F.collect_list(F.struct("channel_name", "n"))).alias("h"), F.sum("_events").alias("path_length")
    )
    if max_length is not None:
        histograms = histograms.where(F.col("path_length") <= max_length)

    def with_itself_and_later(one: Column, i: Column) -> Column:
        return F.transform(
            F.slice("h", i + 1, F.size("h")),
            lambda two: F.struct(
                one["channel_name"].alias("channel_1"),
                two["channel_name"].alias("channel_2"),
                F.when(one["channel_name"] == two["channel_name"], F.shiftright(one["n"] * (one["n"] - 1), 1))
                .otherwise(one["n"] * two["n"])
                .alias("n"),
            ),
        )

    return _sum_pairs(
        histograms.select("path_length", F.inline(F.flatten(F.transform("h", with_itself_and_later))))
    )


def ordered_pairs(
    touches: DataFrame,
    max_length: int | None = None,
    outcome: Sequence[str] = OUTCOME,
    long_path: int = LONG_PATH,
    number: int | None = None,
) -> DataFrame:
    """Pairs (earlier channel, later channel) over all pairs of touches, per path length.

    Needs a running count per channel along each path, which array functions can only do one pair of channels at a time; so tasks
    count with numpy, and only sums per (path length, pair) are shuffled.  Paths of up to ``long_path`` touches are
    gathered.  Longer ones lie in ``number`` ordered slices (see ``ordered``) as long as their rows
    ask for: a slice gives a summary of its part of a path, and summaries are merged along the slices.
    ``max_length`` leaves longer paths out.
    """
    schema = "path_length bigint, channel_1 string, channel_2 string, n bigint"
    step = F.struct("event_ts", "event_id", "channel_name")

    def gathered(rows: DataFrame) -> DataFrame:
        paths = rows.groupBy(*outcome).agg(F.sort_array(F.collect_list(step)).alias("t"))
        events = F.size(F.array_distinct("t.event_id")).cast("bigint")
        return paths.select(events.alias("path_length"), F.col("t.channel_name").alias("path")).mapInArrow(pairs_of_paths, schema)

    if max_length is not None:
        return _sum_pairs(gathered(short_paths(touches, max_length, outcome)))
    rows = stage(touches.select(*outcome, "event_ts", "event_id", "channel_name"))
    long = ordered.long_groups(rows, outcome, long_path)
    if long.isEmpty():
        return _sum_pairs(gathered(rows))
    inside, across = _long_pairs(rows.join(long, list(outcome), "left_semi"), outcome, number)
    return _sum_pairs(gathered(rows.join(long, list(outcome), "left_anti")).unionByName(inside).unionByName(across))


def _long_pairs(rows: DataFrame, outcome: Sequence[str], number: int | None) -> tuple[DataFrame, DataFrame]:
    """Pairs inside the slices of long paths, and across them."""
    lengths = path_lengths(rows, outcome)
    by = [F.col(c) for c in (*outcome, "event_ts", "event_id", "channel_name")]
    rows = rows.join(lengths, list(outcome))
    ranged = rows.repartitionByRange(*by) if number is None else rows.repartitionByRange(number, *by)
    named = T.StructType([*rows.select(*outcome, "path_length").schema.fields]).add(ordered.SLICE, T.IntegerType()).add("channel_1", T.StringType()).add("channel_2", T.StringType()).add("n", T.LongType())
    summarise = summaries_of_slices(len(outcome), to_arrow_schema(named))
    found = stage(ranged.sortWithinPartitions(*by).select(*outcome, "path_length", "channel_name").mapInArrow(summarise, named))
    counts = found.where("channel_2 is null").drop("channel_2")
    # each channel of a path at each slice after its first, with how often it occurred before that slice
    at = counts.groupBy(*outcome).agg(F.collect_set(ordered.SLICE).alias("_at")).where(F.size("_at") > 1)
    each = counts.groupBy(*outcome, "channel_1").agg(F.min(ordered.SLICE).alias("_first")).join(at, list(outcome))
    each = each.select(*outcome, "channel_1", F.explode(F.filter("_at", lambda s: s >= F.col("_first"))).alias(ordered.SLICE))
    earlier = F.sum("n").over(W.partitionBy(*outcome, "channel_1").orderBy(ordered.SLICE).rowsBetween(W.unboundedPreceding, -1))
    before = each.join(counts.drop("path_length"), [*outcome, ordered.SLICE, "channel_1"], "left").withColumn("_before", earlier).where("_before > 0").drop("n")
    later = counts.withColumnRenamed("channel_1", "channel_2")
    across = before.join(later, [*outcome, ordered.SLICE]).select("path_length", "channel_1", "channel_2", (F.col("_before") * F.col("n")).alias("n"))
    return found.where("channel_2 is not null").select("path_length", "channel_1", "channel_2", "n"), across


def _sum_pairs(pairs: DataFrame) -> DataFrame:
    return (
        pairs.where(F.col("n") > 0)
        .groupBy("path_length", "channel_1", "channel_2")
        .agg(F.sum("n").alias("n"))
    )


def serialise_pairs(pairs: DataFrame) -> DataFrame:
    """Pair counts of a path length as ``(c1,c2) -> n;...``, sorted by pair."""
    cell = F.struct(
        "channel_1",
        "channel_2",
        F.format_string("(%s,%s) -> %d", "channel_1", "channel_2", "n").alias("text"),
    )
    return pairs.groupBy("path_length").agg(
        F.array_join(F.sort_array(F.collect_list(cell))["text"], ";").alias("coocurence_pairs")
    )


def parse_pairs(texts: DataFrame, text: str = "coocurence_pairs") -> DataFrame:
    """The reverse of :func:`serialise_pairs` (channel names hold no comma)."""
    cell = r"^\((.*?),(.*)\) -> (\d+)$"
    return texts.select("path_length", F.explode(F.split(text, ";")).alias("cell")).select(
        "path_length",
        F.regexp_extract("cell", cell, 1).alias("channel_1"),
        F.regexp_extract("cell", cell, 2).alias("channel_2"),
        F.regexp_extract("cell", cell, 3).cast("bigint").alias("n"),
    )


def pair_asymmetry(pairs: DataFrame, path_length: int | None = None) -> DataFrame:
    """Every channel x channel cell: count, count minus reverse count, sign and relative size.

    ``pairs`` is already one row per channel pair, so this works on a table the
    size of the channel list squared.
    """
    if path_length is not None:
        pairs = pairs.where(F.col("path_length") == path_length)
    n = pairs.groupBy("channel_1", "channel_2").agg(F.sum("n").alias("n"))
    names = n.select("channel_1").union(n.select("channel_2")).agg(F.collect_set("channel_1").alias("names"))
    square = names.select(F.explode("names").alias("channel_1"), "names").select(
        "channel_1", F.explode("names").alias("channel_2")
    )
    back = n.select(
        F.col("channel_2").alias("channel_1"), F.col("channel_1").alias("channel_2"), F.col("n").alias("n_back")
    )
    cells = (
        square.join(n, ["channel_1", "channel_2"], "left")
        .join(back, ["channel_1", "channel_2"], "left")
        .na.fill(0, ["n", "n_back"])
    )
    difference = F.col("n") - F.col("n_back")
    return cells.select(
        "channel_1",
        "channel_2",
        F.col("n").alias("occurence"),
        difference.alias("difference"),
        F.signum(difference).cast("int").alias("comparison"),
        (difference / F.greatest(F.col("n") + F.col("n_back"), F.lit(1))).alias("relative_difference"),
    )


def exact_device_outcomes(
    matches: DataFrame,
    device: str = "device_type_level1",
    wanted: str = "Mobile",
    outcome: Sequence[str] = OUTCOME,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """All rows of outcomes whose known touch devices are exactly ``wanted``.

    A touch with no device does not count against it.  What is staged of the outcomes is which ones those are, and which
    ones are hot; without hot ones the plain join lets Spark keep to the wanted outcomes before ``matches`` are made.
    """
    rows = matches.groupBy(*outcome).agg(
        F.count(device).alias("_known"), F.count_if(F.col(device) == wanted).alias("_wanted"), F.count(F.lit(1)).alias("_rows")
    )
    rows = rows.withColumn("_only", (F.col("_wanted") > 0) & (F.col("_wanted") == F.col("_known")))
    found = stage(rows.where(F.col("_only") | (F.col("_rows") > min_rows)).select(*outcome, "_only", "_rows"))
    only = found.where("_only").select(*outcome)
    if found.where(F.col("_rows") > min_rows).isEmpty():
        return matches.join(only, list(outcome), "left_semi").select(*matches.columns)
    return skew_join(matches, only, [(c, c) for c in outcome], how="left_semi", counted=found, min_rows=min_rows)
