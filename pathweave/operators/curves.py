"""Daily volumes and shares, look-back curves and their normalisations."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .paths import OUTCOME


def volume(df: DataFrame, by: Sequence[str | Column], events: str | None = None, name: str = "no_events") -> DataFrame:
    """Rows per group, or the sum of ``events`` where rows are counts already."""
    return df.groupBy(*by).agg((F.count(F.lit(1)) if events is None else F.sum(events)).alias(name))


def share_of(df: DataFrame, value: str, within: Sequence[str], name: str = "prop", scale: float = 100.0) -> DataFrame:
    """``value`` as a share of its group's total.

    Meant for aggregated rows: ``within`` groups are days or channels.
    """
    return df.withColumn(name, F.col(value) / F.sum(value).over(W.partitionBy(*within)) * scale)


def daily_share(
    df: DataFrame,
    day: str = "event_dt",
    channel: str = "channel_name",
    events: str | None = None,
    drop_missing: bool = False,
) -> DataFrame:
    """Daily share of each channel in percent; ``drop_missing`` ignores touches with no channel."""
    kept = df.where(F.col(channel).isNotNull()) if drop_missing else df
    return share_of(volume(kept, [day, channel], events), "no_events", [day])


def missing_share(df: DataFrame, day: str = "event_dt", channel: str = "channel_id") -> DataFrame:
    """Daily share of touches with no channel; 0 on a day without any."""
    return df.groupBy(day).agg((F.count(F.when(F.col(channel).isNull(), 1)) / F.count(F.lit(1))).alias("prop"))


def share_ratio(
    part: DataFrame, whole: DataFrame, on: Sequence[str], part_share: str, whole_share: str, name: str = "ratio"
) -> DataFrame:
    """Left-join two share tables and divide; null channels match each other."""
    left = part.select(*on, F.col(part_share).alias("_part_share")).alias("p")
    right = whole.select(*on, F.col(whole_share).alias("_whole_share")).alias("w")
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}"))
    return left.join(right, same, "left").select(
        *[F.col(f"p.{c}").alias(c) for c in on],
        F.col("_part_share").alias(part_share),
        F.col("_whole_share").alias(whole_share),
        F.try_divide("_part_share", "_whole_share").alias(name),
    )


def relative_importance(
    linked: DataFrame,
    touches: DataFrame,
    day: str = "event_dt",
    channel: str = "channel_name",
    linked_events: str | None = None,
    touch_events: str | None = None,
) -> DataFrame:
    """Daily channel share among touches tied to the chosen outcomes over its share among all touches."""
    tied = daily_share(linked, day, channel, linked_events).withColumnRenamed("prop", "prop_evts_txns")
    overall = daily_share(touches, day, channel, touch_events).withColumnRenamed("prop", "prop_evts")
    return share_ratio(tied, overall, [day, channel], "prop_evts_txns", "prop_evts")


def lag_counts(matches: DataFrame, by: Sequence[str | Column], lag: Column, name: str = "cnt") -> DataFrame:
    return matches.groupBy(*by, lag.alias("day_diff")).agg(F.count(F.lit(1)).alias(name))


def running(df: DataFrame, value: str, by: Sequence[str], order: str = "day_diff", name: str = "cumm_cnt") -> DataFrame:
    """Running sum over aggregated rows."""
    spec = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(spec))


def lookback_curve(counts: DataFrame, digits: int | None = None, channel: str = "channel_name") -> DataFrame:
    """Per channel, what percentage of its matches lies at each lag, and up to it.

    With ``digits`` the percentages are rounded (half up) before they are
    summed up, as the dashboards do.  A missing channel is called ``isNA``.
    """
    named = counts.withColumn(channel, F.coalesce(channel, F.lit("isNA")))
    shares = share_of(named, "cnt", [channel], "prcnt")
    if digits is not None:
        shares = shares.withColumn("prcnt", F.round("prcnt", digits))
    return running(running(shares, "cnt", [channel]), "prcnt", [channel], name="cumm_prcnt")


def low_volume(
    counts: DataFrame, threshold: int, last: int = 61, fixed: Sequence[str] = (), channel: str = "channel_name"
) -> DataFrame:
    """Channels to leave out: fewer than ``threshold`` matches up to lag ``last``, or named in ``fixed``."""
    upto = counts.groupBy(channel).agg(F.sum(F.when(F.col("day_diff") <= last, F.col("cnt"))).alias("cumm_cnt"))
    return upto.where((F.col("cumm_cnt") < threshold) | F.col(channel).isin(*fixed)).select(channel)


def average_clicks(
    matches: DataFrame,
    windows: Mapping[str, int],
    lag: str = "day_diff",
    by: Sequence[str] = ("channel_name",),
    outcome: Sequence[str] = OUTCOME,
) -> DataFrame:
    """Touches per distinct linked outcome, one column per look-back window in days.

    Counted per (group, outcome) first, so each window is a plain sum and the
    outcomes need no separate distinct count.
    """
    per_outcome = matches.groupBy(*by, *outcome).agg(
        *[F.count(F.when(F.col(lag) <= days, 1)).alias(name) for name, days in windows.items()]
    )
    return per_outcome.groupBy(*by).agg(
        *[
            F.try_divide(F.sum(name), F.count(F.when(F.col(name) > 0, 1))).alias(name)
            for name in windows
        ]
    )


def average_clicks_by(
    matches: DataFrame,
    segment: str,
    segments: Sequence[str],
    by: str = "channel_name",
    outcome: Sequence[str] = OUTCOME,
) -> DataFrame:
    """Touches per distinct linked outcome, one column per value of ``segment`` and ``unknown`` for outcomes with none or another."""
    named = matches.withColumn(segment, F.when(F.col(segment).isin(*segments), F.col(segment)).otherwise("unknown"))
    per_outcome = named.groupBy(by, segment, *outcome).agg(F.count(F.lit(1)).alias("_n"))
    return per_outcome.groupBy(by).pivot(segment, [*segments, "unknown"]).agg(F.avg("_n"))


def first_lags(matches: DataFrame, by: Sequence[str | Column], lag: str, outcome: Sequence[str] = OUTCOME) -> DataFrame:
    """How many outcomes a group first reaches at each lag (its closest touch)."""
    closest = matches.groupBy(*by, *outcome).agg(F.min(lag).alias("day_diff"))
    names = [c for c in closest.columns if c not in (*outcome, "day_diff")]
    return closest.groupBy(*names, "day_diff").agg(F.count(F.lit(1)).alias("no_txns"))


def cumulative_outcomes(
    matches: DataFrame, by: Sequence[str] = (), lag: str = "day_diff", outcome: Sequence[str] = OUTCOME
) -> DataFrame:
    """Outcomes reached within each lag, overall or per group, with the percentage of the last lag."""
    totals = running(first_lags(matches, by, lag, outcome), "no_txns", by, name="cumm_txns")
    last = W.partitionBy(*by)
    return totals.withColumn("pct_of_last", F.col("cumm_txns") / F.max("cumm_txns").over(last) * 100.0)


def fill_lags(counts: DataFrame, by: Sequence[str], value: str, last: int | None = None) -> DataFrame:
    """Give every group a row for every lag from 0 to ``last`` (or the table's last), 0 where it had none.

    Lags above ``last`` stay as they are.
    """
    end = counts.agg(F.max("day_diff")).scalar() if last is None else F.lit(last)
    groups = counts.select(*by).distinct() if by else counts.agg(F.count(F.lit(1)).alias("_all")).where("_all > 0")
    grid = groups.select(*by, F.explode(F.sequence(F.lit(0), end.cast("int"))).alias("day_diff"))
    columns = [*by, "day_diff", value]
    rows = grid.withColumn(value, F.lit(0)).select(*columns).union(counts.withColumn("day_diff", F.col("day_diff").cast("int")).select(*columns))
    return rows.groupBy(*by, "day_diff").agg(F.sum(value).alias(value))


def pct_of_all(by_group: DataFrame, overall: DataFrame) -> DataFrame:
    """A group's cumulated outcomes as a percentage of all outcomes at the same lag."""
    total = overall.select("day_diff", F.col("cumm_txns").alias("_all"))
    return by_group.join(total, "day_diff").withColumn(
        "pct_of_all", F.col("cumm_txns") / F.col("_all") * 100.0
    ).drop("_all")


def baseline_normalised(
    cumulated: DataFrame,
    baseline: int,
    first: int,
    last: int,
    by: Sequence[str] = ("channel_name",),
    value: str = "cumm_txns",
) -> DataFrame:
    """Cumulated counts in percent of the same group's count at lag ``baseline``.

    Groups with no row at the baseline lag are left out.
    """
    base = cumulated.where(F.col("day_diff") == baseline).groupBy(*by).agg(F.sum(value).alias("_base"))
    shown = cumulated.where(F.col("day_diff").between(first, last))
    totals = shown.groupBy(*by, "day_diff").agg(F.sum(value).alias(value))
    return totals.join(base, list(by)).select(
        *by, "day_diff", F.try_divide(F.col(value), F.col("_base")).alias("_r")
    ).select(*by, "day_diff", (F.col("_r") * 100.0).alias("cumm_prcnt"))


def channels_within(
    matches: DataFrame,
    windows: Sequence[int],
    by: Sequence[str],
    lag: str = "day_diff",
    channel: str = "channel_name",
    outcome: Sequence[str] = OUTCOME,
) -> DataFrame:
    """How many paths of a group have ``n_channels`` distinct channels within each window.

    A channel counts for every window its closest touch falls in, so each path
    and channel is looked at once and windows are only added up.
    """
    closest = matches.groupBy(*by, *outcome, channel).agg(F.min(lag).alias("_lag"))
    per_path = closest.groupBy(*by, *outcome).agg(
        F.array(
            *[
                F.struct(F.lit(w).alias("window"), F.count(F.when(F.col("_lag") <= w, F.col(channel))).alias("n_channels"))
                for w in windows
            ]
        ).alias("_windows")
    )
    return (
        per_path.select(*by, F.inline("_windows"))
        .where(F.col("n_channels") > 0)
        .groupBy(*by, "window", "n_channels")
        .agg(F.count(F.lit(1)).alias("n_paths"))
    )


def channel_spread(histogram: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of channels per path with the plotted band (never below 1).

    Works on the histogram of :func:`channels_within` with exact integer sums.
    """
    n, x = F.sum("n_paths"), F.sum(F.col("n_paths") * F.col("n_channels"))
    xx = F.sum(F.col("n_paths") * F.col("n_channels") * F.col("n_channels"))
    stats = histogram.groupBy(*by, "window").agg(n.alias("_n"), x.alias("_x"), xx.alias("_xx"))
    variance = (F.col("_n") * F.col("_xx") - F.col("_x") * F.col("_x")) / (F.col("_n") * (F.col("_n") - 1))
    spread = stats.select(
        *by,
        "window",
        (F.col("_x") / F.col("_n")).alias("mean"),
        F.when(F.col("_n") > 1, F.sqrt(variance)).alias("stddev"),
    )
    return spread.withColumns(
        {"low": F.greatest(F.lit(1.0), F.col("mean") - F.col("stddev")), "high": F.col("mean") + F.col("stddev")}
    )


def channel_fractions(histogram: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fraction of paths with at most ``n_channels`` channels, per group and window."""
    cumulated = running(histogram, "n_paths", [*by, "window"], "n_channels", "_upto")
    total = F.sum("n_paths").over(W.partitionBy(*by, "window"))
    return cumulated.withColumn("cumul_frac", F.col("_upto") / total).drop("_upto")


def dense_grid(
    counts: DataFrame, day: str = "event_dt", channel: str = "channel_name", value: str = "no_events"
) -> DataFrame:
    """Every day x every channel, 0 where nothing happened; ``counts`` is aggregated already."""
    channels = counts.agg(F.collect_set(channel)).scalar()
    grid = counts.select(day).distinct().select(day, F.explode(channels).alias(channel))
    return grid.join(counts, [day, channel], "left").na.fill(0, [value])


def pivot_wide(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, value: str) -> DataFrame:
    """Long to wide, 0 where a cell is empty; what is not among ``values`` is summed in ``other``."""
    named = df.withColumn(column, F.when(F.col(column).isin(*values), F.col(column)).otherwise("other"))
    columns = [*values, "other"]
    wide = named.groupBy(*rows).pivot(column, columns).agg(F.sum(value))
    return wide.na.fill(0, [str(c) for c in columns])


def unpivot_long(df: DataFrame, rows: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(rows), list(columns), name, value)
