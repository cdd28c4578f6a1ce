"""Which channels occur together more often than chance would have it."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import stage
from . import bitmap, distributions
from .paths import OUTCOME


def path_kinds(df: DataFrame, channel: str, outcome: Sequence[str] = OUTCOME) -> DataFrame:
    """``channels`` (sorted distinct set) and ``n_paths``, how many outcomes have exactly that set."""
    sets = df.groupBy(*outcome).agg(F.sort_array(F.collect_set(channel)).alias("channels"))
    return sets.groupBy("channels").agg(F.count(F.lit(1)).alias("n_paths"))


def contingency(kinds: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """All pairs of channels with their 2 x 2 table over paths.

    ``incidence_1/2`` are paths with each channel, ``observed_pairs`` with both,
    ``n`` all paths.  Runs on kinds of paths, so its cost does not depend on how
    many paths there are.  Pairs that never occur together are listed with 0.
    """
    n = kinds.agg(F.sum("n_paths")).scalar()
    shown = kinds.select(F.array_except("channels", F.array(*[F.lit(c) for c in excluded])).alias("channels"), "n_paths") if excluded else kinds
    single = (
        shown.select(F.explode("channels").alias("channel"), "n_paths")
        .groupBy("channel")
        .agg(F.sum("n_paths").alias("incidence"))
    )
    def later(one: Column, i: Column) -> Column:
        return F.transform(
            F.slice("channels", i + 2, F.size("channels")),
            lambda two: F.struct(one.alias("channel_1"), two.alias("channel_2")),
        )
    both = (
        shown.select("n_paths", F.inline(F.flatten(F.transform("channels", later))))
        .groupBy("channel_1", "channel_2")
        .agg(F.sum("n_paths").alias("observed_pairs"))
    )
    return _tables(single, both, n)


def _tables(single: DataFrame, both: DataFrame, n: Column) -> DataFrame:
    """All pairs of listed channels, from (channel, incidence) and the pairs that were seen."""
    listed = single.agg(F.sort_array(F.collect_list(F.struct("channel", "incidence"))).alias("channels"))

    def with_later(one: Column, i: Column) -> Column:
        return F.transform(
            F.slice("channels", i + 2, F.size("channels")),
            lambda two: F.struct(
                one["channel"].alias("channel_1"),
                two["channel"].alias("channel_2"),
                one["incidence"].alias("incidence_1"),
                two["incidence"].alias("incidence_2"),
            ),
        )

    margins = listed.select(F.inline(F.flatten(F.transform("channels", with_later))))
    return (
        margins.join(both, ["channel_1", "channel_2"], "left")
        .na.fill(0, ["observed_pairs"])
        .withColumn("n", n)
    )


def contingency_of_paths(
    rows: DataFrame, channel: str, excluded: Sequence[str] = (), outcome: Sequence[str] = OUTCOME, blocks: int = bitmap.BLOCKS
) -> DataFrame:
    """The table of :func:`contingency` from rows that name the channels of each outcome, by way of a bitmap index.

    One pass over the index gives single counts, pair counts and the number of paths; its cost is linear in
    the words of 63 paths, and sets of channels are not enumerated path by path.
    """
    counts = bitmap.common_counts(bitmap.bitmap_index(rows, channel, outcome, blocks), channel, excluded)
    # small, and used three times
    counts = stage(counts.select(F.col("token_1").alias("channel_1"), F.col("token_2").alias("channel_2"), F.col("n").alias("observed_pairs")))
    single = counts.where("channel_1 IS NOT NULL AND channel_2 IS NULL").select(F.col("channel_1").alias("channel"), F.col("observed_pairs").alias("incidence"))
    return _tables(single, counts.where("channel_2 IS NOT NULL"), counts.where("channel_1 IS NULL").agg(F.sum("observed_pairs")).scalar())


def lift(pairs: DataFrame, digits: int | None = 5) -> DataFrame:
    """Expected pairs under independence, lift over it and the observed share."""
    expected = F.col("incidence_1").cast("double") * F.col("incidence_2") / F.col("n")
    cut = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    return pairs.withColumn("expected_pairs", expected).withColumns(
        {
            "lift": cut((F.col("observed_pairs") - F.col("expected_pairs")) / F.col("expected_pairs")),
            "observed_p": cut(F.col("observed_pairs") / F.col("n")),
        }
    )


def pair_tests(pairs: DataFrame, digits: int | None = 5) -> DataFrame:
    """Add P(X <= observed), P(X >= observed) and the corrected chi-square p-value of each pair.

    The p-value is null where an expected cell is empty, and unstable where one is below 5.
    """
    o, n1, n2, n = (F.col(c).cast("double") for c in ("observed_pairs", "incidence_1", "incidence_2", "n"))
    p_lt, p_gt = distributions.hypergeometric_tails(o, n1, n2, n)
    cells = [
        (o, n1 * n2 / n),
        (n1 - o, n1 * (n - n2) / n),
        (n2 - o, (n - n1) * n2 / n),
        (n - n1 - n2 + o, (n - n1) * (n - n2) / n),
    ]
    correction = F.least(F.lit(0.5), *[F.abs(seen - expected) for seen, expected in cells])
    statistic = sum((F.abs(seen - expected) - correction) ** 2 / expected for seen, expected in cells)
    least = F.least(*[expected for _, expected in cells])
    cut = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    return pairs.select(
        *pairs.columns,
        cut(F.when(least > 0, distributions.erfc(F.sqrt(statistic / 2)))).alias("p_value_chisq"),
        (least < 5).alias("unstable_pvalue"),
        cut(p_lt).alias("p_lt"),
        cut(p_gt).alias("p_gt"),
    )


def effects(lifted: DataFrame) -> DataFrame:
    """Standardised effect of each pair, pairs without any left out."""
    return lifted.select(
        "channel_1", "channel_2", ((F.col("observed_pairs") - F.col("expected_pairs")) / F.col("n")).alias("effect")
    ).where(F.col("effect") != 0)


def strong_pairs(lifted: DataFrame, more_than: int = 10_000) -> DataFrame:
    """Pairs seen together often, strongest lift first."""
    return lifted.where(F.col("observed_pairs") > more_than).orderBy(F.desc("lift"), "channel_1", "channel_2")


def graph_nodes(pairs: DataFrame, source: str = "channel_1", target: str = "channel_2") -> DataFrame:
    """Nodes of the pair graph with 0-based codes by name."""
    names = pairs.select(F.col(source).alias("name")).union(pairs.select(F.col(target).alias("name"))).distinct()
    return names.select("name", (F.row_number().over(W.orderBy("name")) - 1).alias("code"))


def graph_links(
    pairs: DataFrame, nodes: DataFrame, value: str, source: str = "channel_1", target: str = "channel_2"
) -> DataFrame:
    """Links of the pair graph by node code."""
    a = nodes.select(F.col("name").alias(source), F.col("code").alias("source"))
    b = nodes.select(F.col("name").alias(target), F.col("code").alias("target"))
    return pairs.join(a, source).join(b, target).select("source", "target", F.col(value).alias("value"))


def multiplicity(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per key."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("cnt"))


def multiplicity_summary(counts: DataFrame, group: str, top: float = 0.999) -> DataFrame:
    """Quantiles, mean and ``top`` quantile of ``cnt`` per group.

    Exact quantiles over the frequencies of counts: equal counts are folded
    before anything is gathered.
    """
    frequency = counts.groupBy(group, "cnt").agg(F.count(F.lit(1)).alias("freq"))

    def quantile(q: float) -> Column:
        return F.percentile("cnt", F.lit(q), F.col("freq"))

    weight = F.sum(F.col("cnt") * F.col("freq")) / F.sum("freq")
    return frequency.groupBy(group).agg(
        F.sum("freq").alias("n_keys"),
        F.min("cnt").alias("min"),
        quantile(0.25).alias("q1"),
        quantile(0.5).alias("median"),
        weight.alias("mean"),
        quantile(0.75).alias("q3"),
        F.max("cnt").alias("max"),
        quantile(top).alias("top"),
    )


def below_quantile(counts: DataFrame, top: float = 0.999) -> DataFrame:
    """Keys whose count does not exceed the ``top`` quantile of all counts."""
    frequency = counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("freq"))
    limit = frequency.agg(F.percentile("cnt", F.lit(top), F.col("freq"))).scalar()
    return counts.where(F.col("cnt") <= limit)
