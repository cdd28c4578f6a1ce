"""Link touches to the outcomes that follow them within a bounded window."""

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import DAY, seconds
from ..functions.keys import usable_key
from ..sources.sinks import stage
from . import skew
from .dedup import keep_first


BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Window:
    """How far before its anchor a touch may lie.

    ``date_gap`` bounds the calendar-day distance, ``grace`` lets a touch come
    a few seconds late (but not on the next day).  ``strict`` asks for touches
    really before the anchor.
    """

    days: int
    date_gap: int
    grace: int = 600
    strict: bool = False

    def accepts(self, touch_ts: Column, touch_dt: Column, anchor_ts: Column, anchor_dt: Column) -> Column:
        touch_sec, anchor_sec = seconds(touch_ts), seconds(anchor_ts)
        in_time = touch_sec < anchor_sec if self.strict else touch_sec <= anchor_sec + self.grace
        return (
            (touch_dt <= anchor_dt)
            & (F.datediff(anchor_dt, touch_dt) <= self.date_gap)
            & in_time
            & (anchor_sec - touch_sec <= self.days * DAY)
        )


CHECKOUT = Window(days=24, date_gap=25)
INTENT = Window(days=30, date_gap=30)
REGISTRATION = Window(days=14, date_gap=14)
SESSION = Window(days=14, date_gap=14)
ITEM_VIEW = Window(days=14, date_gap=14, grace=0)
EARLIER_SESSION = Window(days=14, date_gap=14, grace=0, strict=True)


@dataclass(frozen=True)
class Side:
    """Where a table keeps its time and what identifies a row."""

    ts: str
    dt: str
    ids: tuple[str, ...]


@dataclass(frozen=True)
class Key:
    """One identity key: its label, its column on both sides and what makes it usable."""

    name: str
    touch: str
    anchor: str
    kind: str = "text"


def _in_window(window: Window, touch: Side, anchor: Side) -> Callable:
    return lambda a, b: window.accepts(a(touch.ts), a(touch.dt), b(anchor.ts), b(anchor.dt))


def _in_buckets(
    touches: DataFrame, anchors: DataFrame, window: Window, touch: Side, anchor: Side, bucket_seconds: int
) -> tuple[DataFrame, DataFrame]:
    first = F.floor((seconds(anchor.ts) - window.days * DAY) / bucket_seconds)
    last = F.floor((seconds(anchor.ts) + window.grace) / bucket_seconds)
    return (
        touches.withColumn("_slot", F.floor(seconds(touch.ts) / bucket_seconds)),
        anchors.withColumn("_aslot", F.explode(F.sequence(first, last))),
    )


def lookback_join(
    touches: DataFrame,
    anchors: DataFrame,
    key: Key,
    window: Window,
    touch: Side,
    anchor: Side,
    bucket_seconds: int | None = None,
    broadcast_anchors: bool = False,
    share: float = skew.HOT_SHARE,
    min_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """All (touch, anchor) rows sharing ``key`` with the touch inside ``window``.

    ``bucket_seconds`` also cuts time: a touch falls in one bucket, an anchor is
    copied to every bucket its window reaches, so one key's history is spread
    over many tasks and far-apart rows are never compared.
    ``broadcast_anchors`` broadcasts them if there are at most ``BROADCAST_ROWS``.
    """
    a = touches.withColumn("_key", usable_key(key.touch, key.kind)).where("_key IS NOT NULL")
    b = anchors.withColumn("_key", usable_key(key.anchor, key.kind)).where("_key IS NOT NULL")
    on = [("_key", "_akey")]
    b = b.withColumnRenamed("_key", "_akey")
    if bucket_seconds:
        a, b = _in_buckets(a, b, window, touch, anchor, bucket_seconds)
        on.append(("_slot", "_aslot"))
    if broadcast_anchors and b.count() <= BROADCAST_ROWS:
        fits = window.accepts(*[F.col(c) for c in (touch.ts, touch.dt, anchor.ts, anchor.dt)])
        for l, r in on:
            fits = fits & (F.col(l) == F.col(r))
        pairs = a.join(F.broadcast(b), fits)
    else:
        pairs = skew.skew_join(
            a, b, on, spread_by=touch.ids, spread_right_by=anchor.ids, condition=_in_window(window, touch, anchor),
            share=share, min_rows=min_rows,
        )
    return pairs.drop("_key", "_akey", "_slot", "_aslot").withColumn("join_strategy", F.lit(key.name))


def by_key(df: DataFrame, columns: Sequence[tuple[int, str, str]], prio: str, value: str) -> DataFrame:
    """One row per usable key of a row: its rank and its value."""
    found = F.array(*[F.struct(F.lit(i).alias(prio), usable_key(c, kind).alias(value)) for i, c, kind in columns])
    # no lambda here: equal plans of equal tables let Spark reuse one shuffle for all uses
    return df.select("*", F.inline(found)).where(F.col(value).isNotNull())


def link(
    touches: DataFrame,
    anchors: DataFrame,
    keys: Sequence[Key],
    window: Window,
    touch: Side,
    anchor: Side,
    tie_break: Sequence[Column] = (),
    share: float = skew.HOT_SHARE,
    min_rows: int = skew.HOT_ROWS,
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Look back by several keys and keep one row per (touch, anchor).

    ``keys`` come strongest first; ``join_strategy`` names the strongest key
    that made the match.  All keys go through one join: every row is listed
    once per usable key and (key rank, key value) is what is joined on.
    A match is left out where it is made if a stronger key of the same two rows
    makes it too, so matches are not shuffled to be merged.  Only those of ids
    that several touches or several anchors have are, by ``tie_break``.
    ``bucket_seconds`` cuts time as in :func:`lookback_join`.
    """
    def matches(some_touches: DataFrame, some_anchors: DataFrame) -> DataFrame:
        a = by_key(some_touches, [(i, k.touch, k.kind) for i, k in enumerate(keys)], "_rank", "_key")
        b = by_key(some_anchors, [(i, k.anchor, k.kind) for i, k in enumerate(keys)], "_arank", "_akey")
        above = range(len(keys) - 1)
        a = a.withColumns({f"_above{i}": F.when(F.col("_rank") > i, usable_key(keys[i].touch, keys[i].kind)) for i in above})
        b = b.withColumns({f"_aabove{i}": F.when(F.col("_arank") > i, usable_key(keys[i].anchor, keys[i].kind)) for i in above})
        on = [("_rank", "_arank"), ("_key", "_akey")]
        if bucket_seconds:
            a, b = _in_buckets(a, b, window, touch, anchor, bucket_seconds)
            on.append(("_slot", "_aslot"))
        fits = _in_window(window, touch, anchor)

        def strongest_of_both(l: Callable, r: Callable) -> Column:
            by_stronger = [F.coalesce(l(f"_above{i}") == r(f"_aabove{i}"), F.lit(False)) for i in above]
            return fits(l, r) & ~reduce(or_, by_stronger, F.lit(False))

        return skew.skew_join(
            a, b, on, spread_by=touch.ids, spread_right_by=anchor.ids, condition=strongest_of_both, share=share, min_rows=min_rows
        )

    touches_twice, anchors_twice = repeated(touches, touch.ids), repeated(anchors, anchor.ids)
    found = _named(matches(_without(touches, touches_twice), _without(anchors, anchors_twice)), keys)
    copies = []
    if anchors_twice is not None:
        copies.append(matches(_without(touches, touches_twice), _with_ids(anchors, anchors_twice, "left_semi")))
    if touches_twice is not None:
        copies.append(matches(_with_ids(touches, touches_twice, "left_semi"), anchors))
    if not copies:
        return found
    return found.unionByName(strongest(reduce(DataFrame.unionByName, copies), keys, touch, anchor, tie_break))


def repeated(df: DataFrame, ids: Sequence[str]) -> DataFrame | None:
    """The ``ids`` that several rows have, staged; None if there are none."""
    counts = df.groupBy(*ids).agg(F.count(F.lit(1)).alias("_rows"))
    twice = stage(counts.where(F.col("_rows") > 1).select(*ids))
    return None if twice.isEmpty() else twice


def _with_ids(df: DataFrame, some: DataFrame, how: str) -> DataFrame:
    """Rows of ``df`` whose ids are (``left_semi``) or are not (``left_anti``) in ``some``; nulls are alike."""
    named = some.withColumnsRenamed({c: f"_twice_{c}" for c in some.columns})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_twice_{c}")) for c in some.columns])
    return df.join(named, same, how)


def _without(df: DataFrame, some: DataFrame | None) -> DataFrame:
    return df if some is None else _with_ids(df, some, "left_anti")


def strongest(matches: DataFrame, keys: Sequence[Key], touch: Side, anchor: Side, tie_break: Sequence[Column] = ()) -> DataFrame:
    """Of the rows of a (touch, anchor) the one matched by the strongest key, which ``join_strategy`` names."""
    return _named(keep_first(matches, [*touch.ids, *anchor.ids], [F.col("_rank"), *tie_break]), keys)


def _named(matches: DataFrame, keys: Sequence[Key]) -> DataFrame:
    names = F.array(*[F.lit(k.name) for k in keys])
    above = [f"{side}{i}" for side in ("_above", "_aabove") for i in range(len(keys) - 1)]
    return matches.withColumn("join_strategy", names[F.col("_rank")]).drop("_rank", "_arank", "_key", "_akey", "_slot", "_aslot", *above)


def merge_matches(
    matches: Sequence[DataFrame],
    strategies: Sequence[str],
    ids: Sequence[str],
    tie_break: Sequence[Column] = (),
) -> DataFrame:
    """Merge separately made look-back results (strongest first) into one row per ``ids``."""
    tagged = [m.withColumn("_rank", F.lit(i)) for i, m in enumerate(matches)]
    together = tagged[0]
    for m in tagged[1:]:
        together = together.unionByName(m)
    best = keep_first(together, ids, [F.col("_rank"), *tie_break])
    names = F.array(*[F.lit(s) for s in strategies])
    return best.withColumn("join_strategy", names[F.col("_rank")]).drop("_rank")
