"""Equi-joins that survive a key owning a large share of the rows, on either side.

A key is *hot* when it owns more than ``min_rows`` rows of a side.  The rows of a
hot key are spread over parts of at most about that size by a hash of
``spread_by``; the other side's rows of the key are copied to each part.  For an
inner join both sides are spread, for the others only the left one can be.
Left rows without a key cannot match and are spread by the whole hash.  The
result is that of the plain join.  The list of hot keys is broadcast, so neither
side is shuffled for it: it has at most MAX_HOT keys of a side, those with the most
rows, and a key that is not among them owns less than one in MAX_HOT of the rows.
"""

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.0
HOT_ROWS = 1_000_000
MAX_HOT = 10_000
NULL_PARTS = 2**31 - 1


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(or_, [F.col(k).isNull() for k in keys])


def hot_keys(
    df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Hot keys of ``df`` with the number of parts each should be cut into, the MAX_HOT hottest of them.

    ``share`` also asks for that share of all rows.
    """
    return _hottest(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys, share, min_rows)


def _hottest(rows: DataFrame, keys: Sequence[str], share: float, min_rows: int) -> DataFrame:
    limit = F.lit(float(min_rows))
    if share:
        limit = F.greatest(rows.agg(F.sum("_rows")).scalar() * share, limit)
    return (
        rows.where(~_any_null(keys))
        .withColumn("_limit", limit)
        .where(F.col("_rows") > F.col("_limit"))
        .orderBy(F.desc("_rows"))
        .limit(MAX_HOT)
        .select(*keys, F.ceil(F.col("_rows") / F.col("_limit")).cast("int").alias("_parts"))
    )


def _hash(df: DataFrame, columns: Sequence[str] | None) -> Column:
    """A hash of ``columns``, or of all that can be hashed (maps cannot)."""
    able = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*(columns or able or [F.lit(0)]))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    how: str = "inner",
    spread_by: Sequence[str] | None = None,
    condition: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    count_on: DataFrame | None = None,
    counted: DataFrame | None = None,
    spread_right_by: Sequence[str] | None = None,
    share: float = HOT_SHARE,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join on ``on`` (pairs of left and right column names).

    ``condition`` gets two functions, one naming left and one naming right
    columns, and returns a further predicate.  Columns of both sides are kept;
    give clashing ones other names first.
    Keys are counted on ``count_on`` instead of ``left`` where that is cheaper to
    compute and holds at least the keys of ``left``; ``counted`` has them counted already (left names, ``_rows``).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot split the left side of a {how!r} join")
    keys = [f"_k{i}" for i in range(len(on))]
    keyed_left = left.withColumns({k: F.col(l) for k, (l, _) in zip(keys, on)})
    keyed_right = right.withColumns({k: F.col(r) for k, (_, r) in zip(keys, on)})
    named = [F.col(l).alias(k) for k, (l, _) in zip(keys, on)]
    if counted is not None:
        hot = _hottest(counted.select(*named, "_rows"), keys, share, min_rows)
    else:
        hot = hot_keys((left if count_on is None else count_on).select(*named), keys, share, min_rows)
    hot = hot.select(*keys, "_parts", F.lit(1).alias("_copies"))
    if how == "inner":
        there = hot_keys(right.select(*[F.col(r).alias(k) for k, (_, r) in zip(keys, on)]), keys, share, min_rows)
        hot = (
            hot.union(there.select(*keys, F.lit(1), "_parts"))
            .groupBy(*keys)
            .agg(F.max("_parts").alias("_parts"), F.max("_copies").alias("_copies"))
        )
    parts, copies = F.coalesce("_parts", F.lit(1)), F.coalesce("_copies", F.lit(1))
    own, others = F.pmod(_hash(left, spread_by), parts), F.pmod(_hash(right, spread_right_by), copies)
    # part i * copies + j: a left row is in one i and all j, a right row in one j and all i
    a = keyed_left.join(F.broadcast(hot), keys, "left").withColumn("_own", own)
    if how == "inner":
        a = a.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))).withColumn("_own", F.col("_own") * copies + F.col("_copy"))
    a = (
        a.withColumn("_part", F.when(_any_null(keys), F.pmod(_hash(left, spread_by), F.lit(NULL_PARTS))).otherwise(F.col("_own")).cast("int"))
        .drop("_parts", "_copies", "_own", "_copy")
        .alias("a")
    )
    b = (
        keyed_right.join(F.broadcast(hot), keys, "left")
        .withColumn("_i", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("_part", (F.col("_i") * copies + others).cast("int"))
        .drop("_parts", "_copies", "_i")
        .alias("b")
    )
    match = F.col("a._part") == F.col("b._part")
    for k in keys:
        match = match & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    if condition is not None:
        match = match & condition(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))
    joined = a.join(b, match, how)
    kept = [F.col(f"a.{c}") for c in left.columns]
    if how in ("inner", "left"):
        kept += [F.col(f"b.{c}") for c in right.columns]
    return joined.select(*kept)
