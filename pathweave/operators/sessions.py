"""Behaviour of a session as columns."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as v

SESSION_KEYS = ("guid", "session_skey", "site_id")
SESSION_KEYS_COBRAND = ("guid", "session_skey", "site_id", "cobrand")


def vertical_conditions(
    vertical: str = "bsns_vrtcl_name",
    meta: str = "meta_categ_id",
    verticals: Mapping[str, object] = v.VERTICALS,
    metas: Mapping[str, object] = v.META_CATEGORIES,
) -> dict[str, Column]:
    return {
        **{name: F.col(vertical) == value for name, value in verticals.items()},
        **{name: F.col(meta) == value for name, value in metas.items()},
    }


def intent_conditions(event_type: str = "event_type") -> dict[str, Column]:
    return {name: F.col(event_type) == code for name, code in v.INTENTS.items()}


def conditional_counts(
    df: DataFrame, keys: Sequence[str | Column], conditions: Mapping[str, Column], total: str | None = None
) -> DataFrame:
    """Per key, how many rows meet each condition; ``total`` names a count of all rows."""
    counts = [F.count(F.when(c, 1)).alias(name) for name, c in conditions.items()]
    if total:
        counts.append(F.count(F.lit(1)).alias(total))
    return df.groupBy(*keys).agg(*counts)


def checkout_totals(outcomes: DataFrame, keys: Sequence[str] = SESSION_KEYS_COBRAND) -> DataFrame:
    """Number and value of a session's checkouts, grouped by exactly the join key."""
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_txns"),
        F.sum("gmb_usd").alias("gmb_usd"),
        F.sum("is_first_purchase").alias("has_first_purchase"),
    )


def registration_counts(registrations: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    return registrations.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_registrations"))


def category_breadth(
    items: DataFrame,
    keys: Sequence[str] = (*SESSION_KEYS, "dt"),
    levels: Mapping[str, str] | None = None,
) -> DataFrame:
    """Exact number of distinct categories a session saw on each level.

    Repeats of a (session, level, category) collapse before the shuffle.
    """
    levels = levels or {
        "num_meta": "meta_categ_name",
        "num_lv2": "categ_lvl2_id",
        "num_lv3": "categ_lvl3_id",
        "num_lv4": "categ_lvl4_id",
    }
    return items.groupBy(*keys).agg(*[F.count_distinct(c).alias(name) for name, c in levels.items()])


def breadth_bucket(column: str, cuts: Sequence[int]) -> Column:
    """1-4 by upper bound; a breadth of 0 or beyond the last bound is 5."""
    breadth = F.col(column)
    bucket = F.when(breadth < 1, v.SPECIFICITY_BUCKETS)
    for i, top in enumerate(cuts, start=1):
        bucket = bucket.when(breadth <= top, i)
    return bucket.otherwise(v.SPECIFICITY_BUCKETS)


def with_specificity(breadths: DataFrame, cuts: Mapping[str, Sequence[int]] = v.BREADTH_CUTS) -> DataFrame:
    """Add the weighted score (broadest level weighs most) and its tenth-wide bin."""
    n = v.SPECIFICITY_BUCKETS
    weights = [n**p for p in range(len(cuts) - 1, -1, -1)]
    weighted = sum(
        (breadth_bucket(c, limits) * w for (c, limits), w in zip(cuts.items(), weights)), F.lit(0)
    )
    return breadths.withColumn("specificity", weighted / F.lit(float(n * sum(weights)))).withColumn(
        "specificity_binned", F.floor(F.col("specificity") * 10) - 1
    )


def enrich(sessions: DataFrame, features: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left-join feature tables, each unique on its keys.

    Tables with the same keys are joined one after another, so the sessions are
    shuffled once per distinct key list and a feature aggregated on its join
    key is not shuffled again.
    """
    out = sessions
    for feature, keys in sorted(features, key=lambda f: len(f[1])):
        out = out.join(feature, list(keys), "left")
    return out


COHORTS = ("first", "nonfirst", "unsigned")


def cohort(
    sessions: DataFrame,
    name: str,
    first_purchases: str = "has_first_purchase",
    person: str = "incdata_id",
    user: str = "parent_uid",
) -> DataFrame:
    """Sessions with a first purchase, with purchases but no first one, or not signed in.

    A session without any purchase has a null count and is in neither of the
    first two.
    """
    rules = {
        "first": F.col(first_purchases) > 0 if first_purchases in sessions.columns else None,
        "nonfirst": F.col(first_purchases) == 0 if first_purchases in sessions.columns else None,
        "unsigned": (
            F.col(person).isNull() & (F.coalesce(F.col(user), F.lit(0)) == 0)
            if {person, user} <= set(sessions.columns)
            else None
        ),
    }
    if name not in rules:
        raise ValueError(f"unknown cohort {name!r}; use one of {COHORTS}")
    if rules[name] is None:
        raise ValueError(f"cohort {name!r} needs columns the sessions do not have")
    return sessions.where(rules[name])
