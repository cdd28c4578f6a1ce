"""Set operations on ids."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import skew_join


def in_both_groups(df: DataFrame, key: str, group: str, one: object, two: object) -> DataFrame:
    """Ids seen in both groups."""
    known = df.where(F.col(key).isNotNull())
    return known.where(F.col(group) == one).select(key).intersect(known.where(F.col(group) == two).select(key))


def remove_contaminated(
    df: DataFrame, key: str, group: str, one: object, two: object, spread_by: Sequence[str] | None = None
) -> DataFrame:
    """Rows with an id that is not in both groups."""
    both = in_both_groups(df, key, group, one, two)
    return skew_join(df.where(F.col(key).isNotNull()), both, [(key, key)], how="left_anti", spread_by=spread_by)


def without(df: DataFrame, unwanted: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is not listed (rows without a value stay)."""
    return skew_join(df, unwanted, [(on, on)], how="left_anti")


def union_distinct(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.unionByName(two).dropDuplicates()
