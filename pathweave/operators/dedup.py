"""Keep one row per key."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], position: str = "_position"
) -> DataFrame:
    """The first row per ``keys`` under ``order``.

    End ``order`` with something unique, or ties are open.  The filter on
    ``row_number`` lets Spark cut every group down to one row before the
    shuffle, so a key with a huge number of copies costs one row per task.
    """
    spec = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(position, F.row_number().over(spec)).where(F.col(position) == 1).drop(position)
