"""Small lookup tables and text tables."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as v


def read_tsv_lookup(spark: SparkSession, path: str, schema: str = "rotation_id bigint, big_rock string") -> DataFrame:
    """Headerless tab-separated lookup; columns are named by position."""
    return spark.read.csv(path, sep="\t", schema=schema)


def channel_lookup(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(v.CHANNELS), "channel_id int, channel_name string")


def with_lookup(df: DataFrame, lookup: DataFrame, key: str, small: bool = False) -> DataFrame:
    """Left-join a lookup unique on ``key``.

    ``small`` is for lookups of fixed size, such as the channel list; any other
    one is left to Spark, which broadcasts it only if it turns out small.
    """
    return df.join(F.broadcast(lookup) if small else lookup, key, "left")


def percent_table(df: DataFrame, row: str, name: str = "day_diff", value: str = "prcnt_dist") -> DataFrame:
    """A wide table of texts like ``10.7%`` as long numbers; empty texts become null."""
    columns = [c for c in df.columns if c != row]
    long = df.where(F.col(row).isNotNull()).select(row, *[F.col(c).cast("string") for c in columns])
    return long.unpivot([row], columns, name, value).withColumns(
        {
            name: F.col(name).try_cast("int"),
            value: F.regexp_replace(value, "%", "").try_cast("double"),
        }
    )


def read_percent_csv(spark: SparkSession, path: str, row: str, lags: Sequence[int]) -> DataFrame:
    """CSV with a header whose columns are taken by position: a name, then one column per lag."""
    schema = ", ".join([f"`{row}` string", *[f"`{lag}` string" for lag in lags]])
    return percent_table(spark.read.csv(path, header=True, schema=schema, enforceSchema=True), row)
