"""Read partitioned tables."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """A table, or the part of it a path pattern selects.

    Pass ``basePath`` with a pattern to keep the partition columns.
    """
    df = spark.read.format(fmt).options(**options).load(path)
    return df.select(*columns) if columns else df


def in_range(df: DataFrame, start: str | Column, end: str | Column, column: str = "dt") -> DataFrame:
    """Rows dated ``start`` to ``end``, both included.

    The partition column itself is compared, so Spark prunes directories.
    """
    return df.where(F.col(column).between(start, end))


def day_offset(day: str, days: int) -> Column:
    """A date some days after (or before) ``day``, as text like the partition values."""
    return F.date_add(F.lit(day).cast("date"), days).cast("string")


def missing_days(df: DataFrame, start: str, end: str, column: str = "dt") -> DataFrame:
    """Days from ``start`` to ``end`` for which ``df`` has no rows."""
    days = df.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(column)
    )
    present = df.select(F.col(column).cast("date").alias(column)).distinct()
    return days.join(present, column, "left_anti")


def partition_days(spark: SparkSession, path: str, column: str = "dt") -> DataFrame:
    """Days that a partitioned folder has a directory for; only names are read, none if there is no folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{column}=*")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    names = [(f.getPath().getName().removeprefix(f"{column}="),) for f in found]
    return spark.createDataFrame(names, f"{column} string")


def of_days(df: DataFrame, days: DataFrame, column: str = "dt") -> DataFrame:
    """Rows of the days that ``days`` has in ``column``; of a partitioned table Spark reads only these, once it knows them."""
    return df.join(days.select(column).distinct(), column, "left_semi")


def _point(seed: int, columns: Sequence[str]) -> Column:
    """0 <= x < 2**32, from an MD5 of the seed and the columns (as text)."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *named)), 1, 8), 16, 10).cast("bigint")


def bernoulli_sample(
    df: DataFrame, fraction: float, seed: int, by: Sequence[str], stratum: str | None = None, fractions: Mapping | None = None
) -> DataFrame:
    """Each row with probability ``fraction``, or that of its ``stratum`` in ``fractions``.

    Whether a row is in hangs on the seed and its identity ``by`` alone, so a sample survives another partitioning, order or engine, holds what a
    smaller fraction's holds, and rows of one identity are in together.
    """
    limit = F.lit(float(fraction))
    for value, own in (fractions or {}).items():
        limit = F.when(F.col(stratum).eqNullSafe(F.lit(value)), float(own)).otherwise(limit)
    return df.where(_point(seed, by) < limit * float(2**32))


def key_sample(df: DataFrame, key: str, one_in: int, remainder: int = 0) -> DataFrame:
    """All rows of about one key in ``one_in``.

    The choice hangs on an MD5 of the key, so reruns, other tables and other
    engines pick the same keys.
    """
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % one_in
    return df.where(bucket == remainder)
