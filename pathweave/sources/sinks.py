"""Write results and stages."""

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite") -> None:
    """Parquet in one directory per value of ``by``.

    ``overwrite`` replaces only the directories the rows belong to, so running
    a day again does not double it; ``append`` adds to what is there.  The
    rebalance gathers each directory's rows into few files and splits those of
    a very full one.
    """
    (
        df.hint("rebalance", *by)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_tsv(df: DataFrame, path: str, null: str | None = None, by: Sequence[str] = ()) -> None:
    """Tab-separated text; ``null`` is how missing values are written (``\\N`` for warehouse loads).

    With ``by``, one directory per value; writing again replaces only the directories the rows belong to.
    """
    writer = df.write.mode("overwrite").option("sep", "\t")
    if null is not None:
        writer = writer.option("nullValue", null).option("emptyValue", "")
    if by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    writer.csv(path)


def day_digests(spark: SparkSession, path: str, day: str = "dt") -> DataFrame:
    """(day, n_rows, digest) of the text files of each day directory; the digest does not depend on their order or number."""
    lines = spark.read.option("basePath", path).text(f"{path.rstrip('/')}/{day}=*")
    hashed = F.xxhash64("value").cast("decimal(38,0)")
    return lines.groupBy(F.col(day).cast("string").alias(day)).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(hashed).alias("digest"))


def manifest_path(path: str) -> str:
    return path.rstrip("/") + "-manifest"


def write_days_tsv(df: DataFrame, path: str, null: str | None = None, day: str = "dt") -> None:
    """:func:`write_tsv` by day, with a manifest beside it: rows and digest of each day that was written.

    A day that does not hold the rows it was given is an error.
    """
    spark = df.sparkSession
    given = stage(df.groupBy(F.col(day).cast("string").alias(day)).agg(F.count(F.lit(1)).alias("_given")))
    write_tsv(df, path, null=null, by=[day])
    if given.isEmpty():
        return
    written = stage(day_digests(spark, path, day).join(given, day))
    wrong = written.where(F.col("n_rows") != F.col("_given"))
    if written.count() != given.count() or not wrong.isEmpty():
        raise OSError(f"{path} does not hold the rows it was given")
    write_partitioned(written.drop("_given"), manifest_path(path), [day])


def damaged_days(spark: SparkSession, path: str, day: str = "dt") -> DataFrame:
    """Days of the manifest whose directory is short, changed or gone."""
    listed = spark.read.schema(f"n_rows bigint, digest decimal(38,0), {day} string").parquet(manifest_path(path))
    there = day_digests(spark, path, day).withColumnsRenamed({"n_rows": "_n", "digest": "_d"})
    joined = listed.join(there, day, "left")
    return joined.where(~(F.col("n_rows").eqNullSafe(F.col("_n")) & F.col("digest").eqNullSafe(F.col("_d")))).select(day)


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path, or anything that a pattern selects, is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and driver and executors are one process."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("give a path or set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="pathweave-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder under the session's checkpoint directory, which goes with the session."""
    path = f"{checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a stage at the end, if the session is still there to do it."""
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is None or jvm is None:
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, path: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Cut a plan: write ``df`` as a table and go on from what was written.

    With a ``path`` later jobs can read the table too; without, it goes to a new
    folder under the session's checkpoint directory, which goes with the
    session.  Either survives the loss of executors, and later steps read only
    the columns they need.  A stage holds what was staged last, nothing older.
    Shuffles that only led to it are deleted as soon as it is written.
    """
    spark = df.sparkSession
    if path is None:
        path = scratch(spark, "stage")
    writer = df.hint("rebalance", *by).write.option("partitionOverwriteMode", "static").partitionBy(*by) if by else df.write
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        writer.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.option("basePath", path).schema(df.schema).parquet(path)
