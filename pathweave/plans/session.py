"""Session settings the operators count on."""

from pyspark.sql import SparkSession

# Longest path any analysis keeps, plus one.
PATH_BOUND = 1001

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # lets "the first n of a group" be applied before the shuffle for paths of up to 1000 events
    "spark.sql.optimizer.windowGroupLimitThreshold": str(PATH_BOUND),
}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
