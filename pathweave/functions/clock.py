"""Whole-second time arithmetic."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
BEFORE_SLACK = -600


def seconds(ts: str | Column) -> Column:
    """Seconds since the epoch with the fraction cut off."""
    return F.unix_timestamp(ts)


def lag_columns(anchor_ts: str, touch_ts: str, prefix: str, before: str | None = None) -> dict[str, Column]:
    """``<prefix>_sec_diff``, ``<prefix>_day_diff`` and, if named, an is-before flag."""
    diff = seconds(anchor_ts) - seconds(touch_ts)
    columns = {
        f"{prefix}_sec_diff": diff,
        f"{prefix}_day_diff": diff / F.lit(float(DAY)),
    }
    if before:
        # an unknown anchor time is not "before"
        columns[before] = F.when(diff > BEFORE_SLACK, 1).otherwise(0)
    return columns
