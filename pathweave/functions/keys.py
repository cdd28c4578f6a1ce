"""Which identity values may be joined on."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as v


def is_zero_device(device: str) -> Column:
    return F.col(device).contains(v.ZERO_DEVICE)


def is_valid_device(device: str) -> Column:
    return (F.length(device) >= v.MIN_DEVICE_LENGTH) & ~is_zero_device(device)


def is_valid_id(user_id: str) -> Column:
    return F.col(user_id) > 0


VALIDITY = {
    "id": is_valid_id,
    "device": is_valid_device,
    "text": lambda c: F.col(c).isNotNull(),
}


def usable_key(column: str, kind: str) -> Column:
    """The key as a string, null where it must not be joined on."""
    if kind not in VALIDITY:
        raise ValueError(f"unknown key kind {kind!r}; use one of {sorted(VALIDITY)}")
    return F.when(VALIDITY[kind](column), F.col(column).cast("string"))
