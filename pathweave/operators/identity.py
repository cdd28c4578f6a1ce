"""Attach a cross-device person id to rows."""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import is_valid_device, is_zero_device, usable_key
from . import skew


@dataclass(frozen=True)
class IdentityMap:
    """A map from one kind of key to person ids."""

    name: str
    column: str
    kind: str
    table: DataFrame
    key: str
    person: str = "incdata_id"


def resolve_identity(
    df: DataFrame,
    maps: Sequence[IdentityMap],
    ids: Sequence[str],
    person: str = "incdata_id",
    unresolved: str | None = "nojoin",
    share: float = skew.HOT_SHARE,
    min_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """Give each row the person ids of the first map (strongest first) that knows it.

    A key with several person ids yields several rows; a row no map knows is
    kept once, labelled ``unresolved``.

    Who a row belongs to hangs on its keys alone.  So the distinct combinations of keys are listed once per
    key, all maps are joined in one equi-join on (rank of the map, key), and the persons of a combination's least rank are kept,
    task by task before they meet.  The rows themselves are shuffled once, whatever the number of maps.
    """
    keys = [f"_key_{i}" for i in range(len(maps))]
    rows = df.drop(person).withColumns({k: usable_key(m.column, m.kind) for k, m in zip(keys, maps)})
    combined = F.concat_ws("|", *[F.coalesce(F.concat(F.length(k).cast("string"), F.lit(":"), F.col(k)), F.lit("-")) for k in keys])
    rows = rows.withColumn("_keys", F.when(F.coalesce(*keys).isNotNull(), combined))
    known = reduce(
        DataFrame.unionByName,
        [
            m.table.select(F.lit(i).alias("_map"), F.col(m.key).cast("string").alias("_map_key"), F.col(m.person).alias("_map_person"))
            for i, m in enumerate(maps)
        ],
    )
    known = known.where(F.col("_map_key").isNotNull() & F.col("_map_person").isNotNull()).distinct()
    combinations = rows.where(F.col("_keys").isNotNull()).groupBy("_keys", *keys).agg(F.count(F.lit(1)).alias("_rows"))
    listed = combinations.select(
        F.col("_keys").alias("_of"), F.posexplode(F.array(*keys)).alias("_rank", "_key")
    ).where(F.col("_key").isNotNull())
    # narrow rows on either side: Spark splits what is skewed in an inner join
    found = listed.join(known, (F.col("_rank") == F.col("_map")) & (F.col("_key") == F.col("_map_key")))
    strongest = F.rank().over(W.partitionBy("_of").orderBy("_rank"))
    names = F.array(*[F.lit(m.name) for m in maps])
    found = found.withColumn("_nth", strongest).where("_nth = 1").select("_of", "_map_person", names[F.col("_rank")].alias("_strategy"))
    joined = skew.skew_join(rows, found, [("_keys", "_of")], how="left", spread_by=ids, counted=combinations, share=share, min_rows=min_rows)
    strategy = F.col("_strategy") if unresolved is None else F.coalesce("_strategy", F.lit(unresolved))
    return joined.select(*df.drop(person, "join_strategy").columns, F.col("_map_person").alias(person), strategy.alias("join_strategy"))


def anonymous(
    sessions: DataFrame,
    cookie_map: DataFrame,
    device_map: DataFrame,
    ids: Sequence[str],
    cookie: str = "cguid",
    device: str = "device_id",
    cookie_key: str = "cguid",
    device_key: str = "did",
) -> DataFrame:
    """Sessions neither whose cookie nor whose device is known.

    An all-zero device says nothing and is kept; any other device must be a
    usable one.
    """
    cookies = cookie_map.select(F.col(cookie_key).alias("_map_key"))
    devices = device_map.select(F.col(device_key).alias("_map_key"))
    unknown_cookie = skew.skew_join(sessions, cookies, [(cookie, "_map_key")], how="left_anti", spread_by=ids)
    candidates = unknown_cookie.where(is_valid_device(device) | is_zero_device(device)).withColumn(
        "_device", usable_key(device, "device")
    )
    return (
        skew.skew_join(
            candidates, devices, [("_device", "_map_key")], how="left_anti", spread_by=ids,
            count_on=sessions.withColumn("_device", usable_key(device, "device")),
        )
        .drop("_device")
        .dropDuplicates()
    )
