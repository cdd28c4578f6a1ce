"""Sources and sinks: what is written and read back from the shared folder."""

from pyspark.sql import functions as F

from ..operators.sessions import SESSION_KEYS
from ..sources import lookups, scan, sinks
from . import bindings as b
from . import jobs
from .jobs import CHECKOUT_KEYS
from .link_queries import _lookback, _one_key
from .registry import query, with_views

_TOUCH = "event_id, event_ts, event_dt, user_id, cguid, channel_name"


def _touches(spark, sf):
    return b.touches(spark, sf).select(*_TOUCH.split(", "))


def _stored(spark, sf):
    out = sinks.scratch(spark, "days")
    sinks.write_partitioned(_touches(spark, sf), out, ["event_dt"])
    return out


@query("scan_partition_glob", with_views(f"SELECT {_TOUCH} FROM touch WHERE event_dt BETWEEN DATE '2024-01-10' AND DATE '2024-01-19'", "touch"))
def scan_partition_glob(spark, sf):
    out = _stored(spark, sf)
    return scan.scan(spark, f"{out}/event_dt=2024-01-1*", _TOUCH.split(", "), basePath=out)


@query(
    "scan_partition_start",
    with_views(f"SELECT {_TOUCH} FROM touch WHERE event_dt BETWEEN DATE '2024-01-20' - 12 AND DATE '2024-01-20'", "touch"),
)
def scan_partition_start(spark, sf):
    rows = scan.scan(spark, _stored(spark, sf))
    return scan.in_range(rows, scan.day_offset("2024-01-20", -12), "2024-01-20", "event_dt").select(*_TOUCH.split(", "))


@query(
    "scan_runtime_days",
    with_views(
        f"SELECT {_TOUCH} FROM touch WHERE event_dt IN (SELECT created_dt FROM outcome WHERE item_id = 7 AND created_dt < DATE '2024-01-15')",
        "touch", "outcome",
    ),
)
def scan_runtime_days(spark, sf):
    chosen = b.outcomes(spark, sf).where("item_id = 7 AND created_dt < DATE '2024-01-15'")
    days = chosen.select(F.col("created_dt").alias("event_dt"))
    return scan.of_days(scan.scan(spark, _stored(spark, sf)), days, "event_dt").select(*_TOUCH.split(", "))


@query(
    "lookup_file",
    with_views("SELECT event_id, channel_id, channel_name, big_rock FROM touch LEFT JOIN rotation USING (rotation_id)", "touch", "rotation"),
)
def lookup_file(spark, sf):
    """The rotation lookup as a headerless text file."""
    out = sinks.scratch(spark, "rotation")
    sinks.write_tsv(b.rotation_lookup(spark, sf).select("rotation_id", "big_rock"), out)
    rocks = lookups.read_tsv_lookup(spark, out)
    return lookups.with_lookup(b.touches(spark, sf), rocks, "rotation_id").select("event_id", "channel_id", "channel_name", "big_rock")


@query("sink_partitioned_rerun", with_views(f"SELECT {_TOUCH} FROM touch", "touch"))
def sink_partitioned_rerun(spark, sf):
    """Some days were written with other rows before."""
    out, rows = sinks.scratch(spark, "rerun"), _touches(spark, sf)
    sinks.write_partitioned(rows.withColumn("user_id", F.lit(-1).cast("bigint")).where("event_dt < '2024-01-08'"), out, ["event_dt"])
    sinks.write_partitioned(rows, out, ["event_dt"])
    return spark.read.parquet(out).select(*_TOUCH.split(", "))


@query("sink_partitioned_append", with_views(f"SELECT {_TOUCH} FROM touch UNION ALL SELECT {_TOUCH} FROM touch WHERE user_id = 0", "touch"))
def sink_partitioned_append(spark, sf):
    out, rows = sinks.scratch(spark, "append"), _touches(spark, sf)
    sinks.write_partitioned(rows, out, ["event_dt"])
    sinks.write_partitioned(rows.where("user_id = 0"), out, ["event_dt"], mode="append")
    return spark.read.parquet(out).select(*_TOUCH.split(", "))


@query("sink_parquet", with_views(f"SELECT {_TOUCH} FROM touch WHERE channel_name IS NULL", "touch"))
def sink_parquet(spark, sf):
    out, rows = sinks.scratch(spark, "parquet"), _touches(spark, sf)
    sinks.write_parquet(rows, out)
    sinks.write_parquet(rows.where("channel_name IS NULL"), out)
    return spark.read.parquet(out)


@query("sink_tsv", with_views("SELECT event_id, event_dt, user_id, cguid, channel_name FROM touch", "touch"))
def sink_tsv(spark, sf):
    """Text with ``\\N`` for missing values, a directory per day."""
    out = sinks.scratch(spark, "tsv")
    sinks.write_tsv(_touches(spark, sf).drop("event_ts"), out, null="\\N", by=["event_dt"])
    schema = "event_id bigint, user_id bigint, cguid string, channel_name string, event_dt date"
    return spark.read.csv(out, sep="\t", schema=schema, nullValue="\\N").select("event_id", "event_dt", "user_id", "cguid", "channel_name")


@query("stage_by_day", with_views(f"SELECT {_TOUCH} FROM touch WHERE user_id > 5", "touch"))
def stage_by_day(spark, sf):
    out, rows = sinks.scratch(spark, "staged"), _touches(spark, sf)
    sinks.stage(rows, out, by=["event_dt"])
    return sinks.stage(rows.where("user_id > 5"), out, by=["event_dt"]).select(*_TOUCH.split(", "))


_SESSION_ROWS = """SELECT guid, cguid, parent_uid AS user_id,
    cast(session_skey AS VARCHAR) || guid || cast(site_id AS VARCHAR) || cast(cobrand AS VARCHAR) AS event_id,
    device_type_level1, vi_cnt AS flex_column_6, session_start_dt AS dt FROM sess WHERE traffic_source_id IN (1,2,3)"""


@query("export_backfill", with_views(_SESSION_ROWS, "sess"))
def export_backfill(spark, sf):
    """The organic export after a day was lost, one was cut short, one was changed, and the backfill found them."""
    source, out = sinks.scratch(spark, "sessions"), sinks.scratch(spark, "organic")
    sinks.write_parquet(b.sessions(spark, sf), source)
    start, end = (str(d) for d in spark.read.parquet(source).agg(F.min("session_start_dt"), F.max("session_start_dt")).first())
    jobs.export_organic_touches(spark, source, out, start, end)
    rows = jobs.organic_touches(spark.read.parquet(source))
    written = sorted(r["dt"] for r in rows.select("dt").distinct().collect())
    lost, short, changed = written[0], written[1], written[-1]
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/dt={lost}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    sinks.write_tsv(rows.where((F.col("dt") == short) & (F.crc32("event_id") % 2 == 0)), out, null="\\N", by=["dt"])
    sinks.write_tsv(rows.where(F.col("dt") == changed).withColumn("user_id", F.lit(-1)), out, null="\\N", by=["dt"])
    jobs.backfill_organic_touches(spark, source, out, start, end)
    back = spark.read.csv(out, sep="\t", schema=rows.schema, nullValue="\\N")
    return back.select("guid", "cguid", "user_id", "event_id", "device_type_level1", "flex_column_6", "dt")


_SAMPLED = "cast('0x' || substr(md5(concat_ws('|', '11', guid, CAST(session_skey AS VARCHAR), CAST(site_id AS VARCHAR))), 1, 8) AS BIGINT) / 4294967296.0"


@query(
    "bernoulli_sample",
    with_views(f"SELECT guid, session_skey, site_id FROM sess WHERE {_SAMPLED} < CASE site_id WHEN 3 THEN 0.5 WHEN 77 THEN 0.005 ELSE 0.2 END", "sess"),
)
def bernoulli_sample(spark, sf):
    rows = b.sessions(spark, sf).repartition(7)
    return scan.bernoulli_sample(rows, 0.2, 11, SESSION_KEYS, "site_id", {3: 0.5, 77: 0.005}).select("guid", "session_skey", "site_id")


@query("lookback_broadcast", _one_key("uid"))
def lookback_broadcast(spark, sf):
    return _lookback(spark, sf, CHECKOUT_KEYS[0], broadcast_anchors=True)
