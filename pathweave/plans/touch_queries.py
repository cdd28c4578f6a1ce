"""Scans, projections and filters over touches and outcomes."""

from pyspark.sql import functions as F

from ..functions import keys, labels
from ..functions import values as v
from ..operators.sets import without
from ..sources import lookups, scan
from . import bindings as b
from . import jobs
from .registry import query, with_views

_START, _END = "2024-01-05", "2024-01-20"


@query(
    "scan_date_range",
    with_views(f"SELECT event_id, event_dt, user_id FROM touch WHERE event_dt BETWEEN DATE '{_START}' AND DATE '{_END}'", "touch"),
)
def scan_date_range(spark, sf):
    return scan.in_range(b.touches(spark, sf), _START, _END, "event_dt").select("event_id", "event_dt", "user_id")


@query(
    "scan_derived_start",
    with_views(
        "SELECT event_id, event_dt FROM touch WHERE event_dt BETWEEN DATE '2024-02-15' - 40 AND DATE '2024-02-15'", "touch"
    ),
)
def scan_derived_start(spark, sf):
    first = scan.day_offset("2024-02-15", -40)
    return scan.in_range(b.touches(spark, sf), first, F.lit("2024-02-15"), "event_dt").select("event_id", "event_dt")


@query(
    "scan_outcome_slack",
    with_views(
        """SELECT 'checkout' AS source, transaction_id AS id, created_dt AS dt FROM outcome
           WHERE created_dt BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' + 2
           UNION ALL
           SELECT 'intent', intent_id, dt FROM intent
           WHERE dt BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' + 1""",
        "outcome", "intent",
    ),
)
def scan_outcome_slack(spark, sf):
    start, end = "2024-01-10", "2024-01-20"
    checkouts = scan.in_range(b.outcomes(spark, sf), start, scan.day_offset(end, 2), "created_dt")
    wishes = scan.in_range(b.intents(spark, sf), start, scan.day_offset(end, 1), "dt")
    return checkouts.select(
        F.lit("checkout").alias("source"), F.col("transaction_id").alias("id"), F.col("created_dt").alias("dt")
    ).unionByName(wishes.select(F.lit("intent").alias("source"), F.col("intent_id").alias("id"), "dt"))


@query(
    "null_defaults_distinct",
    with_views(
        """SELECT DISTINCT user_id, coalesce(channel_id, -1) AS channel_id, coalesce(channel_name, 'Unassigned') AS channel_name,
           coalesce(device_type_level1, 'unknown') AS device_type_level1, coalesce(incdata_id, '') AS incdata_id FROM touch""",
        "touch",
    ),
)
def null_defaults_distinct(spark, sf):
    defaults = {"channel_id": -1, "channel_name": "Unassigned", "device_type_level1": "unknown", "incdata_id": ""}
    return labels.with_defaults(b.touches(spark, sf).select("user_id", *defaults), defaults).distinct()


@query(
    "event_label",
    with_views(
        """SELECT event_id,
           CASE WHEN event_type_id IN (1,5,7,8) THEN 'click' WHEN event_type_id = 4 THEN 'impression' WHEN event_type_id = 6 THEN 'open' ELSE 'undefined' END AS full_label,
           CASE WHEN event_type_id IN (1,5,7,8) THEN 'click' WHEN event_type_id = 6 THEN 'open' ELSE 'undefined' END AS short_label,
           CASE WHEN event_type_id IN (1,5,7,8) THEN 'click_' || coalesce(channel_name, 'Unassigned')
                WHEN event_type_id IN (4,6) THEN 'open_' || coalesce(channel_name, 'Unassigned') ELSE 'unknown' END AS channel_event,
           event_type_id IN (1,5,7) AS is_click
           FROM touch""",
        "touch",
    ),
)
def event_label(spark, sf):
    return b.touches(spark, sf).select(
        "event_id",
        labels.event_label(style="full").alias("full_label"),
        labels.event_label(style="no_impression").alias("short_label"),
        labels.channel_event().alias("channel_event"),
        F.col("event_type_id").isin(*v.DASHBOARD_CLICKS).alias("is_click"),
    )


@query(
    "touch_device",
    with_views(
        """SELECT event_id,
           CASE WHEN event_type_id = 4 AND channel_id = 1 AND device_type_level1 IS NULL THEN 'PC' ELSE coalesce(device_type_level1, 'unknown') END AS device,
           CASE WHEN event_type_id = 4 AND channel_id = 1 THEN 'PC' ELSE coalesce(device_type_level1, 'unknown') END AS display_device
           FROM touch""",
        "touch",
    ),
)
def touch_device(spark, sf):
    return b.touches(spark, sf).select(
        "event_id",
        labels.touch_device().alias("device"),
        labels.touch_device(only_missing=False).alias("display_device"),
    )


@query(
    "outcome_device",
    with_views(
        """SELECT transaction_id, CASE bbowa_device_type WHEN 'PC' THEN 'PC' WHEN 'PC: Touch' THEN 'PC' WHEN 'Phone' THEN 'Mobile'
           WHEN 'Tablet' THEN 'Tablet' ELSE CASE WHEN bbowa_device_type IS NULL THEN 'unknown' ELSE 'others' END END AS bbowa_device FROM outcome""",
        "outcome",
    ),
)
def outcome_device(spark, sf):
    return b.outcomes(spark, sf).select("transaction_id", labels.outcome_device().alias("bbowa_device"))


@query(
    "sub_channel",
    with_views(
        """SELECT event_id, CASE WHEN channel_name = 'epn' THEN flex_column_1 WHEN channel_name = 'Display' THEN big_rock ELSE '' END AS sub_channel
           FROM touch LEFT JOIN rotation USING (rotation_id)""",
        "touch", "rotation",
    ),
)
def sub_channel(spark, sf):
    named = lookups.with_lookup(b.touches(spark, sf), b.rotation_lookup(spark, sf), "rotation_id")
    return named.select("event_id", labels.sub_channel().alias("sub_channel"))


@query(
    "channel_token",
    with_views(
        """SELECT event_id, coalesce(channel_name, 'unassigned') || '#' ||
           CASE WHEN event_type_id IN (1,5,7,8) THEN 'click' WHEN event_type_id = 4 THEN 'impression' WHEN event_type_id = 6 THEN 'open' ELSE 'undefined' END
           || '#' || CASE WHEN event_type_id = 4 AND channel_id = 1 AND device_type_level1 IS NULL THEN 'PC' ELSE coalesce(device_type_level1, 'unknown') END AS token
           FROM touch""",
        "touch",
    ),
)
def channel_token(spark, sf):
    return b.touches(spark, sf).select("event_id", labels.channel_token().alias("token"))


@query(
    "valid_keys",
    with_views(
        """SELECT event_id, coalesce(user_id > 0, false) AS has_uid,
           coalesce(length(device_id) >= 35 AND device_id NOT LIKE '%00000000-0000-0000-0000-000000000000%', false) AS has_did,
           cguid IS NOT NULL AS has_cguid, incdata_id IS NOT NULL AS has_xid FROM touch""",
        "touch",
    ),
)
def valid_keys(spark, sf):
    def usable(column, kind):
        return keys.usable_key(column, kind).isNotNull()

    return b.touches(spark, sf).select(
        "event_id",
        usable("user_id", "id").alias("has_uid"),
        usable("device_id", "device").alias("has_did"),
        usable("cguid", "text").alias("has_cguid"),
        usable("incdata_id", "text").alias("has_xid"),
    )


@query(
    "click_touches",
    with_views("SELECT event_id, event_type_id, channel_name FROM touch WHERE event_type_id IN (1,5,8)", "touch"),
)
def click_touches(spark, sf):
    clicks = F.col("event_type_id").isin(*v.SESSION_CLICKS)
    return b.touches(spark, sf).where(clicks).select("event_id", "event_type_id", "channel_name")


@query(
    "paid_touches",
    with_views("SELECT event_id, channel_name FROM touch WHERE channel_name NOT IN ('organic', 'site_emails')", "touch"),
)
def paid_touches(spark, sf):
    paid = ~F.col("channel_name").isin(*v.ORGANIC_CHANNELS)
    return b.touches(spark, sf).where(paid).select("event_id", "channel_name")


@query(
    "organic_touches",
    with_views(
        """SELECT guid, cguid, parent_uid AS user_id,
           cast(session_skey AS VARCHAR) || guid || cast(site_id AS VARCHAR) || cast(cobrand AS VARCHAR) AS event_id,
           5 AS event_id_type, 8 AS event_type_id, 0 AS channel_id, 'organic' AS channel_name,
           session_start_dt AS event_dt, start_timestamp AS event_ts, device_type_level1, device_type_level2,
           vi_cnt AS flex_column_6, 'organic' AS data_source, session_start_dt AS dt
           FROM sess WHERE traffic_source_id IN (1,2,3)""",
        "sess",
    ),
)
def organic_touches(spark, sf):
    return jobs.organic_touches(b.sessions(spark, sf)).select(
        "guid", "cguid", "user_id", "event_id", "event_id_type", "event_type_id", "channel_id", "channel_name", "event_dt",
        "event_ts", "device_type_level1", "device_type_level2", "flex_column_6", "data_source", "dt",
    )


@query(
    "missing_partitions",
    with_views(
        """SELECT cast(d AS DATE) AS dt FROM generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-05', INTERVAL 1 day) AS s(d)
           WHERE cast(d AS DATE) NOT IN (SELECT dt FROM ev)""",
    ),
)
def missing_partitions(spark, sf):
    return scan.missing_days(b.events(spark, sf), "2023-12-25", "2024-02-05")


@query(
    "pct_table_parse",
    with_views(
        """SELECT channel_name, event_type_id AS day_diff, round(floor(1000.0 * count(*) / sum(count(*)) OVER (PARTITION BY channel_name)) / 10.0, 1) AS prcnt_dist
           FROM (SELECT coalesce(channel_name, 'Unassigned') AS channel_name, event_type_id FROM touch) GROUP BY channel_name, event_type_id""",
        "touch",
    ),
)
def pct_table_parse(spark, sf):
    named = b.touches(spark, sf).select(F.coalesce("channel_name", F.lit("Unassigned")).alias("channel_name"), "event_type_id")
    codes = (1, 4, 6, 8)
    counts = named.groupBy("channel_name").agg(
        F.count(F.lit(1)).alias("total"), *[F.count(F.when(F.col("event_type_id") == c, 1)).alias(f"n{c}") for c in codes]
    )
    wide = counts.select(
        "channel_name",
        *[
            F.expr(f"case when n{c} > 0 then concat(n{c}*1000 div total div 10, '.', (n{c}*1000 div total) % 10, '%') end").alias(str(c))
            for c in codes
        ],
    )
    return lookups.percent_table(wide, "channel_name").where("prcnt_dist IS NOT NULL")


@query(
    "hash_sample",
    with_views(
        "SELECT event_id, user_id FROM touch WHERE cast('0x' || substr(md5(cast(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 = 0", "touch"
    ),
)
def hash_sample(spark, sf):
    return scan.key_sample(b.touches(spark, sf), "user_id", 5).select("event_id", "user_id")


@query(
    "lookup_join",
    with_views(
        """SELECT event_id, channel_id, channel_name, big_rock FROM touch LEFT JOIN rotation USING (rotation_id)""",
        "touch", "rotation",
    ),
)
def lookup_join(spark, sf):
    rows = b.touches(spark, sf).drop("channel_name")
    named = lookups.with_lookup(rows, lookups.channel_lookup(spark), "channel_id", small=True)
    rocks = lookups.with_lookup(named, b.rotation_lookup(spark, sf), "rotation_id")
    return rocks.select("event_id", "channel_id", "channel_name", "big_rock")


@query(
    "unlisted_channels",
    with_views("SELECT event_id, channel_name FROM touch WHERE channel_name NOT IN ('Display', 'epn') OR channel_name IS NULL", "touch"),
)
def unlisted_channels(spark, sf):
    named = b.touches(spark, sf).select("event_id", "channel_name")
    listed = lookups.channel_lookup(spark).where(F.col("channel_name").isin("Display", "epn")).select("channel_name")
    return without(named, listed, "channel_name")
