"""De-duplication and identity resolution."""

from pyspark.sql import functions as F

from ..operators import identity, paths
from ..operators.dedup import keep_first
from . import bindings as b
from .jobs import CHECKOUT_KEYS, CLICK_ORDER, DEVICE_ORDER, match_followers, order_of, valid_matches
from .link_queries import _CHECKOUT, _KEY_SQL, _lookback_rows, merged, merged_sql
from .registry import good_device, query, with_views

_CLICK_COLUMNS = ("event_id", "transaction_id", "item_id", "channel_name", *CLICK_ORDER)


def _nulls_first(*columns: str) -> str:
    return ", ".join(f"{c} ASC NULLS FIRST" for c in columns)


def _first(source: str, keys: str, order: str, columns: str) -> str:
    return f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1"""


@query(
    "dedup_clicks",
    with_views(
        _first(
            "(" + " UNION ALL ".join(
                f"SELECT a.*, b.transaction_id, b.item_id, '{k}' AS strategy FROM touch a JOIN outcome b ON {_KEY_SQL[k]} WHERE {_CHECKOUT} AND a.event_type_id IN (1,5,8)"
                for k in ("uid", "did", "cguid")
            ) + ")",
            "event_id, item_id, transaction_id", _nulls_first(*CLICK_ORDER) + ", strategy", ", ".join((*_CLICK_COLUMNS, "strategy")),
        ),
        "touch", "outcome",
    ),
)
def dedup_clicks(spark, sf):
    every = None
    for key in CHECKOUT_KEYS[:3]:
        found = _lookback_rows(spark, sf, key).where(F.col("event_type_id").isin(1, 5, 8))
        every = found if every is None else every.unionByName(found)
    rows = every.withColumnRenamed("join_strategy", "strategy").select(*_CLICK_COLUMNS, "strategy")
    return keep_first(rows, ["event_id", "item_id", "transaction_id"], [*order_of(rows, CLICK_ORDER), "strategy"])


@query(
    "dedup_volume",
    _first(
        "lineitem", "l_orderkey, l_linenumber",
        _nulls_first("l_returnflag", "l_linestatus", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity"),
        "l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate, l_partkey, l_suppkey, l_quantity",
    ),
)
def dedup_volume(spark, sf):
    order = ["l_returnflag", "l_linestatus", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity"]
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", *order)
    return keep_first(rows, ["l_orderkey", "l_linenumber"], order)


_SESSION_ROW = ("guid", "session_skey", "site_id", "cobrand", *DEVICE_ORDER, "seqnum")


@query(
    "dedup_sessions",
    with_views(
        _first("item", "guid, session_skey, site_id, cobrand", _nulls_first(*DEVICE_ORDER) + ", seqnum", ", ".join(_SESSION_ROW)), "item"
    ),
)
def dedup_sessions(spark, sf):
    rows = b.item_views(spark, sf).select(*_SESSION_ROW)
    return keep_first(rows, ["guid", "session_skey", "site_id", "cobrand"], [*order_of(rows, DEVICE_ORDER), "seqnum"])


@query(
    "dedup_items",
    with_views(
        _first("item", "guid, session_skey, item_id", _nulls_first(*DEVICE_ORDER) + ", seqnum", ", ".join((*_SESSION_ROW, "item_id"))), "item"
    ),
)
def dedup_items(spark, sf):
    rows = b.item_views(spark, sf).select(*_SESSION_ROW, "item_id")
    return keep_first(rows, ["guid", "session_skey", "item_id"], [*order_of(rows, DEVICE_ORDER), "seqnum"])


@query(
    "dedup_sessions_two_keys",
    with_views(_first("item", "guid, session_skey", _nulls_first(*DEVICE_ORDER) + ", seqnum", ", ".join(_SESSION_ROW)), "item"),
)
def dedup_sessions_two_keys(spark, sf):
    rows = b.item_views(spark, sf).select(*_SESSION_ROW)
    return keep_first(rows, ["guid", "session_skey"], [*order_of(rows, DEVICE_ORDER), "seqnum"])


@query(
    "dedup_items_seqnum",
    with_views(
        _first("item", "guid, session_skey, item_id, seqnum", _nulls_first(*DEVICE_ORDER), ", ".join((*_SESSION_ROW, "item_id"))), "item"
    ),
)
def dedup_items_seqnum(spark, sf):
    rows = b.item_views(spark, sf).select(*_SESSION_ROW, "item_id")
    return keep_first(rows, ["guid", "session_skey", "item_id", "seqnum"], order_of(rows, DEVICE_ORDER))


@query(
    "dedup_nulls_last",
    with_views(
        _first(
            "item", "guid, session_skey, site_id, cobrand",
            "nullif(user_id, 0) ASC NULLS LAST, " + _nulls_first(*DEVICE_ORDER) + ", seqnum", ", ".join((*_SESSION_ROW, "user_id")),
        ),
        "item",
    ),
)
def dedup_nulls_last(spark, sf):
    rows = b.item_views(spark, sf).select(*_SESSION_ROW, "user_id")
    known = F.nullif("user_id", F.lit(0)).asc_nulls_last()
    return keep_first(
        rows, ["guid", "session_skey", "site_id", "cobrand"], [known, *order_of(rows, DEVICE_ORDER), "seqnum"]
    )


@query(
    "dedup_desc",
    with_views(
        _first(
            "touch", "user_id, coalesce(channel_name, 'Unassigned')",
            "device_id DESC NULLS LAST, " + _nulls_first("experience_level2", "flex_column_3", "flex_column_1") + ", event_id",
            "user_id, coalesce(channel_name, 'Unassigned') AS channel_name, event_id, device_id, experience_level2, flex_column_3, flex_column_1",
        ),
        "touch",
    ),
)
def dedup_desc(spark, sf):
    rows = b.touches(spark, sf).select(
        "user_id", F.coalesce("channel_name", F.lit("Unassigned")).alias("channel_name"),
        "event_id", "device_id", "experience_level2", "flex_column_3", "flex_column_1",
    )
    order = [F.col("device_id").desc(), *order_of(rows, ("experience_level2", "flex_column_3", "flex_column_1")), "event_id"]
    return keep_first(rows, ["user_id", "channel_name"], order)


@query(
    "dedup_pairs",
    with_views(
        _first(
            """(SELECT b.guid AS sess_guid, b.session_skey AS sess_session_skey, a.event_id, a.device_type_level1, a.device_type_level2,
                a.experience_level1, a.experience_level2 FROM touch a JOIN item b ON a.user_id = b.user_id AND a.event_dt = b.view_dt AND a.user_id > 0)""",
            "sess_guid, sess_session_skey, event_id", _nulls_first(*DEVICE_ORDER),
            ", ".join(("sess_guid", "sess_session_skey", "event_id", *DEVICE_ORDER)),
        ),
        "touch", "item",
    ),
)
def dedup_pairs(spark, sf):
    clicks = b.touches(spark, sf).where("user_id > 0").select("user_id", "event_dt", "event_id", *DEVICE_ORDER)
    views = b.item_views(spark, sf).select(
        "user_id", F.col("view_dt").alias("event_dt"),
        F.col("guid").alias("sess_guid"), F.col("session_skey").alias("sess_session_skey"),
    )
    pairs = clicks.join(views, ["user_id", "event_dt"]).drop("user_id", "event_dt")
    return keep_first(pairs, ["sess_guid", "sess_session_skey", "event_id"], order_of(pairs, DEVICE_ORDER))


def _maps(spark, sf, *names):
    known = {
        "uid": lambda c: identity.IdentityMap("uid", c, "id", b.uid_map(spark, sf), "incdata_srcid"),
        "did": lambda c: identity.IdentityMap("did", c, "device", b.did_map(spark, sf), "did"),
        "cguid": lambda c: identity.IdentityMap("cguid", c, "text", b.cguid_map(spark, sf), "cguid"),
    }
    return [known[name](column) for name, column in names]


def _resolve_sql(source: str, ids: str, user: str | None, device: str | None, label: str) -> str:
    joins, people, names = [], [], []
    if user:
        joins.append(f"LEFT JOIN uid_map u ON s.{user} = u.incdata_srcid AND s.{user} > 0")
        people.append("u.incdata_id")
        names.append("WHEN u.incdata_id IS NOT NULL THEN 'uid'")
    if device:
        joins.append(f"LEFT JOIN did_map d ON s.{device} = d.did AND {good_device('s.' + device)}")
        people.append("d.incdata_id")
        names.append("WHEN d.incdata_id IS NOT NULL THEN 'did'")
    joins.append("LEFT JOIN cguid_map c ON s.cguid = c.cguid")
    people.append("c.incdata_id")
    names.append("WHEN c.incdata_id IS NOT NULL THEN 'cguid'")
    picked = ", ".join(f"s.{i}" for i in ids.split(", "))
    return f"SELECT DISTINCT {picked}, coalesce({', '.join(people)}) AS incdata_id, CASE {' '.join(names)} ELSE {label} END AS join_strategy FROM {source} s {' '.join(joins)}"


@query(
    "resolve_session_xid",
    with_views(
        _resolve_sql("sess", "guid, session_skey, site_id, cobrand", "parent_uid", "device_id", "'nojoin'"),
        "sess", "uid_map", "did_map", "cguid_map",
    ),
)
def resolve_session_xid(spark, sf):
    key = ["guid", "session_skey", "site_id", "cobrand"]
    maps = _maps(spark, sf, ("uid", "parent_uid"), ("did", "device_id"), ("cguid", "cguid"))
    return identity.resolve_identity(b.sessions(spark, sf), maps, key).select(*key, "incdata_id", "join_strategy")


@query(
    "resolve_unregistered_xid",
    with_views(
        _resolve_sql("sess", "guid, session_skey, site_id, cobrand", None, "device_id", "'nojoin'"),
        "sess", "did_map", "cguid_map",
    ),
)
def resolve_unregistered_xid(spark, sf):
    key = ["guid", "session_skey", "site_id", "cobrand"]
    maps = _maps(spark, sf, ("did", "device_id"), ("cguid", "cguid"))
    return identity.resolve_identity(b.sessions(spark, sf), maps, key).select(*key, "incdata_id", "join_strategy")


@query(
    "resolve_signed_session_xid",
    with_views(
        _resolve_sql("sess", "guid, session_skey, site_id, cobrand", "signed_uid", None, "'nojoin'"),
        "sess", "uid_map", "cguid_map",
    ),
)
def resolve_signed_session_xid(spark, sf):
    key = ["guid", "session_skey", "site_id", "cobrand"]
    maps = _maps(spark, sf, ("uid", "signed_uid"), ("cguid", "cguid"))
    return identity.resolve_identity(b.sessions(spark, sf), maps, key).select(*key, "incdata_id", "join_strategy")


@query(
    "dedup_session_xid",
    with_views(
        _first(
            "found", "guid, session_skey, site_id, cobrand, incdata_id",
            _nulls_first("device_type_level1", "device_type_level2"),
            "guid, session_skey, site_id, cobrand, device_type_level1, device_type_level2, incdata_id, join_strategy",
        ),
        "sess", "uid_map", "did_map", "cguid_map",
        extra={
            "found": _resolve_sql(
                "sess", "guid, session_skey, site_id, cobrand, device_type_level1, device_type_level2", "parent_uid", "device_id", "'nojoin'"
            )
        },
    ),
)
def dedup_session_xid(spark, sf):
    key = ["guid", "session_skey", "site_id", "cobrand"]
    maps = _maps(spark, sf, ("uid", "parent_uid"), ("did", "device_id"), ("cguid", "cguid"))
    found = identity.resolve_identity(b.sessions(spark, sf), maps, key)
    order = order_of(found, ("device_type_level1", "device_type_level2"))
    return keep_first(found, [*key, "incdata_id"], order).select(
        *key, "device_type_level1", "device_type_level2", "incdata_id", "join_strategy"
    )


@query(
    "resolve_item_xid",
    with_views(
        _resolve_sql("item", "guid, session_skey, item_id, seqnum", "user_id", None, "NULL"), "item", "uid_map", "cguid_map"
    ),
)
def resolve_item_xid(spark, sf):
    key = ["guid", "session_skey", "item_id", "seqnum"]
    maps = _maps(spark, sf, ("uid", "user_id"), ("cguid", "cguid"))
    return identity.resolve_identity(b.item_views(spark, sf), maps, key, unresolved=None).select(
        *key, "incdata_id", "join_strategy"
    )


@query(
    "anonymous_sessions",
    with_views(
        f"""SELECT guid, session_skey, cguid, device_id FROM sess
            WHERE NOT EXISTS (SELECT 1 FROM cguid_map m WHERE m.cguid = sess.cguid)
            AND (device_id LIKE '%00000000-0000-0000-0000-000000000000%'
                 OR ({good_device('device_id')} AND NOT EXISTS (SELECT 1 FROM did_map d WHERE d.did = sess.device_id)))""",
        "sess", "cguid_map", "did_map",
    ),
)
def anonymous_sessions(spark, sf):
    found = identity.anonymous(b.sessions(spark, sf), b.cguid_map(spark, sf), b.did_map(spark, sf), ["guid", "session_skey"])
    return found.select("guid", "session_skey", "cguid", "device_id")


@query(
    "two_key_join",
    """SELECT slr_id, elig_leaf_categ_id, follower_id FROM
       (SELECT DISTINCT l_suppkey AS slr_id, l_partkey%25 AS elig_leaf_categ_id FROM lineitem) a
       JOIN (SELECT c_custkey AS follower_id, c_custkey%100 AS flwd_user_id, c_custkey%25 AS leaf_categ_id FROM customer) b
       ON a.slr_id = b.flwd_user_id AND a.elig_leaf_categ_id = b.leaf_categ_id""",
)
def two_key_join(spark, sf):
    return match_followers(b.listings(spark, sf), b.followers(spark, sf)).select(
        "slr_id", "elig_leaf_categ_id", "follower_id"
    )


@query(
    "valid_matches",
    merged_sql("SELECT event_id, transaction_id, item_id FROM merged WHERE transaction_id IS NOT NULL AND item_id IS NOT NULL AND event_type_id <> 4"),
)
def valid(spark, sf):
    return valid_matches(merged(spark, sf)).select("event_id", "transaction_id", "item_id")


@query(
    "mobile_only",
    merged_sql(
        """SELECT event_id, transaction_id, item_id, device_type_level1 FROM merged WHERE event_type_id <> 4 AND (transaction_id, item_id) IN (
           SELECT (transaction_id, item_id) FROM merged WHERE event_type_id <> 4 GROUP BY transaction_id, item_id
           HAVING list_sort(list(DISTINCT device_type_level1) FILTER (device_type_level1 IS NOT NULL)) = ['Mobile'])"""
    ),
)
def mobile_only(spark, sf):
    return paths.exact_device_outcomes(valid_matches(merged(spark, sf))).select(
        "event_id", "transaction_id", "item_id", "device_type_level1"
    )
