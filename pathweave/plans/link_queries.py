"""Look-back joins and their merges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import values as v
from ..functions.clock import lag_columns
from ..operators import lookback as lb
from ..operators.touch_store import TouchStore
from ..sources.sinks import scratch
from . import bindings as b
from .jobs import CHECKOUT_KEYS, OUTCOME_SIDE, SESSION_KEYS, SESSION_SIDE, TOUCH_SIDE
from .registry import good_device, in_window, query, sec, with_views

PAIR = ("event_id", "transaction_id", "item_id")

_CHECKOUT = in_window("a.event_ts", "a.event_dt", "b.created_time", "b.created_dt", 24, 25)
_KEY_SQL = {
    "uid": "a.user_id = b.buyer_id AND a.user_id > 0",
    "did": f"a.device_id = b.cko_device_id AND {good_device('a.device_id')}",
    "cguid": "a.cguid = b.bbowa_cguid",
    "xid": "a.incdata_id = b.cko_incdata_id",
}


def merged(spark, sf) -> DataFrame:
    """Touches linked to checkouts by all four keys."""
    linked = lb.link(
        b.touches(spark, sf), b.outcomes(spark, sf), CHECKOUT_KEYS, lb.CHECKOUT, TOUCH_SIDE, OUTCOME_SIDE
    )
    return linked.withColumns(
        {
            **lag_columns("created_time", "event_ts", "cko", "is_before_checkout"),
            **lag_columns("bbowa_event_timestamp", "event_ts", "bbowa", "is_before_bbowa"),
            "day_diff": F.datediff("created_dt", "event_dt"),
        }
    )


def _ranked(keys: dict[str, str], ids: str, left: str, right: str, window: str) -> str:
    """SQL: the strongest key of each linked pair."""
    parts = [f"SELECT {ids}, {i} AS rk FROM {left} a JOIN {right} b ON {on} WHERE {window}" for i, on in enumerate(keys.values())]
    names = ", ".join(f"'{k}'" for k in keys)
    group = ", ".join(c.split(".")[1] for c in ids.split(", "))
    return f"SELECT {group}, [{names}][min(rk) + 1] AS join_strategy FROM ({' UNION ALL '.join(parts)}) GROUP BY {group}"


# SQL: one row per touch and checkout with all columns of both
MERGED_SQL = {
    "linked": _ranked(_KEY_SQL, "a.event_id, b.transaction_id, b.item_id", "touch", "outcome", _CHECKOUT),
    "merged": f"""SELECT t.*, o.*, l.join_strategy,
        {sec('o.created_time')} - {sec('t.event_ts')} AS cko_sec_diff,
        {sec('o.bbowa_event_timestamp')} - {sec('t.event_ts')} AS bbowa_sec_diff,
        CAST(datediff('day', t.event_dt, o.created_dt) AS INT) AS day_diff
        FROM linked l JOIN touch t ON l.event_id = t.event_id JOIN outcome o ON l.transaction_id = o.transaction_id""",
}


def merged_sql(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    return with_views(body, "touch", "outcome", *views, extra={**MERGED_SQL, **(extra or {})})


def _one_key(name: str) -> str:
    return with_views(
        f"""SELECT a.event_id, b.transaction_id, b.item_id, '{name}' AS join_strategy,
            {sec('b.created_time')} - {sec('a.event_ts')} AS cko_sec_diff
            FROM touch a JOIN outcome b ON {_KEY_SQL[name]} WHERE {_CHECKOUT}""",
        "touch", "outcome",
    )


def _lookback_rows(spark, sf, key, **options):
    return lb.lookback_join(
        b.touches(spark, sf), b.outcomes(spark, sf), key, lb.CHECKOUT, TOUCH_SIDE, OUTCOME_SIDE, **options
    )


def _lookback(spark, sf, key, **options):
    found = _lookback_rows(spark, sf, key, **options)
    diff = lag_columns("created_time", "event_ts", "cko")["cko_sec_diff"]
    return found.select(*PAIR, "join_strategy", diff.alias("cko_sec_diff"))


def _register_single_keys():
    for key in CHECKOUT_KEYS:
        query(f"lookback_{key.name}", _one_key(key.name))(lambda spark, sf, key=key: _lookback(spark, sf, key))


_register_single_keys()


@query("lookback_bucketed", _one_key("uid"))
def lookback_bucketed(spark, sf):
    return _lookback(spark, sf, CHECKOUT_KEYS[0], bucket_seconds=86400)


@query("lookback_salted", _one_key("xid"))
def lookback_salted(spark, sf):
    return _lookback(spark, sf, CHECKOUT_KEYS[3], min_rows=20)


@query(
    "lag_columns",
    merged_sql(
        """SELECT event_id, transaction_id, cko_sec_diff, round(cko_sec_diff / 86400.0::DOUBLE, 9) AS cko_day_diff,
           bbowa_sec_diff, round(bbowa_sec_diff / 86400.0::DOUBLE, 9) AS bbowa_day_diff,
           CASE WHEN cko_sec_diff > -600 THEN 1 ELSE 0 END AS is_before_checkout,
           CASE WHEN bbowa_sec_diff > -600 THEN 1 ELSE 0 END AS is_before_bbowa FROM merged"""
    ),
)
def lags(spark, sf):
    return merged(spark, sf).select(
        "event_id", "transaction_id", "cko_sec_diff", F.round("cko_day_diff", 9).alias("cko_day_diff"),
        "bbowa_sec_diff", F.round("bbowa_day_diff", 9).alias("bbowa_day_diff"), "is_before_checkout", "is_before_bbowa",
    )


_FULL_OUTER = {
    **{
        f"j_{name}": f"SELECT a.event_id, b.transaction_id, b.item_id, '{name}' AS s FROM touch a JOIN outcome b ON {on} WHERE {_CHECKOUT}"
        for name, on in _KEY_SQL.items()
    },
    **{
        name: f"""SELECT coalesce(a.event_id, b.event_id) AS event_id, coalesce(a.transaction_id, b.transaction_id) AS transaction_id,
        coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.s, b.s) AS s FROM {x} a FULL OUTER JOIN {y} b
        ON a.event_id = b.event_id AND a.item_id = b.item_id AND a.transaction_id = b.transaction_id"""
        for name, x, y in (("p1", "j_uid", "j_did"), ("p2", "j_cguid", "j_xid"), ("p3", "p1", "p2"))
    },
}


@query(
    "merge_matches_4",
    with_views("SELECT event_id, transaction_id, item_id, s AS join_strategy FROM p3", "touch", "outcome", extra=_FULL_OUTER),
)
def merge_matches_4(spark, sf):
    return merged(spark, sf).select(*PAIR, "join_strategy")


@query(
    "merge_single_matches",
    with_views("SELECT event_id, transaction_id, item_id, s AS join_strategy FROM p3", "touch", "outcome", extra=_FULL_OUTER),
)
def merge_single_matches(spark, sf):
    found = [_lookback(spark, sf, k).drop("join_strategy") for k in CHECKOUT_KEYS]
    return lb.merge_matches(found, [k.name for k in CHECKOUT_KEYS], PAIR).select(*PAIR, "join_strategy")


@query(
    "lookback_stored",
    with_views("SELECT event_id, transaction_id, item_id, s AS join_strategy FROM p3", "touch", "outcome", extra=_FULL_OUTER),
)
def lookback_stored(spark, sf):
    """From a store that was written in two goes, some days twice, the first time with other rows."""
    store = TouchStore(spark, scratch(spark, "touches"), CHECKOUT_KEYS, TOUCH_SIDE)
    rows = b.touches(spark, sf)
    again = F.col("event_dt") < "2024-01-11"
    store.write(rows.where(again).withColumn("user_id", F.lit(1).cast("long")))
    store.write(rows.where(again))
    store.write(rows.where(~again))
    return store.link(b.outcomes(spark, sf), lb.CHECKOUT, OUTCOME_SIDE).select(*PAIR, "join_strategy")


@query(
    "lookback_stored_days",
    with_views(
        "SELECT event_id, transaction_id, item_id, s AS join_strategy FROM p3 JOIN outcome USING (transaction_id, item_id) WHERE created_dt BETWEEN DATE '2024-01-20' AND DATE '2024-01-22'",
        "touch", "outcome", extra=_FULL_OUTER,
    ),
)
def lookback_stored_days(spark, sf):
    """The anchors of three days: reads the days of touches that their windows reach."""
    store = TouchStore(spark, scratch(spark, "touches"), CHECKOUT_KEYS, TOUCH_SIDE, min_rows=1000)
    store.write(b.touches(spark, sf))
    return store.link(b.outcomes(spark, sf), lb.CHECKOUT, OUTCOME_SIDE, "2024-01-20", "2024-01-22").select(*PAIR, "join_strategy")


_INTENT_KEYS = (
    lb.Key("uid", "user_id", "intent_user_id", "id"),
    lb.Key("did", "device_id", "intent_device_id", "device"),
    lb.Key("cguid", "cguid", "intent_cguid"),
    lb.Key("xid", "incdata_id", "intent_incdata_id"),
)


@query(
    "lookback_intent_30d",
    with_views(
        _ranked(
            {
                "uid": "a.user_id = b.intent_user_id AND a.user_id > 0",
                "did": f"a.device_id = b.intent_device_id AND {good_device('a.device_id')}",
                "cguid": "a.cguid = b.intent_cguid",
                "xid": "a.incdata_id = b.intent_incdata_id",
            },
            "a.event_id, b.intent_id", "touch", "intent",
            in_window("a.event_ts", "a.event_dt", "b.intent_ts", "b.dt", 30, 30),
        ),
        "touch", "intent",
    ),
)
def lookback_intent_30d(spark, sf):
    side = lb.Side("intent_ts", "dt", ("intent_id",))
    return lb.link(
        b.touches(spark, sf), b.intents(spark, sf), _INTENT_KEYS, lb.INTENT, TOUCH_SIDE, side
    ).select("event_id", "intent_id", "join_strategy")


_REG_WINDOW = in_window("a.event_ts", "a.event_dt", "b.user_cre_ts", "b.user_cre_dt", 14, 14)
_REG_SQL = {
    "did": f"a.device_id = b.reg_device_id AND {good_device('a.device_id')}",
    "cguid": "a.cguid = b.reg_cguid",
    "xid": "a.incdata_id = b.reg_incdata_id",
}


@query(
    "lookback_registration_14d",
    with_views(
        _ranked(_REG_SQL, "a.event_id, b.reg_user_id, b.user_cre_ts", "touch", "reg", _REG_WINDOW), "touch", "reg"
    ),
)
def lookback_registration_14d(spark, sf):
    keys = (
        lb.Key("did", "device_id", "reg_device_id", "device"),
        lb.Key("cguid", "cguid", "reg_cguid"),
        lb.Key("xid", "incdata_id", "reg_incdata_id"),
    )
    side = lb.Side("user_cre_ts", "user_cre_dt", ("reg_user_id", "user_cre_ts"))
    return lb.link(
        b.touches(spark, sf), b.registrations(spark, sf), keys, lb.REGISTRATION, TOUCH_SIDE, side
    ).select("event_id", "reg_user_id", "user_cre_ts", "join_strategy")


_CLICK = "(SELECT * FROM touch WHERE event_type_id IN (1,5,8))"
_SESS_WINDOW = in_window("a.event_ts", "a.event_dt", "b.start_timestamp", "b.session_start_dt", 14, 14)
_SESS_SQL = {
    "uid": "a.user_id = b.parent_uid AND a.user_id > 0",
    "did": f"a.device_id = b.device_id AND {good_device('a.device_id')}",
    "cguid": "a.cguid = b.cguid",
    "xid": "a.incdata_id = b.session_xid",
}
_SESS_IDS = "a.event_id, b.guid, b.session_skey"


def _to_sessions(spark, sf, names):
    clicks = b.touches(spark, sf).where(F.col("event_type_id").isin(*v.SESSION_CLICKS))
    anchors = labels.prefixed(b.sessions(spark, sf).withColumnRenamed("session_xid", "incdata_id"), "sess_")
    keys = [k for k in SESSION_KEYS if k.name in names]
    return lb.link(clicks, anchors, keys, lb.SESSION, TOUCH_SIDE, SESSION_SIDE).select(
        "event_id", F.col("sess_guid").alias("guid"), F.col("sess_session_skey").alias("session_skey"), "join_strategy"
    )


def _sessions_sql(*names: str) -> str:
    return with_views(
        _ranked({k: s for k, s in _SESS_SQL.items() if k in names}, _SESS_IDS, _CLICK, "sess", _SESS_WINDOW),
        "touch", "sess",
    )


@query("lookback_session_14d", _sessions_sql("uid", "did", "cguid", "xid"))
def lookback_session_14d(spark, sf):
    return _to_sessions(spark, sf, ("uid", "did", "cguid", "xid"))


@query("merge_matches_3", _sessions_sql("did", "cguid", "xid"))
def merge_matches_3(spark, sf):
    return _to_sessions(spark, sf, ("did", "cguid", "xid"))


@query("merge_matches_2", _sessions_sql("did", "cguid"))
def merge_matches_2(spark, sf):
    return _to_sessions(spark, sf, ("did", "cguid"))


_ITEM_WINDOW = in_window("a.event_timestamp", "a.view_dt", "b.start_timestamp", "b.session_start_dt", 14, 14, 0)


@query(
    "lookback_item_session",
    with_views(
        _ranked(
            {"uid": "a.user_id = b.parent_uid AND a.user_id > 0", "cguid": "a.cguid = b.cguid"},
            "a.item_id, a.seqnum, b.guid, b.session_skey", "item", "sess", _ITEM_WINDOW,
        ),
        "item", "sess",
    ),
)
def lookback_item_session(spark, sf):
    views = b.item_views(spark, sf).select("item_id", "seqnum", "event_timestamp", "view_dt", "user_id", "cguid")
    anchors = labels.prefixed(b.sessions(spark, sf), "sess_")
    keys = (lb.Key("uid", "user_id", "sess_parent_uid", "id"), lb.Key("cguid", "cguid", "sess_cguid"))
    side = lb.Side("event_timestamp", "view_dt", ("item_id", "seqnum"))
    return lb.link(views, anchors, keys, lb.ITEM_VIEW, side, SESSION_SIDE).select(
        "item_id", "seqnum", F.col("sess_guid").alias("guid"), F.col("sess_session_skey").alias("session_skey"), "join_strategy"
    )


_PREV_WINDOW = f"""{sec('a.start_timestamp')} < {sec('b.start_timestamp')}
    AND {sec('b.start_timestamp')} - {sec('a.start_timestamp')} <= 14 * 86400
    AND a.session_start_dt <= b.session_start_dt AND datediff('day', a.session_start_dt, b.session_start_dt) <= 14"""


@query(
    "lookback_session_session",
    with_views(
        _ranked(
            {"uid": "a.parent_uid = b.parent_uid", "cguid": "a.cguid = b.cguid", "xid": "a.session_xid = b.session_xid"},
            "a.prev_guid, a.prev_session_skey, b.guid, b.session_skey",
            "(SELECT *, guid AS prev_guid, session_skey AS prev_session_skey FROM sess)", "sess", _PREV_WINDOW,
        ),
        "sess",
    ),
)
def lookback_session_session(spark, sf):
    later = b.sessions(spark, sf)
    earlier = labels.prefixed(later, "prev_")
    keys = (
        lb.Key("uid", "prev_parent_uid", "parent_uid", "id"),
        lb.Key("cguid", "prev_cguid", "cguid"),
        lb.Key("xid", "prev_session_xid", "session_xid"),
    )
    before = lb.Side("prev_start_timestamp", "prev_session_start_dt", ("prev_guid", "prev_session_skey"))
    after = lb.Side("start_timestamp", "session_start_dt", ("guid", "session_skey"))
    return lb.link(earlier, later, keys, lb.EARLIER_SESSION, before, after).select(
        "prev_guid", "prev_session_skey", "guid", "session_skey", "join_strategy"
    )
