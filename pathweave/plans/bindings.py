"""The test tables seen as touches, outcomes, sessions and so on.

Each view is a set of column expressions over one base table.  They are kept
as SQL text because the same text also defines the view for the SQL the
results are checked against.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as v

_ZERO = v.ZERO_DEVICE
_CHANNEL_BY_K = "case k%10 when 1 then 1 when 2 then 2 when 3 then 3 when 4 then 6 when 5 then 13 when 6 then 33 when 7 then 40 when 8 then 50 when 9 then 25 end"
_CHANNEL_NAME = "case " + " ".join(f"when channel_id = {i} then '{n}'" for i, n in v.CHANNELS) + " end"
_SEGMENT = "case k%9 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(v.SEGMENTS)) + " end"
_DEVICE = f"case when k%5 = 0 then '{_ZERO}' when k%5 = 1 then 'short' else lpad(cast(user_id*2 + k%2 as string), 36, 'd') end"
_PERSON = "case when k%6 <> 0 then concat('x', cast(cast(floor(user_id/2.0) as bigint) as string)) end"
_COOKIE = "concat('c', cast(user_id*3 + k%3 as string))"
_SESSION_KEY = "cast(year(dt)*10000 + month(dt)*100 + day(dt) as bigint)"
_SITE = "case user_id%3 when 0 then 0 when 1 then 3 else 77 end"

TOUCH = {
    "event_id": "event_id",
    "event_ts": "ts",
    "event_dt": "dt",
    "event_type_id": "case event_type when 'click' then 1 when 'view' then 4 when 'signup' then 6 else 8 end",
    "user_id": "case when k%7 = 0 then 0 else user_id + 1 end",
    "cguid": _COOKIE,
    "device_id": _DEVICE,
    "incdata_id": _PERSON,
    "channel_id": _CHANNEL_BY_K,
    "rotation_id": "cast(k as bigint)",
    "device_type_level1": "case k%4 when 0 then 'PC' when 1 then 'Mobile' when 2 then 'Tablet' end",
    "device_type_level2": "case k%3 when 0 then 'a' when 1 then 'b' end",
    "experience_level1": "case k%2 when 0 then 'Browser' end",
    "experience_level2": "case k%5 when 0 then 'App' when 1 then 'Site' end",
    "flex_column_1": "concat('f', cast(k%6 as string))",
    "flex_column_3": "case when k%8 < 5 then concat('g', cast(k%8 as string)) end",
}

OUTCOME = {
    "transaction_id": "event_id",
    "item_id": "cast(k%20 as bigint)",
    "buyer_id": "user_id + 1",
    "created_time": "ts",
    "created_dt": "dt",
    "gmb_usd": "value",
    "bbowa_event_timestamp": "case k%4 when 0 then ts when 1 then ts - interval 1 hour when 2 then ts - interval 2 hour else ts - interval 3 hour end",
    "bbowa_cguid": f"case when k%11 <> 0 then {_COOKIE} end",
    "cko_device_id": _DEVICE,
    "cko_incdata_id": _PERSON,
    "is_first_purchase": "case when k%8 = 0 then 1 else 0 end",
    "bbowa_device_type": "case k%5 when 0 then 'PC' when 1 then 'Phone' when 2 then 'Tablet' when 3 then 'PC: Touch' end",
    "fm_buyer_type_desc": _SEGMENT,
    "guid": "concat('g', cast(user_id as string))",
    "session_skey": _SESSION_KEY,
    "site_id": _SITE,
    "cobrand": "cast(user_id%2 as int)",
}

SESSION = {
    "guid": "concat('g', cast(user_id as string))",
    "session_skey": _SESSION_KEY,
    "site_id": _SITE,
    "cobrand": "cast(user_id%2 as int)",
    "parent_uid": "user_id + 1",
    "signed_uid": "case when day(dt)%5 = 0 then 0 else user_id + 1 end",
    "cguid": "concat('c', cast(user_id*3 + day(dt)%3 as string))",
    "device_id": f"case when day(dt)%5 = 0 then '{_ZERO}' when day(dt)%5 = 1 then 'short' else lpad(cast(user_id*2 + day(dt)%2 as string), 36, 'd') end",
    "session_xid": "case when day(dt)%6 <> 0 then concat('x', cast(cast(floor(user_id/2.0) as bigint) as string)) end",
    "session_start_dt": "dt",
    "start_timestamp": "start_ts",
    "end_timestamp": "end_ts",
    "traffic_source_id": "day(dt)%5",
    "device_type_level1": "case day(dt)%3 when 0 then 'PC' when 1 then 'Mobile' end",
    "device_type_level2": "case user_id%4 when 0 then 'a' when 1 then 'b' when 2 then 'c' end",
    "vi_cnt": "n_events",
}

REGISTRATION = {
    "reg_user_id": "user_id + 1",
    "user_cre_ts": "ts",
    "user_cre_dt": "dt",
    "reg_cguid": _COOKIE,
    "reg_device_id": _DEVICE,
    "reg_incdata_id": _PERSON,
    "guid": "concat('g', cast(user_id as string))",
    "session_skey": _SESSION_KEY,
    "site_id": _SITE,
}

INTENT = {
    "intent_id": "event_id",
    "intent_user_id": "user_id + 1",
    "intent_cguid": _COOKIE,
    "intent_device_id": _DEVICE,
    "intent_incdata_id": _PERSON,
    "intent_ts": "ts",
    "dt": "dt",
    "event_type": "case k%5 when 0 then 'Watch' when 1 then 'Ask' when 2 then 'AC' when 3 then 'BO' else 'BB' end",
    "guid": "concat('g', cast(user_id as string))",
    "session_skey": _SESSION_KEY,
    "site_id": _SITE,
    "cobrand": "cast(user_id%2 as int)",
}

ITEM_VIEW = {
    "item_id": "cast(k as bigint)",
    "seqnum": "event_id",
    "event_timestamp": "ts",
    "view_dt": "dt",
    "user_id": "case when k%7 = 0 then 0 else user_id + 1 end",
    "cguid": _COOKIE,
    "guid": "concat('g', cast(user_id as string))",
    "session_skey": _SESSION_KEY,
    "site_id": _SITE,
    "cobrand": "cast(user_id%2 as int)",
    "bsns_vrtcl_name": "concat('vertical ', cast(k%11 as string))",
    "meta_categ_id": "k%16",
    "categ_lvl2_id": "k%25",
    "categ_lvl3_id": "case when k%13 <> 0 then k%40 end",
    "categ_lvl4_id": "k",
    "device_type_level1": "case k%4 when 0 then 'PC' when 1 then 'Mobile' when 2 then 'Tablet' end",
    "device_type_level2": "case k%3 when 0 then 'a' when 1 then 'b' end",
    "experience_level1": "case k%2 when 0 then 'Browser' end",
    "experience_level2": "case k%5 when 0 then 'App' when 1 then 'Site' end",
}

BASKET = {
    "guid": "concat('g', cast(o_custkey as string))",
    "user_id": "o_custkey",
    "session_skey": "o_orderkey",
    "dt": "cast(o_orderdate as date)",
    "site_id": "cast(o_custkey%3 as int)",
    "bsns_vrtcl_name": "concat('vertical ', cast(l_partkey%11 as string))",
    "meta_categ_id": "l_partkey%16",
    "categ_lvl2_id": "l_partkey%25",
    "categ_lvl3_id": "l_partkey%40",
    "categ_lvl4_id": "l_partkey%100",
}

# the test tables have neither the real verticals nor the real meta categories
BASKET_VERTICALS = {name: f"vertical {i}" for i, name in enumerate(v.VERTICALS)}
BASKET_METAS = {name: i for i, name in enumerate(v.META_CATEGORIES)}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("ts").cast("date").alias("dt"),
    )


def _once(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` worked out once a row: a filter that Spark moves down otherwise repeats its expression wherever it is used."""
    return df.select(*[c for c in df.columns if c != column], F.explode(F.array(column)).alias(column))


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _once(events(spark, sf_dir).where("event_type <> 'purchase'"), "k")
    return _view(base, TOUCH).withColumn("channel_name", F.expr(_CHANNEL_NAME))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(events(spark, sf_dir).where("event_type = 'purchase'"), OUTCOME)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = events(spark, sf_dir).groupBy("user_id", "dt").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_events")
    )
    return _view(days, SESSION)


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(events(spark, sf_dir).where("event_type = 'signup'"), REGISTRATION)


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(events(spark, sf_dir).where("event_type in ('purchase', 'signup')"), INTENT)


def item_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(events(spark, sf_dir).where("event_type <> 'purchase'"), ITEM_VIEW)


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return _view(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), BASKET)


_XID = "concat('x', cast(cast(floor(user_id/2.0) as bigint) as string))"


def uid_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = events(spark, sf_dir).where("user_id%4 <> 3")
    return known.selectExpr("user_id + 1 AS incdata_srcid", f"{_XID} AS incdata_id").distinct()


def cguid_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = events(spark, sf_dir).where("k%3 <> 2")
    return known.selectExpr(f"{_COOKIE} AS cguid", f"{_XID} AS incdata_id").distinct()


def did_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = events(spark, sf_dir).where("k%2 = 0")
    did = "lpad(cast(user_id*2 as string), 36, 'd')"
    return known.selectExpr(f"{did} AS did", f"{_XID} AS incdata_id").distinct()


def rotation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = events(spark, sf_dir).where("k < 80")
    return known.selectExpr("cast(k as bigint) AS rotation_id", "concat('rock_', cast(k%6 as string)) AS big_rock").distinct()


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS slr_id", "l_partkey%25 AS elig_leaf_categ_id"
    ).distinct()


def followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS follower_id", "c_custkey%100 AS flwd_user_id", "c_custkey%25 AS leaf_categ_id"
    )


def _sql_view(columns: dict[str, str], source: str, where: str = "") -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source} {where}"


# the same views for the SQL the results are checked against, in order of dependence
SQL_VIEWS = {
    "ev": """SELECT event_id, ts, user_id, event_type, value,
        CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(ts AS DATE) AS dt FROM events""",
    "touch": f"SELECT *, {_CHANNEL_NAME} AS channel_name FROM ({_sql_view(TOUCH, 'ev', 'WHERE event_type <> ' + chr(39) + 'purchase' + chr(39))})",
    "outcome": _sql_view(OUTCOME, "ev", "WHERE event_type = 'purchase'"),
    "sess": _sql_view(
        SESSION,
        "(SELECT user_id, dt, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_events FROM ev GROUP BY user_id, dt)",
    ),
    "reg": _sql_view(REGISTRATION, "ev", "WHERE event_type = 'signup'"),
    "intent": _sql_view(INTENT, "ev", "WHERE event_type IN ('purchase', 'signup')"),
    "item": _sql_view(ITEM_VIEW, "ev", "WHERE event_type <> 'purchase'"),
    "basket": _sql_view(BASKET, "lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "uid_map": f"SELECT DISTINCT user_id + 1 AS incdata_srcid, {_XID} AS incdata_id FROM ev WHERE user_id%4 <> 3",
    "cguid_map": f"SELECT DISTINCT {_COOKIE} AS cguid, {_XID} AS incdata_id FROM ev WHERE k%3 <> 2",
    "did_map": f"SELECT DISTINCT lpad(cast(user_id*2 as string), 36, 'd') AS did, {_XID} AS incdata_id FROM ev WHERE k%2 = 0",
    "rotation": "SELECT DISTINCT cast(k as bigint) AS rotation_id, concat('rock_', cast(k%6 as string)) AS big_rock FROM ev WHERE k < 80",
}
