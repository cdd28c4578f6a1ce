"""Session features and cohorts."""

from pyspark.sql import functions as F

from ..operators import identity, sessions
from ..operators.skew import skew_join
from . import bindings as b
from .identity_queries import _maps, _resolve_sql
from .registry import query, with_views

KEY, KEY_COBRAND = list(sessions.SESSION_KEYS), list(sessions.SESSION_KEYS_COBRAND)

_COUNTS_SQL = ", ".join(
    [f"CAST(sum(CASE WHEN bsns_vrtcl_name = '{value}' THEN 1 ELSE 0 END) AS BIGINT) AS {name}" for name, value in b.BASKET_VERTICALS.items()]
    + [f"CAST(sum(CASE WHEN meta_categ_id = {value} THEN 1 ELSE 0 END) AS BIGINT) AS {name}" for name, value in b.BASKET_METAS.items()]
)


def _conditions():
    return sessions.vertical_conditions(verticals=b.BASKET_VERTICALS, metas=b.BASKET_METAS)


@query(
    "vertical_counts",
    with_views(f"SELECT guid, session_skey, site_id, {_COUNTS_SQL} FROM basket GROUP BY guid, session_skey, site_id", "basket"),
)
def vertical_counts(spark, sf):
    return sessions.conditional_counts(b.baskets(spark, sf), KEY, _conditions())


@query(
    "vertical_counts_by_user",
    with_views(
        f"""SELECT guid, cguid, coalesce(user_id, 0) AS user_id, session_skey, site_id, cobrand, view_dt, {_COUNTS_SQL} FROM item
            GROUP BY guid, cguid, coalesce(user_id, 0), session_skey, site_id, cobrand, view_dt""",
        "item",
    ),
)
def vertical_counts_by_user(spark, sf):
    keys = ["guid", "cguid", F.coalesce("user_id", F.lit(0)).alias("user_id"), "session_skey", "site_id", "cobrand", "view_dt"]
    return sessions.conditional_counts(b.item_views(spark, sf), keys, _conditions())


_INTENT_SQL = ", ".join(
    f"CAST(sum(CASE WHEN event_type = '{code}' THEN 1 ELSE 0 END) AS BIGINT) AS {name}"
    for name, code in (("num_watch", "Watch"), ("num_ask", "Ask"), ("num_ac", "AC"), ("num_bo", "BO"), ("num_bb", "BB"))
) + ", count(*) AS num_bbowa"


def _intent_counts(spark, sf, keys):
    return sessions.conditional_counts(b.intents(spark, sf), keys, sessions.intent_conditions(), total="num_bbowa")


@query(
    "intent_counts_session",
    with_views(f"SELECT guid, session_skey, site_id, cobrand, {_INTENT_SQL} FROM intent GROUP BY ALL", "intent"),
)
def intent_counts_session(spark, sf):
    return _intent_counts(spark, sf, KEY_COBRAND)


@query(
    "intent_counts_user",
    with_views(
        f"SELECT intent_user_id, {_INTENT_SQL} FROM intent WHERE intent_user_id > 0 GROUP BY intent_user_id", "intent"
    ),
)
def intent_counts_user(spark, sf):
    signed_in = b.intents(spark, sf).where("intent_user_id > 0")
    return sessions.conditional_counts(signed_in, ["intent_user_id"], sessions.intent_conditions(), total="num_bbowa")


@query(
    "checkout_totals",
    with_views(
        """SELECT guid, session_skey, site_id, cobrand, count(*) AS num_txns, round(sum(gmb_usd), 4) AS gmb_usd,
           CAST(sum(is_first_purchase) AS BIGINT) AS has_first_purchase FROM outcome GROUP BY guid, session_skey, site_id, cobrand""",
        "outcome",
    ),
)
def checkout_totals(spark, sf):
    return sessions.checkout_totals(b.outcomes(spark, sf)).withColumn("gmb_usd", F.round("gmb_usd", 4))


@query(
    "registration_counts",
    with_views("SELECT guid, session_skey, site_id, count(*) AS n_registrations FROM reg GROUP BY guid, session_skey, site_id", "reg"),
)
def registration_counts(spark, sf):
    return sessions.registration_counts(b.registrations(spark, sf))


_LEVELS = {"num_meta": "meta_categ_id", "num_lv2": "categ_lvl2_id", "num_lv3": "categ_lvl3_id", "num_lv4": "categ_lvl4_id"}
_BREADTH_SQL = ", ".join(f"count(DISTINCT {c}) AS {n}" for n, c in _LEVELS.items())


@query(
    "category_breadth",
    with_views(f"SELECT guid, session_skey, site_id, dt, {_BREADTH_SQL} FROM basket GROUP BY guid, session_skey, site_id, dt", "basket"),
)
def category_breadth(spark, sf):
    return sessions.category_breadth(b.baskets(spark, sf), levels=_LEVELS)


_SCORE_SQL = """SELECT *, (125 * CASE WHEN num_meta = 1 THEN 1 WHEN num_meta = 2 THEN 2 WHEN num_meta BETWEEN 3 AND 4 THEN 3 WHEN num_meta BETWEEN 5 AND 7 THEN 4 ELSE 5 END
    + 25 * CASE WHEN num_lv2 = 1 THEN 1 WHEN num_lv2 BETWEEN 2 AND 3 THEN 2 WHEN num_lv2 BETWEEN 4 AND 6 THEN 3 WHEN num_lv2 BETWEEN 7 AND 12 THEN 4 ELSE 5 END
    + 5 * CASE WHEN num_lv3 BETWEEN 1 AND 2 THEN 1 WHEN num_lv3 BETWEEN 3 AND 5 THEN 2 WHEN num_lv3 BETWEEN 6 AND 8 THEN 3 WHEN num_lv3 BETWEEN 9 AND 15 THEN 4 ELSE 5 END
    + CASE WHEN num_lv4 BETWEEN 1 AND 2 THEN 1 WHEN num_lv4 BETWEEN 3 AND 5 THEN 2 WHEN num_lv4 BETWEEN 6 AND 8 THEN 3 WHEN num_lv4 BETWEEN 9 AND 15 THEN 4 ELSE 5 END) / 780.0::DOUBLE AS specificity"""


@query(
    "specificity",
    with_views(
        f"""SELECT * EXCLUDE (specificity), round(specificity, 9) AS specificity, CAST(floor(specificity * 10) - 1 AS BIGINT) AS specificity_binned FROM
            ({_SCORE_SQL} FROM (SELECT guid, session_skey, view_dt, site_id, {_BREADTH_SQL} FROM item GROUP BY guid, session_skey, view_dt, site_id))""",
        "item",
    ),
)
def specificity(spark, sf):
    breadths = sessions.category_breadth(b.item_views(spark, sf), [*KEY, "view_dt"], _LEVELS)
    return sessions.with_specificity(breadths).withColumn("specificity", F.round("specificity", 9))


@query(
    "specificity_volume",
    with_views(
        f"""SELECT specificity_binned, count(*) AS n_sessions FROM (SELECT CAST(floor(specificity * 10) - 1 AS BIGINT) AS specificity_binned FROM
            ({_SCORE_SQL} FROM (SELECT guid, session_skey, dt, site_id, {_BREADTH_SQL} FROM basket GROUP BY guid, session_skey, dt, site_id)))
            GROUP BY specificity_binned""",
        "basket",
    ),
)
def specificity_volume(spark, sf):
    scored = sessions.with_specificity(sessions.category_breadth(b.baskets(spark, sf), levels=_LEVELS))
    return scored.groupBy("specificity_binned").agg(F.count(F.lit(1)).alias("n_sessions"))


def enriched(spark, sf):
    views = b.item_views(spark, sf)
    breadths = sessions.category_breadth(views, KEY, _LEVELS)
    return sessions.enrich(
        b.sessions(spark, sf),
        [
            (sessions.checkout_totals(b.outcomes(spark, sf)), KEY_COBRAND),
            (_intent_counts(spark, sf, KEY_COBRAND), KEY_COBRAND),
            (sessions.with_specificity(breadths), KEY),
            (sessions.registration_counts(b.registrations(spark, sf)), KEY),
            (sessions.conditional_counts(views, KEY, _conditions()), KEY),
        ],
    )


_ENRICHED_SQL = {
    "f_cko": """SELECT guid, session_skey, site_id, cobrand, count(*) AS num_txns, sum(gmb_usd) AS gmb_usd,
        CAST(sum(is_first_purchase) AS BIGINT) AS has_first_purchase FROM outcome GROUP BY ALL""",
    "f_int": f"SELECT guid, session_skey, site_id, cobrand, {_INTENT_SQL} FROM intent GROUP BY ALL",
    "f_spec": f"{_SCORE_SQL} FROM (SELECT guid, session_skey, site_id, {_BREADTH_SQL} FROM item GROUP BY guid, session_skey, site_id)",
    "f_reg": "SELECT guid, session_skey, site_id, count(*) AS n_registrations FROM reg GROUP BY ALL",
    "f_item": f"SELECT guid, session_skey, site_id, {_COUNTS_SQL} FROM item GROUP BY guid, session_skey, site_id",
    "enriched": """SELECT s.*, f_cko.num_txns, f_cko.gmb_usd, f_cko.has_first_purchase, num_watch, num_bbowa, num_meta, num_lv3, specificity,
        n_registrations, num_fashion, num_baby FROM sess s
        LEFT JOIN f_cko ON s.guid = f_cko.guid AND s.session_skey = f_cko.session_skey AND s.site_id = f_cko.site_id AND s.cobrand = f_cko.cobrand
        LEFT JOIN f_int ON s.guid = f_int.guid AND s.session_skey = f_int.session_skey AND s.site_id = f_int.site_id AND s.cobrand = f_int.cobrand
        LEFT JOIN f_spec ON s.guid = f_spec.guid AND s.session_skey = f_spec.session_skey AND s.site_id = f_spec.site_id
        LEFT JOIN f_reg ON s.guid = f_reg.guid AND s.session_skey = f_reg.session_skey AND s.site_id = f_reg.site_id
        LEFT JOIN f_item ON s.guid = f_item.guid AND s.session_skey = f_item.session_skey AND s.site_id = f_item.site_id""",
}
_VIEWS = ("sess", "outcome", "intent", "reg", "item")


@query(
    "session_enrich",
    with_views(
        """SELECT guid, session_skey, site_id, cobrand, num_txns, round(gmb_usd, 4) AS gmb_usd, has_first_purchase, num_watch, num_bbowa,
           num_meta, num_lv3, round(specificity, 9) AS specificity, n_registrations, num_fashion, num_baby FROM enriched""",
        *_VIEWS, extra=_ENRICHED_SQL,
    ),
)
def session_enrich(spark, sf):
    return enriched(spark, sf).select(
        *KEY_COBRAND, "num_txns", F.round("gmb_usd", 4).alias("gmb_usd"), "has_first_purchase", "num_watch", "num_bbowa",
        "num_meta", "num_lv3", F.round("specificity", 9).alias("specificity"), "n_registrations", "num_fashion", "num_baby",
    )


@query(
    "session_intent_by_user",
    with_views(
        f"""SELECT s.guid, s.session_skey, u.intent_user_id AS bbowa_user, num_watch, num_ask, num_ac, num_bo, num_bb, num_bbowa FROM sess s
            LEFT JOIN (SELECT intent_user_id, {_INTENT_SQL} FROM intent WHERE intent_user_id > 0 GROUP BY intent_user_id) u
            ON s.signed_uid = u.intent_user_id""",
        "sess", "intent",
    ),
)
def session_intent_by_user(spark, sf):
    counts = intent_counts_user(spark, sf).withColumnRenamed("intent_user_id", "bbowa_user")
    rows = b.sessions(spark, sf).select("guid", "session_skey", "signed_uid")
    return skew_join(
        rows, counts, [("signed_uid", "bbowa_user")], how="left", spread_by=["guid", "session_skey"]
    ).drop("signed_uid")


def _cohort_sql(rule: str) -> str:
    return with_views(f"SELECT guid, session_skey, num_txns, has_first_purchase FROM enriched WHERE {rule}", *_VIEWS, extra=_ENRICHED_SQL)


def _cohort(spark, sf, name):
    return sessions.cohort(enriched(spark, sf), name).select("guid", "session_skey", "num_txns", "has_first_purchase")


@query("cohort_first", _cohort_sql("has_first_purchase > 0"))
def cohort_first(spark, sf):
    return _cohort(spark, sf, "first")


@query("cohort_nonfirst", _cohort_sql("has_first_purchase = 0"))
def cohort_nonfirst(spark, sf):
    return _cohort(spark, sf, "nonfirst")


@query(
    "cohort_unsigned",
    with_views(
        "SELECT guid, session_skey, join_strategy FROM found WHERE incdata_id IS NULL AND coalesce(signed_uid, 0) = 0",
        "sess", "uid_map", "did_map", "cguid_map",
        extra={"found": _resolve_sql("sess", "guid, session_skey, signed_uid", "signed_uid", "device_id", "'nojoin'")},
    ),
)
def cohort_unsigned(spark, sf):
    maps = _maps(spark, sf, ("uid", "signed_uid"), ("did", "device_id"), ("cguid", "cguid"))
    found = identity.resolve_identity(b.sessions(spark, sf), maps, ["guid", "session_skey"])
    return sessions.cohort(found, "unsigned", user="signed_uid").select("guid", "session_skey", "join_strategy")
