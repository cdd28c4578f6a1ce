"""Channel pair statistics and sets of ids."""

from pyspark.sql import functions as F

from ..operators import sets, stats
from . import bindings as b
from .link_queries import merged_sql
from .path_queries import _channels
from .registry import query, with_views

_GROUPED = {"g": "SELECT cguid, incdata_id, user_id, CAST(event_id % 2 AS INT) AS group_id FROM touch WHERE incdata_id IS NOT NULL"}


def _grouped(spark, sf):
    return b.touches(spark, sf).where("incdata_id IS NOT NULL").selectExpr(
        "cguid", "incdata_id", "user_id", "cast(event_id % 2 AS int) AS group_id"
    )


_MULT = {**_GROUPED, "mult": "SELECT group_id, incdata_id, count(*) AS cnt FROM (SELECT DISTINCT cguid, incdata_id, group_id FROM g) GROUP BY ALL"}


def _multiplicity(spark, sf):
    distinct = _grouped(spark, sf).select("cguid", "incdata_id", "group_id").distinct()
    return stats.multiplicity(distinct, ["group_id", "incdata_id"])


@query("xid_multiplicity", with_views("SELECT group_id, incdata_id, cnt FROM mult", "touch", extra=_MULT))
def xid_multiplicity(spark, sf):
    return _multiplicity(spark, sf)


@query(
    "multiplicity_summary",
    with_views(
        """SELECT group_id, count(*) AS n_keys, min(cnt) AS min, quantile_cont(cnt, 0.25)::DOUBLE AS q1, quantile_cont(cnt, 0.5)::DOUBLE AS median, round(avg(cnt), 6) AS mean,
           quantile_cont(cnt, 0.75)::DOUBLE AS q3, max(cnt) AS max, round(quantile_cont(cnt, 0.999)::DOUBLE, 6) AS top FROM mult GROUP BY group_id""",
        "touch", extra=_MULT,
    ),
)
def multiplicity_summary(spark, sf):
    table = stats.multiplicity_summary(_multiplicity(spark, sf), "group_id")
    return table.withColumns({c: F.round(c, 6) for c in ("mean", "top")})


@query(
    "multiplicity_cut",
    with_views(
        "SELECT group_id, incdata_id, cnt FROM mult WHERE cnt <= (SELECT quantile_cont(cnt, 0.9) FROM mult)", "touch", extra=_MULT
    ),
)
def multiplicity_cut(spark, sf):
    return stats.below_quantile(_multiplicity(spark, sf), 0.9)


@query(
    "distinct_identities",
    with_views("SELECT count(DISTINCT incdata_id) AS n_people, count(DISTINCT cguid) AS n_cookies FROM g", "touch", extra=_GROUPED),
)
def distinct_identities(spark, sf):
    return _grouped(spark, sf).agg(
        F.count_distinct("incdata_id").alias("n_people"), F.count_distinct("cguid").alias("n_cookies")
    )


_TEST = {"t": "SELECT cguid, CASE WHEN k%5 <> 0 THEN user_id END AS uid, CASE WHEN user_id%3 = 0 THEN CAST(k%2 AS INT) ELSE CAST(user_id%2 AS INT) END AS group_id FROM (SELECT concat('c', cast(user_id*3 + k%3 as string)) AS cguid, user_id, k FROM ev)"}


def _test_groups(spark, sf):
    return b.events(spark, sf).selectExpr(
        "concat('c', cast(user_id*3 + k%3 as string)) AS cguid",
        "case when k%5 <> 0 then user_id end AS uid",
        "case when user_id%3 = 0 then cast(k%2 as int) else cast(user_id%2 as int) end AS group_id",
    )


_BOTH = "SELECT uid FROM t WHERE group_id = 0 AND uid IS NOT NULL INTERSECT SELECT uid FROM t WHERE group_id = 1 AND uid IS NOT NULL"


@query("contaminated_users", with_views(_BOTH, extra=_TEST))
def contaminated_users(spark, sf):
    return sets.in_both_groups(_test_groups(spark, sf), "uid", "group_id", 0, 1)


@query(
    "contaminated_removed",
    with_views(f"SELECT cguid, uid, group_id FROM t WHERE uid IS NOT NULL AND uid NOT IN ({_BOTH})", extra=_TEST),
)
def contaminated_removed(spark, sf):
    return sets.remove_contaminated(_test_groups(spark, sf), "uid", "group_id", 0, 1)


@query(
    "union_distinct",
    with_views("SELECT guid, session_skey FROM reg UNION SELECT guid, session_skey FROM intent", "reg", "intent"),
)
def union_distinct(spark, sf):
    return sets.union_distinct(
        b.registrations(spark, sf).select("guid", "session_skey"), b.intents(spark, sf).select("guid", "session_skey")
    )


def _lift_views(excluded: str = "''") -> dict[str, str]:
    return {
        "chan": "SELECT DISTINCT transaction_id, item_id, coalesce(channel_name, 'Unassigned') AS c FROM merged",
        "tot": "SELECT count(*) AS n FROM (SELECT DISTINCT transaction_id, item_id FROM chan)",
        "inc": f"SELECT c, count(*) AS i FROM chan WHERE c NOT IN ({excluded}) GROUP BY c",
        "obs": "SELECT a.c AS c1, b.c AS c2, count(*) AS o FROM chan a JOIN chan b ON a.transaction_id = b.transaction_id AND a.item_id = b.item_id AND a.c < b.c GROUP BY ALL",
        "cont": """SELECT x.c AS channel_1, y.c AS channel_2, x.i AS incidence_1, y.i AS incidence_2, coalesce(o, 0) AS observed_pairs, n,
            x.i::DOUBLE * y.i / n AS e FROM inc x JOIN inc y ON x.c < y.c LEFT JOIN obs ON c1 = x.c AND c2 = y.c CROSS JOIN tot""",
    }


_LIFT = """SELECT channel_1, channel_2, incidence_1, incidence_2, observed_pairs, n, round(e, 6) AS expected_pairs,
    round((observed_pairs - e) / e, 5) AS lift, round(observed_pairs / n::DOUBLE, 5) AS observed_p FROM cont"""


def _lifted(spark, sf, excluded=()):
    return stats.lift(stats.contingency_of_paths(_channels(spark, sf), "channel_name", excluded))


@query("pair_lift", merged_sql(_LIFT, extra=_lift_views()))
def pair_lift(spark, sf):
    return _lifted(spark, sf).withColumn("expected_pairs", F.round("expected_pairs", 6))


@query("pair_lift_shown", merged_sql(_LIFT, extra=_lift_views("'Unassigned', 'epn'")))
def pair_lift_shown(spark, sf):
    return _lifted(spark, sf, ["Unassigned", "epn"]).withColumn("expected_pairs", F.round("expected_pairs", 6))


# hypergeometric probabilities from lgamma, chi-square p-values (erfc) from a series up to 2 and a continued fraction beyond
_TESTS = {
    "prob": """SELECT channel_1, channel_2, k, exp(lgamma(incidence_2 + 1) - lgamma(k + 1) - lgamma(incidence_2 - k + 1) + lgamma(n - incidence_2 + 1)
        - lgamma(incidence_1 - k + 1) - lgamma(n - incidence_2 - incidence_1 + k + 1) - lgamma(n + 1) + lgamma(incidence_1 + 1) + lgamma(n - incidence_1 + 1)) AS p
        FROM (SELECT *, unnest(range(greatest(0, incidence_1 + incidence_2 - n)::BIGINT, least(incidence_1, incidence_2)::BIGINT + 1)) AS k FROM cont)""",
    "cells": """SELECT *, [[observed_pairs, incidence_1::DOUBLE * incidence_2 / n], [incidence_1 - observed_pairs, incidence_1::DOUBLE * (n - incidence_2) / n],
        [incidence_2 - observed_pairs, (n - incidence_1)::DOUBLE * incidence_2 / n],
        [n - incidence_1 - incidence_2 + observed_pairs, (n - incidence_1)::DOUBLE * (n - incidence_2) / n]] AS c FROM cont""",
    "chi": """SELECT *, CASE WHEN list_min(list_transform(c, lambda x: x[2])) > 0 THEN sqrt(list_sum(list_transform(c, lambda x:
        pow(abs(x[1] - x[2]) - least(0.5, list_min(list_transform(c, lambda y: abs(y[1] - y[2])))), 2) / x[2])) / 2) END AS z,
        list_min(list_transform(c, lambda x: x[2])) < 5 AS unstable_pvalue FROM cells""",
    "chisq": """SELECT *, CASE WHEN z IS NULL THEN NULL WHEN z < 2 THEN 1 - 2 / sqrt(pi()) * exp(-z * z) * list_sum(list_transform(range(0, 51),
        lambda i: z * list_product(list_concat([1.0::DOUBLE], list_transform(range(1, i + 1), lambda j: 2 * z * z / (2 * j + 1))))))
        ELSE exp(-z * z) / sqrt(pi()) / list_reduce(list_concat([z], list_transform(range(80, 0, -1), lambda i: i::DOUBLE)), lambda a, b: z + b / 2 / a) END AS p FROM chi""",
}


@query(
    "pair_tests",
    merged_sql(
        """SELECT channel_1, channel_2, incidence_1, incidence_2, observed_pairs, n, round(chisq.p, 5) AS p_value_chisq, unstable_pvalue,
           round(least(1, sum(prob.p) FILTER (WHERE k <= observed_pairs)), 5) AS p_lt, round(least(1, sum(prob.p) FILTER (WHERE k >= observed_pairs)), 5) AS p_gt
           FROM chisq JOIN prob USING (channel_1, channel_2) GROUP BY ALL""",
        extra=_lift_views() | _TESTS,
    ),
)
def pair_tests(spark, sf):
    return stats.pair_tests(stats.contingency(stats.path_kinds(_channels(spark, sf), "channel_name")))


@query(
    "pair_effects",
    merged_sql(
        "SELECT channel_1, channel_2, round((observed_pairs - e) / n, 9) AS effect FROM cont WHERE observed_pairs <> e", extra=_lift_views()
    ),
)
def pair_effects(spark, sf):
    return stats.effects(_lifted(spark, sf)).withColumn("effect", F.round("effect", 9))


@query(
    "strong_pairs",
    merged_sql(f"SELECT channel_1, channel_2, observed_pairs, lift FROM ({_LIFT}) WHERE observed_pairs > 1000 ORDER BY lift DESC, channel_1, channel_2", extra=_lift_views()),
)
def strong_pairs(spark, sf):
    return stats.strong_pairs(_lifted(spark, sf), 1000).select("channel_1", "channel_2", "observed_pairs", "lift")


_NODES = {"nodes": "SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INT) AS code FROM (SELECT channel_1 AS name FROM cont UNION SELECT channel_2 FROM cont)"}


@query("pair_nodes", merged_sql("SELECT name, code FROM nodes", extra={**_lift_views(), **_NODES}))
def pair_nodes(spark, sf):
    return stats.graph_nodes(_lifted(spark, sf))


@query(
    "pair_links",
    merged_sql(
        "SELECT a.code AS source, b.code AS target, round(observed_pairs / n::DOUBLE, 5) AS value FROM cont JOIN nodes a ON a.name = channel_1 JOIN nodes b ON b.name = channel_2",
        extra={**_lift_views(), **_NODES},
    ),
)
def pair_links(spark, sf):
    pairs = _lifted(spark, sf)
    return stats.graph_links(pairs, stats.graph_nodes(pairs), "observed_p")
