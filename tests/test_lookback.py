import datetime as dt

import plans
import pytest
from pyspark.sql import functions as F

from pathweave.operators import lookback as lb
from pathweave.plans import bindings as b
from pathweave.plans.jobs import CHECKOUT_KEYS, OUTCOME_SIDE, TOUCH_SIDE

SF = "/root/testdata/sf0.01"
ANCHOR = dt.datetime(2024, 1, 28, 23, 50, 0)
DID = "d" * 36


def touches(spark, *rows):
    full = [
        (i, ts, ts.date(), uid, did, cguid, xid) for i, (ts, uid, did, cguid, xid) in enumerate(rows)
    ]
    return spark.createDataFrame(
        full,
        "event_id bigint, event_ts timestamp_ntz, event_dt date, user_id bigint, device_id string, cguid string, incdata_id string",
    )


def outcome(spark, uid=5, did=DID, cguid="c", xid="x", ts=ANCHOR):
    return spark.createDataFrame(
        [(1, 7, ts, ts.date(), uid, did, cguid, xid)],
        "transaction_id bigint, item_id bigint, created_time timestamp_ntz, created_dt date, buyer_id bigint, cko_device_id string, bbowa_cguid string, cko_incdata_id string",
    )


def by_uid(spark, times, window=lb.CHECKOUT, **options):
    t = touches(spark, *[(ts, 5, None, None, None) for ts in times])
    found = lb.lookback_join(t, outcome(spark), CHECKOUT_KEYS[0], window, TOUCH_SIDE, OUTCOME_SIDE, **options)
    return sorted(r.event_id for r in found.collect())


def test_window_edges(spark):
    s = dt.timedelta(seconds=1)
    noon = dt.datetime(2024, 1, 28, 12, 0, 0)
    t = touches(spark, *[(ts, 5, None, None, None) for ts in (noon + 600 * s, noon + 601 * s, noon - 24 * 86400 * s, noon - 24 * 86400 * s - s)])
    found = lb.lookback_join(t, outcome(spark, ts=noon), CHECKOUT_KEYS[0], lb.CHECKOUT, TOUCH_SIDE, OUTCOME_SIDE)
    assert sorted(r.event_id for r in found.collect()) == [0, 2]


def test_grace_does_not_cross_midnight(spark):
    late = ANCHOR + dt.timedelta(seconds=590)
    assert by_uid(spark, [late, late + dt.timedelta(seconds=10)]) == [0]


def test_fraction_is_cut_off(spark):
    edge = dt.datetime(2024, 1, 28, 12, 10, 0, 900000)
    t = touches(spark, (edge, 5, None, None, None))
    o = outcome(spark, ts=dt.datetime(2024, 1, 28, 12, 0, 0))
    assert lb.lookback_join(t, o, CHECKOUT_KEYS[0], lb.CHECKOUT, TOUCH_SIDE, OUTCOME_SIDE).count() == 1


def test_strict_and_no_grace(spark):
    times = [ANCHOR, ANCHOR - dt.timedelta(seconds=1), ANCHOR + dt.timedelta(seconds=1)]
    assert by_uid(spark, times, lb.ITEM_VIEW) == [0, 1]
    assert by_uid(spark, times, lb.EARLIER_SESSION) == [1]


def test_strongest_key_wins_and_pairs_are_unique(spark):
    ts = ANCHOR - dt.timedelta(hours=1)
    t = touches(
        spark, (ts, 6, DID, "c", None), (ts, None, None, "c", "x"), (ts, 5, DID, "c", "x"), (ts, 0, "short", "z", "y")
    )
    found = lb.link(t, outcome(spark), CHECKOUT_KEYS, lb.CHECKOUT, TOUCH_SIDE, OUTCOME_SIDE)
    assert sorted((r.event_id, r.join_strategy) for r in found.collect()) == [(0, "did"), (1, "cguid"), (2, "uid")]


@pytest.mark.parametrize(
    "uid,did",
    [(0, "0" * 34), (-1, "prefix-00000000-0000-0000-0000-000000000000"), (None, None)],
)
def test_unusable_keys_do_not_match(spark, uid, did):
    ts = ANCHOR - dt.timedelta(hours=1)
    t = touches(spark, (ts, uid, did, None, None))
    o = outcome(spark, uid=uid, did=did, cguid=None, xid=None)
    assert lb.link(t, o, CHECKOUT_KEYS, lb.CHECKOUT, TOUCH_SIDE, OUTCOME_SIDE).count() == 0


def test_device_of_35_characters_matches(spark):
    ts = ANCHOR - dt.timedelta(hours=1)
    t = touches(spark, (ts, None, "e" * 35, None, None), (ts, None, "e" * 34, None, None))
    for did, n in (("e" * 35, 1), ("e" * 34, 0)):
        o = outcome(spark, did=did, uid=None, cguid=None, xid=None)
        assert lb.link(t, o, CHECKOUT_KEYS, lb.CHECKOUT, TOUCH_SIDE, OUTCOME_SIDE).count() == n


# numbers of pairs known for the bound test tables
@pytest.mark.parametrize("position,n", [(0, 42705), (1, 9078), (2, 15034), (3, 69833)])
def test_known_pair_counts(spark, position, n):
    found = lb.lookback_join(
        b.touches(spark, SF), b.outcomes(spark, SF), CHECKOUT_KEYS[position], lb.CHECKOUT, TOUCH_SIDE, OUTCOME_SIDE
    )
    assert found.count() == n


@pytest.mark.parametrize(
    "options",
    [{"bucket_seconds": 86400}, {"bucket_seconds": 7 * 86400}, {"broadcast_anchors": True}, {"min_rows": 5}, {"min_rows": 5, "bucket_seconds": 86400}],
)
def test_variants_equal_the_plain_join(spark, options):
    args = (b.touches(spark, SF), b.outcomes(spark, SF), CHECKOUT_KEYS[0], lb.CHECKOUT, TOUCH_SIDE, OUTCOME_SIDE)
    ids = ["event_id", "transaction_id", "item_id"]
    plain, other = lb.lookback_join(*args).select(*ids), lb.lookback_join(*args, **options).select(*ids)
    assert plain.exceptAll(other).count() == 0
    assert other.count() == 42705


def test_merged_labels(spark):
    args = (b.touches(spark, SF), b.outcomes(spark, SF), CHECKOUT_KEYS, lb.CHECKOUT, TOUCH_SIDE, OUTCOME_SIDE)
    for options in ({}, {"min_rows": 5}):
        counts = {r.join_strategy: r["count"] for r in lb.link(*args, **options).groupBy("join_strategy").count().collect()}
        assert counts == {"uid": 42705, "did": 1242, "cguid": 1821, "xid": 37680}


def test_merge_of_single_matches(spark):
    one = spark.createDataFrame([(1, 1, "a")], "event_id bigint, transaction_id bigint, v string")
    two = spark.createDataFrame([(1, 1, "b"), (2, 1, "b")], "event_id bigint, transaction_id bigint, v string")
    merged = lb.merge_matches([one, two], ["uid", "did"], ["event_id", "transaction_id"])
    assert sorted(merged.collect()) == [(1, 1, "a", "uid"), (2, 1, "b", "did")]


def test_matches_of_single_ids_are_not_shuffled(spark):
    """A match by a weaker key is left out where it is made: nothing is merged after the join."""
    args = (b.touches(spark, SF), b.outcomes(spark, SF), CHECKOUT_KEYS, lb.CHECKOUT, TOUCH_SIDE, OUTCOME_SIDE)
    found = lb.link(*args).select("event_id", "transaction_id")
    assert plans.shuffles_of(found, "event_id") <= 1 and "Window" not in plans.formatted(found)


@pytest.mark.parametrize("options", [{}, {"min_rows": 2}, {"bucket_seconds": 86400}])
@pytest.mark.parametrize("which", ["touches", "anchors", "both"])
def test_ids_that_several_rows_have(spark, which, options):
    """Rows that share an id, or have none, are merged over all of them; the others as before."""
    hour = dt.timedelta(hours=1)
    t = touches(spark, *[(ANCHOR - (i + 1) * hour, (5, 6, None, 0)[i % 4], (DID, "short")[i % 2], ("c", "e")[i % 3 > 0], "x") for i in range(24)])
    o = outcome(spark).unionByName(outcome(spark, uid=6, cguid="e")).unionByName(outcome(spark, uid=9, did=None, xid="x"))
    o = o.withColumn("transaction_id", F.col("buyer_id"))
    if which != "anchors":  # four touches an id, and six without one
        t = t.withColumn("event_id", F.when(F.col("event_id") < 6, None).when(F.col("event_id") < 14, F.col("event_id") % 2).otherwise(F.col("event_id")))
    if which != "touches":
        o = o.withColumn("transaction_id", F.when(F.col("buyer_id") < 9, None).otherwise(F.col("buyer_id")))
    names, want = [k.name for k in CHECKOUT_KEYS], {}
    for a in t.collect():
        for c in o.collect():
            for i, (x, y) in enumerate(((a.user_id, c.buyer_id), (a.device_id, c.cko_device_id), (a.cguid, c.bbowa_cguid), (a.incdata_id, c.cko_incdata_id))):
                if x is not None and x == y and (i != 0 or x > 0) and (i != 1 or len(x) >= 35):
                    pair = (a.event_id, c.transaction_id, c.item_id)
                    want[pair] = min(want.get(pair, 9), i)
    found = lb.link(t, o, CHECKOUT_KEYS, lb.CHECKOUT, TOUCH_SIDE, OUTCOME_SIDE, **options).collect()
    assert sorted(((r.event_id, r.transaction_id, r.item_id, r.join_strategy) for r in found), key=repr) == sorted(((*k, names[i]) for k, i in want.items()), key=repr)
    assert len(set(want.values())) == 4


def test_copies_of_a_touch_are_settled_by_the_order(spark):
    ts = ANCHOR - dt.timedelta(hours=1)
    t = touches(spark, (ts, 5, None, None, None)).withColumn("flex_column_1", F.explode(F.array(F.lit("b"), F.lit("a"))))
    found = lb.link(
        t, outcome(spark), CHECKOUT_KEYS, lb.CHECKOUT, TOUCH_SIDE, OUTCOME_SIDE, tie_break=[F.col("flex_column_1")]
    )
    assert [r.flex_column_1 for r in found.collect()] == ["a"]
