import random
from collections import Counter

import pytest
from plans import shuffles_of

from pathweave.operators import identity

ZERO = "00000000-0000-0000-0000-000000000000"
D1, D2 = "d" * 36, "e" * 36


def sessions(spark, rows):
    return spark.createDataFrame(rows, "guid string, session_skey bigint, parent_uid bigint, device_id string, cguid string")


def maps(spark):
    u = spark.createDataFrame([(1, "xu"), (1, "xu")], "incdata_srcid bigint, incdata_id string")
    d = spark.createDataFrame([(D1, "xd")], "did string, incdata_id string")
    c = spark.createDataFrame([("c1", "xa"), ("c1", "xb")], "cguid string, incdata_id string")
    return [
        identity.IdentityMap("uid", "parent_uid", "id", u, "incdata_srcid"),
        identity.IdentityMap("did", "device_id", "device", d, "did"),
        identity.IdentityMap("cguid", "cguid", "text", c, "cguid"),
    ]


@pytest.mark.parametrize("min_rows", [1, 10**6])
def test_first_map_that_knows_the_session(spark, min_rows):
    rows = sessions(
        spark,
        [("all", 1, 1, D1, "c1"), ("did", 1, 9, D1, "zz"), ("two", 1, None, "short", "c1"), ("none", 1, 0, ZERO, None)],
    )
    found = identity.resolve_identity(rows, maps(spark), ["guid", "session_skey"], min_rows=min_rows)
    assert sorted((r.guid, r.join_strategy, r.incdata_id) for r in found.collect()) == [
        ("all", "uid", "xu"),
        ("did", "did", "xd"),
        ("none", "nojoin", None),
        ("two", "cguid", "xa"),
        ("two", "cguid", "xb"),
    ]


@pytest.mark.parametrize("number", [1, 2, 3])
def test_rows_are_shuffled_once(spark, number):
    rows = sessions(spark, [("g", 1, 7, None, None)])
    found = identity.resolve_identity(rows, maps(spark)[:number], ["guid", "session_skey"])
    assert shuffles_of(found, "session_skey") == 1


def test_many_rows_and_a_hot_combination(spark):
    """Against a plain look-up: keys shared by many rows, rows without keys, equal text in different keys, separators in keys."""
    some = random.Random(3)
    rows = [(f"g{i}", i, some.choice([None, 0, 1, 2, 77, 1]), some.choice([None, ZERO, D1, D2, "1" * 40]), some.choice([None, "c1", "a|1:b", "1" * 40, "zz"])) for i in range(600)]
    u = spark.createDataFrame([(1, "p1"), (2, None), (77, "p77"), (77, "p78")], "incdata_srcid bigint, incdata_id string")
    d = spark.createDataFrame([(D1, "q1"), ("1" * 40, "q2"), (None, "nobody")], "did string, incdata_id string")
    c = spark.createDataFrame([("c1", "r1"), ("a|1:b", "r2"), ("a|1:b", "r3")], "cguid string, incdata_id string")
    three = [identity.IdentityMap("uid", "parent_uid", "id", u, "incdata_srcid"), identity.IdentityMap("did", "device_id", "device", d, "did"), identity.IdentityMap("cguid", "cguid", "text", c, "cguid")]
    owners = [("uid", {1: ["p1"], 77: ["p77", "p78"]}), ("did", {D1: ["q1"], "1" * 40: ["q2"]}), ("cguid", {"c1": ["r1"], "a|1:b": ["r2", "r3"]})]
    want = Counter()
    for g, _, *keys in rows:
        hit = next(((n, p) for (n, m), k in zip(owners, keys) for p in [m.get(k)] if p), ("nojoin", [None]))
        want.update((g, hit[0], p) for p in hit[1])
    for min_rows in (5, 10**6):
        found = identity.resolve_identity(sessions(spark, rows), three, ["guid"], min_rows=min_rows)
        assert Counter((r.guid, r.join_strategy, r.incdata_id) for r in found.collect()) == want


def test_no_label_without_a_person(spark):
    rows = sessions(spark, [("g", 1, 7, None, None)])
    found = identity.resolve_identity(rows, maps(spark), ["guid"], unresolved=None).first()
    assert found.join_strategy is None and found.incdata_id is None


def test_anonymous(spark):
    rows = sessions(
        spark,
        [
            ("known cookie", 1, 0, D2, "c1"),
            ("known device", 1, 0, D1, "zz"),
            ("unknown", 1, 0, D2, "zz"),
            ("no device", 1, 0, ZERO, "zz"),
            ("no cookie", 1, 0, D2, None),
            ("short device", 1, 0, "short", "zz"),
        ],
    )
    cookies = spark.createDataFrame([("c1",)], "cguid string")
    devices = spark.createDataFrame([(D1,), (ZERO,)], "did string")
    found = identity.anonymous(rows, cookies, devices, ["guid"])
    assert sorted(r.guid for r in found.collect()) == ["no cookie", "no device", "unknown"]
