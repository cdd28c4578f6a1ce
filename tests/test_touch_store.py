import datetime as dt
import random
from collections import Counter

import pytest
from plans import formatted, shuffles_of
from pyspark.sql import functions as F

from pathweave.operators import lookback as lb
from pathweave.operators.touch_store import TouchStore

T0 = dt.datetime(2024, 1, 1)
KEYS = (lb.Key("uid", "user_id", "buyer", "id"), lb.Key("cguid", "cguid", "cookie"))
TOUCH, ANCHOR = lb.Side("ts", "dt", ("event_id",)), lb.Side("at", "day", ("order_id",))
WINDOW = lb.Window(days=3, date_gap=3)


def touches(spark, n=600, seed=1):
    some = random.Random(seed)
    rows = []
    for i in range(n):
        t = T0 + dt.timedelta(minutes=some.randrange(20 * 1440))
        rows.append((i, t, t.date(), some.choice([0, 1, 1, 1, 2, 3]), some.choice([None, "a", "b"])))
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, dt date, user_id bigint, cguid string")


def anchors(spark, n=80, seed=2):
    some = random.Random(seed)
    rows = []
    for i in range(n):
        t = T0 + dt.timedelta(minutes=some.randrange(20 * 1440))
        rows.append((i, t, t.date(), some.choice([0, 1, 2, 4]), some.choice([None, "a", "c"])))
    return spark.createDataFrame(rows, "order_id bigint, at timestamp_ntz, day date, buyer bigint, cookie string")


def found(df):
    return Counter((r.event_id, r.order_id, r.join_strategy) for r in df.collect())


@pytest.mark.parametrize("min_rows", [10, 10**6])
def test_store_gives_what_link_gives(spark, tmp_path, min_rows):
    """Also after days were written twice, when opened again, and with keys dealt over parts."""
    t, a = touches(spark), anchors(spark)
    path = str(tmp_path / "touches")
    store = TouchStore(spark, path, KEYS, TOUCH, min_rows=min_rows)
    store.write(touches(spark, seed=9).where("dt < '2024-01-09'"))
    store.write(t.where("dt >= '2024-01-06'"))
    store.write(t.where("dt < '2024-01-09'"))
    want = found(lb.link(t, a, KEYS, WINDOW, TOUCH, ANCHOR))
    assert found(store.link(a, WINDOW, ANCHOR)) == want and sum(want.values()) > 1000
    spark.sql(f"DROP TABLE {store.name}")
    again = TouchStore(spark, path, KEYS, TOUCH, min_rows=min_rows)
    some = a.where("day BETWEEN '2024-01-10' AND '2024-01-11'")
    assert found(again.link(a, WINDOW, ANCHOR, "2024-01-10", "2024-01-11")) == found(lb.link(t, some, KEYS, WINDOW, TOUCH, ANCHOR))


def test_only_anchors_are_shuffled(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = TouchStore(spark, str(tmp_path / "touches"), KEYS, TOUCH)
        store.write(touches(spark))
        rows = store.matches(anchors(spark).withColumn("wide", F.lit("w")), WINDOW, ANCHOR, "2024-01-10", "2024-01-11")
        rows.count()
        assert shuffles_of(rows, "event_id") == 0 and shuffles_of(rows, "order_id") >= 1
        plan = formatted(rows)
        assert "Bucketed: true" in plan and "2024-01-07" in plan[plan.index("PartitionFilters") :].split("\n")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_key_with_most_rows_is_in_several_buckets(spark, tmp_path):
    store = TouchStore(spark, str(tmp_path / "touches"), KEYS, TOUCH, buckets=8, min_rows=50)
    store.write(touches(spark, 2000).withColumn("user_id", F.lit(1).cast("bigint")).withColumn("cguid", F.lit(None).cast("string")))
    sizes = [r["count"] for r in store.touches().groupBy("_part").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 120
