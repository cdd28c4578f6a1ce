import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pathweave.operators import curves, daily_state
from pathweave.plans import jobs
from pathweave.sources import sinks

D0 = dt.date(2024, 3, 1)


def linked(spark, seed):
    some = random.Random(seed)
    rows = []
    for o in range(120):
        day = D0 + dt.timedelta(days=some.choice([0, 0, 1, 3, 4]))
        for _ in range(some.randrange(6)):
            lag = some.randrange(9)
            rows.append((o, 1, day, day - dt.timedelta(days=lag), some.choice(["a", "b", None]), lag, some.choice([1, 5, 7, 4])))
    return spark.createDataFrame(rows, "transaction_id bigint, item_id bigint, ck_dt date, mktng_dt date, channel_name string, day_diff int, event_type_id int")


def same(got, want):
    assert got.columns == want.columns
    return sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_days_merge_to_the_batch(spark, tmp_path, seed):
    """Day by day, in any order, with a day that was summarised from other rows and a day without any."""
    m, other, out = linked(spark, seed), linked(spark, 7), str(tmp_path / "state")
    days = [D0 + dt.timedelta(days=k) for k in range(5)]
    for rows, day in [(other, days[0]), (other, days[2].replace(day=4)), (m, days[3]), (m, days[0]), (m, days[4]), (m, days[1]), (other, days[1]), (m, days[2]), (m, days[1])]:
        one = spark.createDataFrame([(day,)], "ck_dt date")
        daily_state.replace_days(daily_state.day_summary(rows, one, "ck_dt", "channel_name"), out, "ck_dt")
    total = daily_state.totals(spark, out, "ck_dt")
    assert same(daily_state.cumulative_outcomes(total, "channel_name"), curves.cumulative_outcomes(m, ["channel_name"]))
    assert same(daily_state.cumulative_outcomes(total), curves.cumulative_outcomes(m))
    assert same(daily_state.lag_counts(total, "channel_name"), curves.lag_counts(m, ["channel_name"], F.col("day_diff")))
    windows = {"d0": 0, "d3": 3, "d30": 30}
    assert same(daily_state.average_clicks(total, windows, "channel_name"), curves.average_clicks(m, windows))
    first = daily_state.totals(spark, out, "ck_dt", str(D0), str(D0 + dt.timedelta(days=1)))
    assert same(daily_state.cumulative_outcomes(first), curves.cumulative_outcomes(m.where("ck_dt <= '2024-03-02'")))


def test_a_day_that_lost_its_rows_is_emptied(spark, tmp_path):
    m, out = linked(spark, 3), str(tmp_path / "state")
    day = spark.createDataFrame([(D0,)], "ck_dt date")
    daily_state.replace_days(daily_state.day_summary(m, day, "ck_dt", "channel_name"), out, "ck_dt")
    assert daily_state.totals(spark, out, "ck_dt").count() > 0
    daily_state.replace_days(daily_state.day_summary(m.limit(0), day, "ck_dt", "channel_name"), out, "ck_dt")
    assert daily_state.totals(spark, out, "ck_dt").count() == 0


def test_job(spark, tmp_path):
    m, path, out = linked(spark, 4), str(tmp_path / "linked"), str(tmp_path / "state")
    sinks.write_partitioned(m.drop("day_diff"), path, ["ck_dt", "mktng_dt"])
    jobs.update_dashboard_state(spark, path, out, "2024-03-01", "2024-03-02")
    jobs.update_dashboard_state(spark, path, out, "2024-03-02", "2024-03-05")
    clicks = m.where("event_type_id <> 4").withColumn("channel_name", F.coalesce("channel_name", F.lit("Unassigned")))
    assert same(daily_state.cumulative_outcomes(daily_state.totals(spark, out, "ck_dt"), "channel_name"), curves.cumulative_outcomes(clicks, ["channel_name"]))
