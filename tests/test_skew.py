import pytest
from pyspark.sql import functions as F

from pathweave.operators.dedup import keep_first
from pathweave.operators.skew import hot_keys, skew_join


def tables(spark):
    left = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 50).cast("bigint").alias("k"),
    )
    right = spark.range(40).select((F.col("id") % 30).alias("k2"), F.col("id").alias("r"))
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("min_rows", [10, 10**6])
def test_equals_the_plain_join(spark, how, min_rows):
    left, right = tables(spark)
    mine = skew_join(left, right, [("k", "k2")], how=how, spread_by=["id"], min_rows=min_rows)
    plain = left.join(right, left.k == right.k2, how)
    assert mine.columns == plain.columns
    assert sorted(mine.collect(), key=repr) == sorted(plain.collect(), key=repr)


def test_condition_and_two_keys(spark):
    left, right = tables(spark)
    left, right = left.withColumn("m", F.col("id") % 2), right.withColumn("m2", F.col("r") % 2)
    mine = skew_join(
        left, right, [("k", "k2"), ("m", "m2")], condition=lambda a, b: a("id") > b("r"), min_rows=5
    )
    plain = left.join(right, (left.k == right.k2) & (left.m == right.m2) & (left.id > right.r))
    assert sorted(mine.collect(), key=repr) == sorted(plain.collect(), key=repr)


def test_hot_list_is_bounded(spark):
    left, _ = tables(spark)
    hot = {r.k: r._parts for r in hot_keys(left, ["k"], share=0.1, min_rows=10).collect()}
    assert set(hot) == {1} and hot[1] == 4  # 1020 of 3000 rows in parts of at most 300


def test_both_sides_hot(spark):
    left = spark.range(400).select("id", F.lit(1).alias("k"))
    right = spark.range(300).select(F.col("id").alias("r"), F.when(F.col("id") < 200, 1).otherwise(2).alias("k2"))
    joined = skew_join(left, right, [("k", "k2")], min_rows=50)
    assert joined.count() == 400 * 200 == joined.distinct().count()


def test_map_columns(spark):
    left = spark.range(60).select("id", (F.col("id") % 3).alias("k"), F.create_map(F.lit("x"), "id").alias("m"))
    right = spark.range(2).select(F.col("id").alias("k2"))
    assert skew_join(left, right, [("k", "k2")], how="left_semi", min_rows=5).count() == 40
    assert skew_join(left, right, [("k", "k2")], min_rows=5).count() == 40


def test_right_and_full_are_refused(spark):
    left, right = tables(spark)
    with pytest.raises(ValueError):
        skew_join(left, right, [("k", "k2")], how="full")


def test_hot_rows_are_spread_over_partitions(spark):
    left, right = tables(spark)
    joined = skew_join(left.where("k = 1"), right, [("k", "k2")], spread_by=["id"], share=0.01, min_rows=1)
    assert joined.count() == left.where("k = 1").count() * 2


def test_dedup_null_order(spark):
    rows = spark.createDataFrame([(1, None, "n"), (1, "a", "v")], "k int, d string, tag string")
    assert keep_first(rows, ["k"], [F.col("d").asc_nulls_first(), "tag"]).first().tag == "n"
    assert keep_first(rows, ["k"], [F.col("d").asc_nulls_last(), "tag"]).first().tag == "v"
    assert keep_first(rows, ["k"], [F.col("d").desc(), "tag"]).first().tag == "v"


def test_dedup_limits_groups_before_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = keep_first(rows, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    below_shuffle = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in below_shuffle
