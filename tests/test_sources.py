import os
import time

from plans import formatted
from pyspark.sql import functions as F

from pathweave.sources import lookups, scan, sinks

SF = "/root/testdata/sf0.001"


def days(spark):
    return spark.createDataFrame(
        [("2024-01-01", 1, "a"), ("2024-01-01", 2, None), ("2024-01-03", 3, "c")], "dt string, id int, name string"
    )


def test_rerun_of_a_day_replaces_it(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.write_partitioned(days(spark), out, ["dt"])
    sinks.write_partitioned(days(spark).where("dt = '2024-01-03'").withColumn("id", F.lit(9)), out, ["dt"])
    assert sorted((str(r.dt), r.id) for r in spark.read.parquet(out).collect()) == [
        ("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-03", 9),
    ]
    sinks.write_partitioned(days(spark), out, ["dt"], mode="append")
    assert spark.read.parquet(out).count() == 6


def test_date_range_prunes_directories(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.write_partitioned(days(spark), out, ["dt"])
    some = scan.in_range(scan.scan(spark, out), "2024-01-02", "2024-01-03")
    assert [r.id for r in some.collect()] == [3]
    assert "PartitionFilters: [isnotnull(dt" in some._jdf.queryExecution().executedPlan().toString()


def test_pattern_keeps_partition_columns(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.write_partitioned(days(spark).withColumn("src", F.lit("x")), out, ["src", "dt"])
    part = scan.scan(spark, out + "/*/dt=2024-01-01", basePath=out)
    assert part.count() == 2 and {"src", "dt"} <= set(part.columns)


def test_days_without_rows(spark):
    missing = scan.missing_days(days(spark), "2024-01-01", "2024-01-04")
    assert sorted(str(r.dt) for r in missing.collect()) == ["2024-01-02", "2024-01-04"]


def test_tsv_with_null_text(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.write_tsv(days(spark), out, null="\\N", by=["dt"])
    lines = []
    for root, _, files in os.walk(out):
        lines += [line for f in files if f.endswith(".csv") for line in open(os.path.join(root, f)).read().splitlines()]
    assert sorted(lines) == ["1\ta", "2\t\\N", "3\tc"]


def test_stage_with_and_without_a_path(spark, tmp_path):
    table = sinks.stage(days(spark), str(tmp_path / "s"), by=["dt"])
    assert table.count() == 3 and table.schema["dt"].dataType.simpleString() == "string"
    cut = sinks.stage(days(spark))
    assert cut.count() == 3
    assert "stage-" in cut.inputFiles()[0]


def test_rerun_of_one_day_keeps_the_others(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.write_tsv(days(spark), out, by=["dt"])
    before = sorted(d for d in os.listdir(out) if d.startswith("dt="))
    day = before[0].removeprefix("dt=")
    sinks.write_tsv(days(spark).where(F.col("dt") == day), out, by=["dt"])
    assert sorted(d for d in os.listdir(out) if d.startswith("dt=")) == before and len(before) > 1


def test_stage_over_stage_holds_the_last(spark, tmp_path):
    out = str(tmp_path / "s")
    sinks.stage(days(spark), out, by=["dt"])
    one = days(spark).limit(1)
    assert sinks.stage(one, out, by=["dt"]).count() == 1


def test_headerless_lookup(spark, tmp_path):
    path = tmp_path / "rocks.tsv"
    path.write_text("1\trock a\n2\trock b\n")
    rocks = lookups.read_tsv_lookup(spark, str(path))
    assert sorted(rocks.collect()) == [(1, "rock a"), (2, "rock b")]
    rows = spark.createDataFrame([(1,), (7,)], "rotation_id bigint")
    assert sorted((r.rotation_id, r.big_rock) for r in lookups.with_lookup(rows, rocks, "rotation_id").collect()) == [(1, "rock a"), (7, None)]


def test_percent_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("Channel_name,0,61\nepn,0.9%,100.0%\nAffiliate,34.0%,\n")
    table = lookups.read_percent_csv(spark, str(path), "channel_name", [0, 61])
    assert sorted(table.collect(), key=repr) == sorted(
        [("epn", 0, 0.9), ("epn", 61, 100.0), ("Affiliate", 0, 34.0), ("Affiliate", 61, None)], key=repr
    )


def test_samples(spark):
    rows = spark.range(10_000).withColumn("user_id", F.col("id") % 500)
    part = scan.key_sample(rows, "user_id", 5)
    users = {r.user_id for r in part.select("user_id").distinct().collect()}
    assert 60 < len(users) < 140 and part.count() == len(users) * 20


def test_bernoulli_sample(spark):
    """The same rows whatever the partitioning; a larger fraction holds a smaller one's; strata have their own."""
    rows = spark.range(10_000).withColumn("kind", F.when(F.col("id") % 4 > 0, F.col("id") % 4))

    def ids(df, fraction, **kind):
        return {r.id for r in scan.bernoulli_sample(df, fraction, 7, ["id"], **kind).collect()}

    some = ids(rows, 0.2)
    assert 1800 < len(some) < 2200
    assert ids(rows.repartition(13), 0.2) == some == ids(rows.orderBy(F.desc("id")), 0.2)
    assert some < ids(rows, 0.5) and ids(rows, 1.0) == set(range(10_000)) and ids(rows, 0.0) == set()
    assert {r.id for r in scan.bernoulli_sample(rows, 0.2, 8, ["id"]).collect()} != some
    strata = ids(rows, 0.2, stratum="kind", fractions={1: 1.0, 2: 0.0, None: 0.5})
    assert {i for i in strata if i % 4 == 3} == {i for i in some if i % 4 == 3}
    assert len({i for i in strata if i % 4 == 1}) == 2500 and not {i for i in strata if i % 4 == 2}
    assert 1100 < len({i for i in strata if i % 4 == 0}) < 1400


def test_days_known_at_run_time_prune_directories(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.write_partitioned(days(spark), out, ["dt"])
    wanted = spark.createDataFrame([("2024-01-03", 1), ("2024-01-03", 2), ("2024-01-09", 3)], "dt string, x int")
    some = scan.of_days(scan.scan(spark, out), wanted.where("x < 3"))
    assert [r.id for r in some.collect()] == [3]
    assert "dynamicpruning" in formatted(some)


def test_damaged_days_are_found(spark, tmp_path):
    out = str(tmp_path / "t")
    table = days(spark).union(spark.createDataFrame([("2024-01-05", 4, "d"), ("2024-01-07", 5, "e"), ("2024-01-07", 6, "f")], "dt string, id int, name string"))
    sinks.write_days_tsv(table, out, null="\\N")

    def damaged():
        return sorted(r.dt for r in sinks.damaged_days(spark, out).collect())

    assert damaged() == [] and sinks.exists(spark, f"{out}/dt=2024-01-0*") and not sinks.exists(spark, f"{out}/dt=2023*")
    os.rename(f"{out}/dt=2024-01-05", f"{tmp_path}/away")
    sinks.write_tsv(table.where("id = 5"), out, null="\\N", by=["dt"])
    sinks.write_tsv(table.where("id = 3").withColumn("name", F.lit("x")), out, null="\\N", by=["dt"])
    assert damaged() == ["2024-01-03", "2024-01-05", "2024-01-07"]
    sinks.write_days_tsv(table.where("dt > '2024-01-01'"), out, null="\\N")
    assert damaged() == []


def test_a_stage_leaves_no_shuffle_behind(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        blocks = disk.getAllBlocks()
        return {str(blocks.apply(i)) for i in range(blocks.size()) if str(blocks.apply(i)).startswith("shuffle_")}

    there, setting = shuffles(), spark.conf.get(sinks.SHUFFLE_CLEANUP)
    staged = sinks.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not (left := shuffles() - there):
            break
        time.sleep(0.1)
    assert not left and staged.count() == 7 and spark.conf.get(sinks.SHUFFLE_CLEANUP) == setting
