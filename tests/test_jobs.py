"""The whole jobs on small stored tables."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from pathweave.plans import bindings as b
from pathweave.plans import jobs
from pathweave.plans.link_queries import merged

SF = "/root/testdata/sf0.001"
START, END = "2024-01-01", "2024-01-31"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))

    def day(c):
        return F.date_format(c, "yyyy-MM-dd").alias("dt")

    tables = {
        "touches": b.touches(spark, SF).select("*", F.lit("rover").alias("data_source"), day("event_dt")),
        "checkouts": b.outcomes(spark, SF)
        .withColumnsRenamed({"cko_device_id": "device_id", "cko_incdata_id": "incdata_id"})
        .withColumnsRenamed({c: f"sess_{c}" for c in ("guid", "session_skey", "site_id", "cobrand")})
        .select("*", day("created_dt")),
        "sessions": b.sessions(spark, SF)
        .withColumnRenamed("session_xid", "incdata_id")
        .select("*", day("session_start_dt")),
        "registrations": b.registrations(spark, SF)
        .withColumnsRenamed({"reg_user_id": "user_id", "reg_cguid": "cguid", "reg_device_id": "device_id", "reg_incdata_id": "incdata_id"})
        .select("*", day("user_cre_dt")),
        "intents": b.intents(spark, SF).withColumnRenamed("intent_user_id", "user_id").withColumn("dt", F.date_format("dt", "yyyy-MM-dd")),
        "items": b.item_views(spark, SF)
        .withColumns({"meta_categ_name": F.col("meta_categ_id").cast("string"), "session_start_dt": F.col("view_dt")})
        .select("*", day("view_dt")),
        "uid_map": b.uid_map(spark, SF),
        "did_map": b.did_map(spark, SF).select("*", F.col("did").alias("ident_attr_value_txt")),
        "cguid_map": b.cguid_map(spark, SF).select("*", F.col("cguid").alias("ident_attr_value_txt")),
    }
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}")
    b.rotation_lookup(spark, SF).coalesce(1).write.csv(f"{root}/rocks", sep="\t")
    jobs.correlate_checkouts(spark, f"{root}/touches", f"{root}/checkouts", f"{root}/linked", START, END, "rover", START)
    return root


def test_linked_checkouts(spark, store):
    linked = spark.read.parquet(f"{store}/linked")
    assert {"data_source", "ck_dt", "mktng_dt", "is_before_checkout", "bbowa_day_diff"} <= set(linked.columns)
    got = linked.groupBy("join_strategy").count()
    want = merged(spark, SF).groupBy("join_strategy").count()
    assert sorted(got.collect()) == sorted(want.collect())


def test_days_can_be_run_again(spark, store, tmp_path):
    out = str(tmp_path / "again")
    for _ in range(2):
        jobs.correlate_checkouts(spark, f"{store}/touches", f"{store}/checkouts", out, START, END, "rover", START)
    assert spark.read.parquet(out).count() == spark.read.parquet(f"{store}/linked").count()


def test_intents_and_registrations(spark, store, tmp_path):
    jobs.correlate_intents(spark, f"{store}/touches", f"{store}/checkouts", str(tmp_path / "i"), START, END)
    assert spark.read.parquet(str(tmp_path / "i")).where("bbowa_sec_diff < -600").count() == 0
    jobs.correlate_registrations(spark, f"{store}/touches", f"{store}/registrations", str(tmp_path / "r"), START, END, START)
    linked = spark.read.parquet(str(tmp_path / "r"))
    assert linked.count() == linked.select("event_id", "reg_user_id").distinct().count() > 0


def test_session_features_and_cohorts(spark, store, tmp_path):
    jobs.score_specificity(spark, f"{store}/items", f"{tmp_path}/spec", START, END)
    jobs.session_features(
        spark, f"{store}/sessions", f"{store}/checkouts", f"{store}/intents", f"{tmp_path}/spec", f"{store}/items",
        f"{store}/registrations", f"{tmp_path}/rich", START, END,
    )
    rich = spark.read.parquet(f"{tmp_path}/rich")
    assert rich.count() == spark.read.parquet(f"{store}/sessions").count()
    assert {"num_txns", "num_bbowa", "specificity", "n_registrations", "num_fashion"} <= set(rich.columns)
    assert rich.agg(F.sum("num_txns")).first()[0] == spark.read.parquet(f"{store}/checkouts").count()

    for cohort in ("first", "nonfirst", "all", "anonymous"):
        jobs.correlate_sessions(
            spark, f"{store}/touches", f"{tmp_path}/rich", f"{tmp_path}/corr", START, END, START, cohort,
            keys=("did", "cguid") if cohort == "anonymous" else ("uid", "did", "cguid", "xid"),
            cookie_map_path=f"{store}/cguid_map", device_map_path=f"{store}/did_map",
            intents=spark.read.parquet(f"{store}/intents") if cohort == "all" else None,
        )
    linked = spark.read.option("mergeSchema", "true").parquet(f"{tmp_path}/corr")
    assert {r.session_type for r in linked.select("session_type").distinct().collect()} >= {"first", "nonfirst", "all"}
    assert linked.where("session_type = 'first' and sess_has_first_purchase = 0").count() == 0
    assert linked.where("session_type = 'all' and num_bbowa > 0").count() > 0
    assert linked.where("event_type_id not in (1, 5, 8)").count() == 0
    with pytest.raises(ValueError):
        jobs.correlate_sessions(spark, f"{store}/touches", f"{tmp_path}/rich", f"{tmp_path}/x", START, END, START, "anonymous")
    with pytest.raises(ValueError):
        jobs.correlate_sessions(spark, f"{store}/touches", f"{tmp_path}/rich", f"{tmp_path}/x", START, END, START, "other")


def test_identities(spark, store, tmp_path):
    jobs.resolve_sessions(
        spark, f"{store}/sessions", f"{tmp_path}/s", START, END, f"{store}/uid_map", f"{store}/did_map", f"{store}/cguid_map"
    )
    assert {r.join_strategy for r in spark.read.parquet(f"{tmp_path}/s").select("join_strategy").distinct().collect()} >= {"uid", "nojoin"}
    jobs.resolve_items(spark, f"{store}/items", f"{tmp_path}/i", START, END, f"{store}/uid_map", f"{store}/cguid_map")
    assert spark.read.parquet(f"{tmp_path}/i").count() == spark.read.parquet(f"{store}/items").count()
    jobs.items_before_sessions(spark, f"{store}/items", f"{store}/sessions", f"{tmp_path}/p", START, END, START)
    assert spark.read.parquet(f"{tmp_path}/p").where("event_timestamp > sess_start_timestamp + interval 1 second").count() == 0


def test_path_jobs(spark, store, tmp_path):
    linked = f"{store}/linked"
    jobs.dedupe_clicks(spark, linked, f"{tmp_path}/clicks", START, END)
    clicks = spark.read.parquet(f"{tmp_path}/clicks")
    assert clicks.count() == clicks.select("event_id", "item_id", "transaction_id").distinct().count()
    for ordered in (True, False):
        jobs.count_pairs(spark, linked, f"{tmp_path}/pairs{ordered}", ordered)
        assert "->" in spark.read.csv(f"{tmp_path}/pairs{ordered}", sep="\t").first()[1]
    jobs.encode_channels(spark, linked, f"{tmp_path}/enc", f"{tmp_path}/masks", checkout_day="2024-01-20")
    masks = spark.read.csv(f"{tmp_path}/masks", sep="\t")
    assert masks.count() == spark.read.parquet(linked).where("ck_dt = '2024-01-20'").select("transaction_id").distinct().count()
    for part in (None, "before", "after"):
        jobs.encode_tokens(spark, linked, f"{tmp_path}/tenc{part}", f"{tmp_path}/tok{part}", part)
        text = spark.read.csv(f"{tmp_path}/tok{part}", sep="\t", schema="t string, i string, p string").first().p
        assert set(text) == {"0", "1"}
    with pytest.raises(ValueError):
        jobs.by_intent(spark.read.parquet(linked), "during")
    jobs.transition_edges(spark, linked, f"{store}/rocks", f"{tmp_path}/steps", f"{tmp_path}/edges")
    total = spark.read.parquet(f"{tmp_path}/edges").agg(F.sum("weight")).first()[0]
    assert total == spark.read.parquet(linked).where("event_type_id <> 4").count()
    jobs.event_lists(spark, linked, f"{store}/rocks", f"{tmp_path}/lists", paid_only=True)
    assert spark.read.parquet(f"{tmp_path}/lists").groupBy("transaction_id", "item_id", "path_length").agg(F.countDistinct("event_id").alias("n")).where("n <> path_length").count() == 0
    jobs.mobile_only(spark, linked, f"{tmp_path}/mobile")
    assert spark.read.parquet(f"{tmp_path}/mobile").where("device_type_level1 <> 'Mobile'").count() == 0


def test_organic_export(spark, store, tmp_path):
    jobs.export_organic_touches(spark, f"{store}/sessions", f"{tmp_path}/organic", START, END)
    back = spark.read.csv(f"{tmp_path}/organic", sep="\t")
    assert back.count() == spark.read.parquet(f"{store}/sessions").where("traffic_source_id in (1,2,3)").count()
    assert "\\N" in tuple(back.first())


def test_organic_backfill_writes_only_missing_days(spark, store, tmp_path):
    out = f"{tmp_path}/organic"
    jobs.export_organic_touches(spark, f"{store}/sessions", out, START, END)
    days = sorted(d for d in os.listdir(out) if d.startswith("dt="))
    gone = days[0]
    shutil.move(f"{out}/{gone}", f"{tmp_path}/{gone}")
    done = jobs.backfill_organic_touches(spark, f"{store}/sessions", out, START, END)
    assert gone.removeprefix("dt=") in done and not set(done) & {d.removeprefix("dt=") for d in days[1:]}
    assert sorted(d for d in os.listdir(out) if d.startswith("dt=")) == days
    cut = next(f for f in os.listdir(f"{out}/{days[-1]}") if f.endswith(".csv"))
    with open(f"{out}/{days[-1]}/{cut}", "r+") as f:
        f.truncate(len(f.readline()))
    os.remove(f"{out}/{days[-1]}/.{cut}.crc")
    done = jobs.backfill_organic_touches(spark, f"{store}/sessions", out, START, END)
    assert days[-1].removeprefix("dt=") in done and not set(done) & {d.removeprefix("dt=") for d in days[:-1]}
