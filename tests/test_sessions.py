import pytest
from pyspark.sql import functions as F

from pathweave.functions import labels
from pathweave.operators import sessions


def test_specificity_scores(spark):
    rows = spark.createDataFrame(
        [(1, 1, 1, 1), (8, 13, 16, 16), (1, 1, 0, 1), (2, 3, 5, 5), (4, 6, 8, 8), (7, 12, 15, 15)],
        "num_meta bigint, num_lv2 bigint, num_lv3 bigint, num_lv4 bigint",
    )
    got = [(round(r.specificity, 6), r.specificity_binned) for r in sessions.with_specificity(rows).collect()]
    assert got == [
        (0.2, 1), (1.0, 9), (round((125 + 25 + 25 + 1) / 780, 6), 1), (0.4, 3), (0.6, 5), (0.8, 7),
    ]


def test_breadth_ignores_missing_categories(spark):
    rows = spark.createDataFrame(
        [("g", 1, 0, "d", "m", 1, None, 3), ("g", 1, 0, "d", "m", 2, None, 3)],
        "guid string, session_skey int, site_id int, dt string, meta_categ_name string, categ_lvl2_id int, categ_lvl3_id int, categ_lvl4_id int",
    )
    r = sessions.category_breadth(rows).first()
    assert (r.num_meta, r.num_lv2, r.num_lv3, r.num_lv4) == (1, 2, 0, 1)


def test_two_cookies_make_one_total(spark):
    rows = spark.createDataFrame(
        [("g", 1, 0, 0, "c1", 2.0, 1), ("g", 1, 0, 0, "c2", 3.0, 0)],
        "guid string, session_skey int, site_id int, cobrand int, cguid string, gmb_usd double, is_first_purchase int",
    )
    r = sessions.checkout_totals(rows).collect()
    assert [(x.num_txns, x.gmb_usd, x.has_first_purchase) for x in r] == [(2, 5.0, 1)]


def test_cohorts(spark):
    rows = spark.createDataFrame(
        [(1, 2, None, 0), (2, 0, None, None), (3, None, "x", 0), (4, None, None, 5)],
        "id int, has_first_purchase int, incdata_id string, parent_uid int",
    )
    ids = {c: sorted(r.id for r in sessions.cohort(rows, c).collect()) for c in sessions.COHORTS}
    assert ids == {"first": [1], "nonfirst": [2], "unsigned": [1, 2]}
    with pytest.raises(ValueError):
        sessions.cohort(rows, "norb-ish")
    with pytest.raises(ValueError):
        sessions.cohort(rows.drop("incdata_id"), "unsigned")


def test_real_verticals_are_counted(spark):
    rows = spark.createDataFrame(
        [("g", "Fashion", 11450), ("g", "Media", 1), ("g", None, 1249)], "guid string, bsns_vrtcl_name string, meta_categ_id int"
    )
    r = sessions.conditional_counts(rows, ["guid"], sessions.vertical_conditions(), total="n").first()
    assert (r.num_fashion, r.num_media, r.num_clothes_shoes_acc, r.num_video_games_consoles, r.num_baby, r.n) == (1, 1, 1, 1, 0, 3)


def test_defaults_keep_each_type(spark):
    rows = spark.createDataFrame([(None, None)], "a string, b bigint")
    out = labels.with_defaults(rows, {"a": "unknown", "b": -1})
    assert out.dtypes == rows.dtypes and out.first() == ("unknown", -1)


def test_label_styles(spark):
    rows = spark.createDataFrame([(4,), (6,), (7,), (99,)], "event_type_id int")
    got = {s: [r[0] for r in rows.select(labels.event_label(style=s)).collect()] for s in ("click_open", "full", "no_impression")}
    assert got == {
        "click_open": ["open", "open", "click", "unknown"],
        "full": ["impression", "open", "click", "undefined"],
        "no_impression": ["undefined", "open", "click", "undefined"],
    }
    with pytest.raises(ValueError):
        labels.event_label(style="other")


def test_outcome_devices(spark):
    rows = spark.createDataFrame([("PC",), ("PC: Touch",), ("Phone",), ("Tablet",), (None,), ("TV",)], "bbowa_device_type string")
    assert [r[0] for r in rows.select(labels.outcome_device()).collect()] == ["PC", "PC", "Mobile", "Tablet", "unknown", "others"]


def test_prefixed(spark):
    assert labels.prefixed(spark.range(1).withColumn("a", F.lit(1)), "reg_").columns == ["reg_id", "reg_a"]
