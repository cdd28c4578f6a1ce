import itertools
import math
import random
import time
from collections import Counter
from fractions import Fraction

import pytest
from plans import shuffles_of
from pyspark.sql import functions as F

from pathweave.operators import bitmap, curves, distributions, sets, stats
from pathweave.sources import lookups


def test_published_percentages(spark):
    # golden values: cumulated outcomes of one channel at lags 0 and 61, and of all channels at lag 0
    by_channel = spark.createDataFrame([("p", 0, 1893), ("p", 61, 17714)], "channel_name string, day_diff int, cumm_txns bigint")
    overall = spark.createDataFrame([(0, 1574079), (61, 3945841)], "day_diff int, cumm_txns bigint")
    shares = {r.day_diff: round(r.pct_of_all, 1) for r in curves.pct_of_all(by_channel, overall).collect()}
    assert shares == {0: 0.1, 61: 0.4}
    base = curves.baseline_normalised(by_channel, 61, 0, 61)
    assert {r.day_diff: round(r.cumm_prcnt, 1) for r in base.collect()} == {0: 10.7, 61: 100.0}


def test_outcomes_count_at_their_closest_touch(spark):
    rows = spark.createDataFrame(
        [(1, 1, "a", 5), (1, 1, "a", 0), (2, 1, "a", 3), (1, 1, "b", 2)],
        "transaction_id int, item_id int, channel_name string, day_diff int",
    )
    got = {(r.channel_name, r.day_diff): (r.cumm_txns, r.pct_of_last) for r in curves.cumulative_outcomes(rows, ["channel_name"]).collect()}
    assert got == {("a", 0): (1, 50.0), ("a", 3): (2, 100.0), ("b", 2): (1, 100.0)}
    assert [r.cumm_txns for r in curves.cumulative_outcomes(rows).orderBy("day_diff").collect()] == [1, 2]
    filled = curves.fill_lags(curves.first_lags(rows, ["channel_name"], "day_diff"), ["channel_name"], "no_txns")
    assert filled.count() == 8 and filled.agg(F.sum("no_txns")).first()[0] == 3
    overall = curves.fill_lags(curves.first_lags(rows, [], "day_diff"), [], "no_txns")
    assert [r.no_txns for r in overall.orderBy("day_diff").collect()] == [1, 0, 0, 1]


def test_curve_sums_rounded_percentages(spark):
    counts = spark.createDataFrame([(None, 0, 1), (None, 1, 1), (None, 2, 1)], "channel_name string, day_diff int, cnt bigint")
    rounded = curves.lookback_curve(counts, digits=1).orderBy("day_diff").collect()
    assert [round(r.cumm_prcnt, 1) for r in rounded] == [33.3, 66.6, 99.9]
    assert rounded[0].channel_name == "isNA"
    assert math.isclose(curves.lookback_curve(counts).agg(F.max("cumm_prcnt")).first()[0], 100.0)


def test_band_never_below_one(spark):
    histogram = spark.createDataFrame([(0, 1, 1, 2), (0, 1, 3, 2), (0, 2, 4, 1)], "site_id int, window int, n_channels bigint, n_paths bigint")
    got = {r.window: r for r in curves.channel_spread(histogram, ["site_id"]).collect()}
    assert (got[1].mean, round(got[1].stddev, 6), got[1].low) == (2.0, round(math.sqrt(4 / 3), 6), 1.0)
    assert got[2].mean == 4.0 and got[2].stddev is None
    fractions = curves.channel_fractions(histogram, ["site_id"]).where("window = 1").orderBy("n_channels").collect()
    assert [r.cumul_frac for r in fractions] == [0.5, 1.0]


def test_low_volume_channels(spark):
    counts = spark.createDataFrame(
        [("big", 0, 90), ("small", 0, 5), ("late", 62, 500), ("late", 1, 3), ("named", 0, 80)],
        "channel_name string, day_diff int, cnt bigint",
    )
    assert sorted(r[0] for r in curves.low_volume(counts, 50, fixed=["named"]).collect()) == ["late", "named", "small"]


def test_average_clicks(spark):
    rows = spark.createDataFrame(
        [(1, 1, "a", 0, "New"), (1, 1, "a", 5, "New"), (2, 1, "a", 5, "Old"), (2, 1, "b", 9, "Old")],
        "transaction_id int, item_id int, channel_name string, day_diff int, seg string",
    )
    got = {r.channel_name: (r.d1, r.d7) for r in curves.average_clicks(rows, {"d1": 1, "d7": 7}).collect()}
    assert got == {"a": (1.0, 1.5), "b": (None, None)}
    by = {r.channel_name: (r.New, r.Old) for r in curves.average_clicks_by(rows, "seg", ["New", "Old"]).collect()}
    assert by == {"a": (2.0, 1.0), "b": (None, 1.0)}
    by = {r.channel_name: (r.New, r.unknown) for r in curves.average_clicks_by(rows, "seg", ["New"]).collect()}
    assert by == {"a": (2.0, 1.0), "b": (None, 1.0)}


def test_grid_and_reshaping(spark):
    counts = spark.createDataFrame([("d1", "a", 1), ("d2", "b", 2)], "event_dt string, channel_name string, no_events bigint")
    grid = {(r.event_dt, r.channel_name): r.no_events for r in curves.dense_grid(counts).collect()}
    assert grid == {("d1", "a"): 1, ("d1", "b"): 0, ("d2", "a"): 0, ("d2", "b"): 2}
    some = {r.event_dt: (r.a, r.other) for r in curves.pivot_wide(counts, ["event_dt"], "channel_name", ["a"], "no_events").collect()}
    assert some == {"d1": (1, 0), "d2": (0, 2)}
    wide = curves.pivot_wide(counts, ["event_dt"], "channel_name", ["a", "b"], "no_events")
    long = curves.unpivot_long(wide, ["event_dt"], ["a", "b"], "channel_name", "no_events")
    assert {(r.event_dt, r.channel_name): r.no_events for r in long.collect()} == grid


def test_shares(spark):
    touches = spark.createDataFrame([("d1", "a", 1), ("d1", None, None), ("d1", "a", 1), ("d1", "b", 2)], "event_dt string, channel_name string, channel_id int")
    share = {r.channel_name: r.prop for r in curves.daily_share(touches).collect()}
    assert share == {"a": 50.0, None: 25.0, "b": 25.0}
    assert curves.missing_share(touches).first().prop == 0.25
    ratio = {r.channel_name: r.ratio for r in curves.relative_importance(touches.where("channel_name is null"), touches).collect()}
    assert ratio == {None: 4.0}


def kinds(spark, rows):
    return spark.createDataFrame(rows, "channels array<string>, n_paths bigint")


def test_lift(spark):
    table = kinds(spark, [(["a", "b"], 30), (["a"], 20), (["b"], 10), (["c"], 40)])
    got = {(r.channel_1, r.channel_2): r for r in stats.lift(stats.contingency(table)).collect()}
    ab = got[("a", "b")]
    assert (ab.incidence_1, ab.incidence_2, ab.observed_pairs, ab.n) == (50, 40, 30, 100)
    assert (ab.expected_pairs, ab.lift, ab.observed_p) == (20.0, 0.5, 0.3)
    assert got[("a", "c")].observed_pairs == 0 and got[("a", "c")].lift == -1.0
    shown = stats.contingency(table, ["c"]).collect()
    assert len(shown) == 1 and shown[0].n == 100
    assert [r.channel_1 for r in stats.strong_pairs(stats.lift(stats.contingency(table)), 10).collect()] == ["a"]
    effects = {(r.channel_1, r.channel_2): round(r.effect, 9) for r in stats.effects(stats.lift(stats.contingency(table))).collect()}
    assert effects[("a", "b")] == 0.1


@pytest.mark.parametrize("blocks", [1, 3, 4096])
def test_bitmap_index(spark, blocks):
    """Counts from bitmaps and from sets of channels are those of a plain count; repeated rows and paths without a channel."""
    some = random.Random(blocks)
    rows = [(o, o % 3, c) for o in range(900) for c in some.sample("abcdefgh", some.randrange(5)) * some.choice([1, 2])]
    rows += [(2000 + k, 0, None) for k in range(70)] + [(5, 2, None)]
    df = spark.createDataFrame(rows, "transaction_id bigint, item_id bigint, channel string").repartition(3)
    sets_ = {}
    for o, i, c in rows:
        sets_.setdefault((o, i), set()).add(c)
    for excluded in ([], ["a", "h"]):
        shown = [c for c in "abcdefgh" if c not in excluded]
        incidence = Counter(c for s in sets_.values() for c in s)
        together = Counter(p for s in sets_.values() for p in itertools.combinations(sorted(c for c in s if c), 2))
        want = sorted((a, b, incidence[a], incidence[b], together[a, b], len(sets_)) for a, b in itertools.combinations(shown, 2))
        table = stats.contingency_of_paths(df, "channel", excluded, blocks=blocks)
        assert sorted(map(tuple, table.select("channel_1", "channel_2", "incidence_1", "incidence_2", "observed_pairs", "n").collect())) == want
        kinds_ = stats.contingency(stats.path_kinds(df, "channel"), excluded)
        assert sorted(map(tuple, kinds_.select("channel_1", "channel_2", "incidence_1", "incidence_2", "observed_pairs", "n").collect())) == want


def test_index_has_a_word_for_63_paths(spark):
    df = spark.range(63 * 40).selectExpr("id AS transaction_id", "1L AS item_id", "'t' AS channel")
    index = bitmap.bitmap_index(df, "channel", blocks=1)
    assert index.count() == 40 and index.agg(F.min(F.bit_count("bits"))).first()[0] == 63
    assert shuffles_of(bitmap.common_counts(index, "channel"), "transaction_id") == 1


def exact_tail(observed, n1, n2, n, above):
    ways = lambda k: math.comb(n2, k) * math.comb(n - n2, n1 - k)
    ks = range(observed, min(n1, n2) + 1) if above else range(max(0, n1 + n2 - n), observed + 1)
    return float(Fraction(sum(map(ways, ks)), math.comb(n, n1)))


def of_tables(spark, *tables):
    """p_lt, p_gt, p_value_chisq, unstable_pvalue of tables (observed, n1, n2, n), in their order."""
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(tables)], "i int, observed_pairs bigint, incidence_1 bigint, incidence_2 bigint, n bigint")
    return [(r.p_lt, r.p_gt, r.p_value_chisq, r.unstable_pvalue) for r in stats.pair_tests(df, digits=None).orderBy("i").collect()]


def test_hypergeometric_tails(spark):
    tables = [(30, 50, 40, 100), (0, 3, 4, 10), (3, 3, 4, 10), (10, 60, 70, 120), (35, 60, 70, 120), (400, 900, 800, 2000), (1, 1, 1, 1000)]
    tables += [(0, 0, 5, 10), (5, 10, 5, 10), (0, 30, 20, 5000), (9, 30, 20, 5000), (7, 17, 16, 33), (2000, 5000, 4000, 11000), (1, 1, 1, 1)]
    for table, (p_lt, p_gt, _, _) in zip(tables, of_tables(spark, *tables)):
        assert math.isclose(p_lt, exact_tail(*table, False), rel_tol=1e-10, abs_tol=1e-14), table
        assert math.isclose(p_gt, exact_tail(*table, True), rel_tol=1e-10, abs_tol=1e-14), table


def test_chi_square(spark):
    # 2 x 2 table 30 20 / 10 40: statistic 15.0417 with continuity correction
    found = of_tables(spark, (30, 50, 40, 100), (1, 2, 3, 10), (5, 10, 5, 10), (20, 50, 40, 100))
    assert math.isclose(found[0][2], math.erfc(math.sqrt(361 / 24 / 2)), rel_tol=1e-12) and not found[0][3]
    assert found[1][3] is True and found[2][2] is None and found[3][2] == 1


def test_error_function(spark):
    z = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.9999, 2.0, 2.5, 4.0, 8.0, 20.0]
    df = spark.createDataFrame([(x,) for x in z], "z double").select("z", distributions.erfc(F.col("z")).alias("p"))
    assert all(math.isclose(r.p, math.erfc(r.z), rel_tol=1e-12) for r in df.collect())


def test_large_tables_finish(spark):
    (p_lt, p_gt, p, _), *_ = of_tables(spark, (500_000_000, 2_000_000_000, 1_000_000_000, 4_000_000_000))
    assert 0.5 < p_lt < 0.5001 and math.isclose(p_lt, p_gt, rel_tol=1e-9) and p > 0.9


def test_tails_far_from_the_mode_are_short_sums(spark):
    """A count 10**8 away from the mode at a billion paths: the sum runs away from the mode, the other tail is the rest."""
    start = time.perf_counter()
    observed = (150_000_000, 350_000_000, 250_010_000, 249_990_000)
    for k, (p_lt, p_gt, _, _) in zip(observed, of_tables(spark, *[(k, 500_000_000, 500_000_000, 1_000_000_000) for k in observed])):
        assert 0 <= p_lt <= 1 and 0 <= p_gt <= 1 and abs(p_lt + p_gt - 1) < 1e-3
        assert (p_lt < 0.5) == (k < 250_000_000)
    assert time.perf_counter() - start < 30


def test_pair_tests_on_spark(spark):
    table = kinds(spark, [(["a", "b"], 30), (["a"], 20), (["b"], 10), (["c"], 40)])
    r = stats.pair_tests(stats.contingency(table)).where("channel_1 = 'a' and channel_2 = 'b'").first()
    assert math.isclose(r.p_gt, exact_tail(30, 50, 40, 100, True), abs_tol=1e-5) and r.p_lt > 0.99 and not r.unstable_pvalue


def test_multiplicity(spark):
    counts = spark.createDataFrame([(0, i, i) for i in range(1, 101)], "group_id int, incdata_id int, cnt bigint")
    r = stats.multiplicity_summary(counts, "group_id").first()
    assert (r.n_keys, r["min"], r.median, r.mean, r["max"]) == (100, 1, 50.5, 50.5, 100)
    assert math.isclose(r.top, 99.901)
    assert stats.below_quantile(counts, 0.9).count() == 90


def test_graph(spark):
    pairs = spark.createDataFrame([("a", "c", 0.5), ("b", "c", 0.1)], "channel_1 string, channel_2 string, v double")
    nodes = stats.graph_nodes(pairs)
    assert {r.name: r.code for r in nodes.collect()} == {"a": 0, "b": 1, "c": 2}
    assert sorted(stats.graph_links(pairs, nodes, "v").collect()) == [(0, 2, 0.5), (1, 2, 0.1)]


def test_contaminated_ids(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 0), (None, 1), (3, 1)], "uid int, g int")
    assert [r.uid for r in sets.in_both_groups(df, "uid", "g", 0, 1).collect()] == [1]
    assert sorted(r.uid for r in sets.remove_contaminated(df, "uid", "g", 0, 1).collect()) == [2, 3]
    assert sets.union_distinct(df, df).count() == 6


def test_percent_texts(spark):
    wide = spark.createDataFrame([("epn", "0.9%", "2.3"), (None, "1%", "1%")], "channel_name string, `0` string, `61` string")
    assert sorted(lookups.percent_table(wide, "channel_name").collect()) == [("epn", 0, 0.9), ("epn", 61, 2.3)]
