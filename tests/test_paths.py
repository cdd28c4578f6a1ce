import datetime as dt
import itertools
import random
from collections import Counter

import numpy as np
import plans
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathweave.operators import encode, ordered, path_counts, paths, sequence
from pathweave.plans.jobs import valid_matches
from pathweave.plans.link_queries import merged

T0 = dt.datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def matches(spark, *rows):
    """Rows of (outcome, event, channel[, seconds])."""
    full = [(o, 1, e, c, T0 + dt.timedelta(seconds=rest[0] if rest else e)) for o, e, c, *rest in rows]
    return spark.createDataFrame(
        full, "transaction_id bigint, item_id bigint, event_id bigint, channel_name string, event_ts timestamp_ntz"
    )


def counts(pairs):
    return {(r.path_length, r.channel_1, r.channel_2): r.n for r in pairs.collect()}


def test_pairs_of_a_b_a(spark):
    t = paths.path_touches(matches(spark, (1, 1, "a"), (1, 2, "b"), (1, 3, "a")))
    assert counts(paths.ordered_pairs(t)) == {(3, "a", "b"): 1, (3, "a", "a"): 1, (3, "b", "a"): 1}
    assert counts(paths.unordered_pairs(t)) == {(3, "a", "a"): 1, (3, "a", "b"): 2}


def test_copies_of_a_touch_count_once(spark):
    t = paths.path_touches(matches(spark, (1, 1, "a", 5), (1, 1, "a", 3), (1, 2, None, 4)))
    assert counts(paths.ordered_pairs(t)) == {(2, "a", "Unassigned"): 1}
    assert paths.build_paths(t, 10).first().touches[0].event_ts == T0 + dt.timedelta(seconds=3)


def test_length_limits(spark):
    rows = [(1, i, "a") for i in range(60)] + [(2, i, "a") for i in range(61)]
    t = paths.path_touches(matches(spark, *rows))
    assert counts(paths.unordered_pairs(t, 60)) == {(60, "a", "a"): 60 * 59 // 2}
    long = spark.range(2003).select(
        F.when(F.col("id") < 1000, 1).otherwise(2).cast("bigint").alias("transaction_id"), F.lit(1).cast("bigint").alias("item_id"),
        F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("channel_name"),
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("event_ts"),
    )
    got = counts(paths.ordered_pairs(paths.path_touches(long), 1000))
    assert sum(got.values()) == 1000 * 999 // 2 and {k[0] for k in got} == {1000}
    assert got[(1000, "a", "b")] == 500 * 501 // 2


def test_paths_of_any_length_count(spark):
    """Without a limit a path of 2500 touches over several hours is counted whole, across chunks."""
    long = spark.range(2500).select(
        F.lit(1).cast("bigint").alias("transaction_id"), F.lit(1).cast("bigint").alias("item_id"), F.col("id").alias("event_id"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("channel_name"),
        F.timestamp_seconds(F.col("id") * 7).cast("timestamp_ntz").alias("event_ts"),
    )
    t = paths.path_touches(long)
    half = 1250
    assert counts(paths.ordered_pairs(t)) == {
        (2500, "a", "a"): half * (half - 1) // 2, (2500, "b", "b"): half * (half - 1) // 2,
        (2500, "a", "b"): half * (half + 1) // 2, (2500, "b", "a"): half * (half - 1) // 2,
    }
    assert counts(paths.unordered_pairs(t)) == {
        (2500, "a", "a"): half * (half - 1) // 2, (2500, "b", "b"): half * (half - 1) // 2, (2500, "a", "b"): half * half,
    }
    steps = sequence.chrono_steps(t, ("channel_name",)).where("event_id = 1400").first()
    assert (steps.path_length, steps.forward_step, steps.backward_step) == (2500, 1401, 1100)
    assert (steps.previous_channel_name, steps.next_channel_name) == ("b", "b")


def test_long_paths_are_cut_before_the_shuffle(spark):
    t = matches(spark, (1, 1, "a"))
    plan = paths.short_paths(t, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.index("Exchange"):]


def test_against_brute_force(spark):
    m = merged(spark, SF)
    t = paths.path_touches(m)
    by_path = {}
    for r in t.collect():
        by_path.setdefault((r.transaction_id, r.item_id), []).append((r.event_ts, r.event_id, r.channel_name))
    ordered, unordered = Counter(), Counter()
    for p in by_path.values():
        p.sort()
        n = len({e for _, e, _ in p})
        for (_, _, x), (_, _, y) in itertools.combinations(p, 2):
            ordered[(n, x, y)] += 1
            unordered[(n, min(x, y), max(x, y))] += 1
    assert counts(paths.ordered_pairs(t)) == ordered
    assert counts(paths.unordered_pairs(t)) == unordered


def plain_pairs(paths_):
    found = Counter()
    for length, p in paths_:
        found.update((length, x, y) for x, y in itertools.combinations(p, 2))
    return +found


@pytest.mark.parametrize("cells", [3, 40, 1 << 22])
def test_counting_in_runs(monkeypatch, cells):
    """Whatever the runs are, whole paths and summaries over slices give the same counts."""
    monkeypatch.setattr(path_counts, "CELLS", cells)
    some = random.Random(1)
    many = [(n % 4, [some.choice(["a", "b", "c", None, "d"]) for _ in range(n)]) for n in (0, 1, 2, 3, 9, 40, 3, 1)]
    batch = pa.record_batch([pa.array([n for n, _ in many]), pa.array([p for _, p in many], pa.list_(pa.string()))], ["path_length", "path"])
    got = Counter()
    for b in path_counts.pairs_of_paths(iter([batch])):
        for r in b.to_pylist():
            got[(r["path_length"], r["channel_1"], r["channel_2"])] += r["n"]
    assert got == plain_pairs(many)
    summary = path_counts.Summary()
    codes = [some.randrange(7) for _ in range(60)]
    for start, stop in itertools.pairwise((0, 0, 1, 20, 21, 60)):
        summary.add(np.array(codes[start:stop], dtype=np.int64))
    assert {(a, b): n for a, b in zip(*np.nonzero(summary.pairs)) for n in [summary.pairs[a, b]]} == {k[1:]: n for k, n in plain_pairs([(0, codes)]).items()}


def random_touches(spark, sizes, seconds, channels, seed=0):
    some = random.Random(seed)
    rows = []
    for o, n in enumerate(sizes):
        rows += [(o, o * 10_000 + k, some.choice(channels), some.randrange(seconds)) for k in range(n)]
    some.shuffle(rows)
    return rows, matches(spark, *rows).repartition(3)


@pytest.mark.parametrize("seconds", [1, 30, 100_000])
def test_long_paths_over_slices(spark, seconds):
    """Pairs of paths that lie in several slices, with all their touches in a second or spread."""
    rows, df = random_touches(spark, [400, 3, 250, 1, 90], seconds, ["a", "b", "c", "d"])
    t = paths.path_touches(df)
    want = Counter()
    for o in range(5):
        own = sorted((s, e, c) for p, e, c, s in rows if p == o)
        want += plain_pairs([(len(own), [c for _, _, c in own])])
    for number in (1, 7, 50):
        assert counts(paths.ordered_pairs(t, long_path=60, number=number)) == want


def test_three_million_touches_in_a_second(spark):
    """One path, all at one time: its rows are spread over the slices, and nothing holds it whole."""
    n, c = 3_000_000, 30
    t = spark.range(n, numPartitions=8).select(
        F.lit(1).cast("bigint").alias("transaction_id"), F.lit(1).cast("bigint").alias("item_id"), F.col("id").alias("event_id"),
        F.concat(F.lit("c"), F.col("id") % c).alias("channel_name"), F.lit(T0).cast("timestamp_ntz").alias("event_ts"),
    )
    got = counts(paths.ordered_pairs(t, number=8))
    each = n // c
    assert got[(n, "c3", "c3")] == each * (each - 1) // 2
    assert got[(n, "c3", "c7")] == each * (each + 1) // 2 and got[(n, "c7", "c3")] == each * (each - 1) // 2
    assert len(got) == c * c and sum(got.values()) == n * (n - 1) // 2
    rows = ordered.slices(t, list(paths.OUTCOME), ["event_ts", "event_id"], 8).groupBy("_slice").count().collect()
    assert len(rows) == 8 and max(r["count"] for r in rows) < n / 5


def test_five_thousand_channels(spark):
    n = 5_500
    t = spark.range(n).select(
        F.lit(1).cast("bigint").alias("transaction_id"), F.lit(1).cast("bigint").alias("item_id"), F.col("id").alias("event_id"),
        F.concat(F.lit("c"), F.col("id") % 5000).alias("channel_name"), F.lit(T0).cast("timestamp_ntz").alias("event_ts"),
    )
    found = paths.ordered_pairs(t, long_path=1000, number=2).select("channel_1", "channel_2", "n")
    assert found.agg(F.sum("n"), F.max("n")).first() == (n * (n - 1) // 2, 3)
    assert sorted(map(tuple, found.where("channel_1 = 'c7' and channel_2 in ('c7', 'c3', 'c4000')").collect())) == [("c7", "c3", 1), ("c7", "c4000", 1), ("c7", "c7", 1)]


@pytest.mark.parametrize("seconds", [1, 25, 100_000])
@pytest.mark.parametrize("number", [1, 9])
def test_steps_over_slices(spark, seconds, number):
    rows, df = random_touches(spark, [300, 5, 200, 1], seconds, ["a", "b", "c"], seed=2)
    got = {}
    for r in sequence.with_neighbours(df, ["channel_name", "event_id"], long_path=50, number=number).collect():
        got[r.event_id] = (r.previous and tuple(r.previous), r.next and tuple(r.next), r.forward_step, r.backward_step)
    for o in range(4):
        own = sorted((s, e, c) for p, e, c, s in rows if p == o)
        times = [s for s, _, _ in own]
        for k, (s, e, c) in enumerate(own):
            side = [None if not 0 <= j < len(own) else (own[j][2], own[j][1]) for j in (k - 1, k + 1)]
            assert got.pop(e) == (*side, 1 + sum(x < s for x in times), 1 + sum(x > s for x in times))
    assert not got


def test_text_round_trip(spark):
    t = paths.path_touches(matches(spark, (1, 1, "Paid Search - Brand"), (1, 2, "b"), (1, 3, "a")))
    pairs = paths.ordered_pairs(t)
    text = paths.serialise_pairs(pairs)
    assert text.first().coocurence_pairs == "(Paid Search - Brand,a) -> 1;(Paid Search - Brand,b) -> 1;(b,a) -> 1"
    assert counts(paths.parse_pairs(text)) == counts(pairs)


def test_asymmetry(spark):
    pairs = spark.createDataFrame([(2, "a", "b", 3), (2, "b", "a", 1), (2, "c", "c", 2)], "path_length bigint, channel_1 string, channel_2 string, n bigint")
    got = {(r.channel_1, r.channel_2): (r.difference, r.comparison, r.relative_difference) for r in paths.pair_asymmetry(pairs).collect()}
    assert len(got) == 9
    assert got[("a", "b")] == (2, 1, 0.5) and got[("b", "a")] == (-2, -1, -0.5) and got[("a", "c")] == (0, 0, 0.0)


def test_mobile_only(spark):
    rows = [(1, "Mobile"), (1, None), (2, "Mobile"), (2, "PC"), (3, None), (4, "Mobile")]
    df = spark.createDataFrame([(o, 1, d) for o, d in rows], "transaction_id bigint, item_id bigint, device_type_level1 string")
    assert sorted(r.transaction_id for r in paths.exact_device_outcomes(df).collect()) == [1, 1, 4]


@pytest.mark.parametrize("long_path", [1, 3, 10**9])
def test_lengths_of_all_outcomes(spark, long_path):
    """Copies of an event count once, events and outcomes may be null, and every row stays."""
    df = matches(
        spark, (1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (1, 3, "c"), (2, 1, "a"), (3, 4, "a"), (3, 4, "b"), (None, 5, "a"), (None, 6, "a")
    ).withColumn("event_id", F.when(F.col("event_id") != 3, F.col("event_id")))
    found = paths.with_lengths(df, long_path=long_path)
    assert found.columns == [*df.columns, "path_length"] and dict(found.dtypes)["path_length"] == "bigint"
    got = sorted(((r.transaction_id, r.event_id, r.channel_name, r.path_length) for r in found.collect()), key=repr)
    assert got == sorted(
        [(1, 1, "a", 3), (1, 2, "b", 3), (1, 2, "b", 3), (1, None, "c", 3), (2, 1, "a", 1), (3, 4, "a", 1), (3, 4, "b", 1), (None, 5, "a", None), (None, 6, "a", None)],
        key=repr,
    )


def test_lengths_take_one_shuffle(spark):
    """Touches are read from a stage and shuffled once, by outcome."""
    df = matches(spark, (1, 1, "a"), (1, 2, "b"), (2, 1, "a"))
    found = paths.with_lengths(df)
    assert plans.shuffles_of(found, "event_id") == 1 and plans.shuffles_of(found, "channel_name") == 1
    assert "Join" not in plans.formatted(found)


@pytest.mark.parametrize("min_rows", [1, 10**6])
def test_mobile_only_with_hot_outcomes(spark, min_rows):
    rows = [(1, "Mobile", 0), (1, None, 1), (2, "Mobile", 2), (2, "PC", 3), (2, "Mobile", 4), (3, None, 5), (4, "Mobile", 6), (None, "Mobile", 7)]
    df = spark.createDataFrame([(o, 1, d, i) for o, d, i in rows], "transaction_id bigint, item_id bigint, device_type_level1 string, event_id bigint")
    found = paths.exact_device_outcomes(df, min_rows=min_rows)
    assert found.columns == df.columns and sorted(r.event_id for r in found.collect()) == [0, 1, 6]


def test_mobile_only_shuffles_no_matches(spark):
    """The wanted outcomes are picked before they are linked: no match is shuffled with its device, only touches are."""
    found = paths.exact_device_outcomes(valid_matches(merged(spark, SF))).select("event_id", *paths.OUTCOME, "device_type_level1")
    assert plans.shuffles_of(found, "device_type_level1") <= 1 and "Window" not in plans.formatted(found)


@pytest.mark.parametrize("long_path", [None, 1, 3, 10**9])
def test_neighbours_and_steps(spark, long_path):
    df = matches(spark, (1, 1, "a", 0), (1, 2, "b", 2), (1, 3, "c", 2), (1, 4, "d", 9000), (2, 5, "z", 1))
    got = {
        r.event_id: (r.previous and r.previous.channel_name, r.next and r.next.channel_name, r.forward_step, r.backward_step)
        for r in sequence.with_neighbours(df, ["channel_name"], long_path=long_path).collect()
    }
    assert got == {
        1: (None, "b", 1, 4), 2: ("a", "c", 2, 2), 3: ("b", "d", 2, 2), 4: ("c", None, 4, 1), 5: (None, None, 1, 1),
    }


@pytest.mark.parametrize("long_path", [1, 3, 10**9])
def test_steps_with_lengths(spark, long_path):
    df = matches(spark, (1, 1, "a", 0), (1, 2, "b", 2), (1, 3, "c", 2), (1, 4, "d", 9000), (2, 5, "z", 1), (3, 7, "y", 1), (3, 7, "y", 1), (None, 6, "x", 1))
    steps = sequence.chrono_steps(df.withColumns({"kind": F.lit("k"), "other": F.lit(1)}), ["channel_name"], attributes=["kind"], long_path=long_path)
    assert steps.columns == [
        *paths.OUTCOME, "kind", "path_length", "event_ts", "event_id", "channel_name", "previous_channel_name", "next_channel_name", "backward_step", "forward_step",
    ]
    got = sorted(
        ((r.event_id, r.path_length, r.previous_channel_name, r.next_channel_name, r.forward_step, r.backward_step) for r in steps.collect()), key=repr
    )
    assert got == sorted(
        [
            (1, 4, None, "b", 1, 4), (2, 4, "a", "c", 2, 2), (3, 4, "b", "d", 2, 2), (4, 4, "c", None, 4, 1), (5, 1, None, None, 1, 1),
            (7, 1, None, "y", 1, 1), (7, 1, "y", None, 1, 1), (6, None, None, None, 1, 1),
        ],
        key=repr,
    )


def test_steps_take_one_shuffle(spark):
    """Lengths and neighbours of staged touches need one shuffle by outcome, which carries each column once."""
    df = matches(spark, (1, 1, "a"), (1, 2, "b"), (2, 1, "a")).withColumn("other", F.lit("o"))
    steps = sequence.chrono_steps(df, ["channel_name"])
    assert plans.shuffles_of(steps, "event_id") == 1 and plans.shuffles_of(steps, "_row") == 0


def test_edges(spark):
    df = matches(spark, (1, 1, "a", 0), (1, 2, "b", 1), (2, 3, "a", 0), (2, 4, "b", 1)).withColumn("kind", F.lit("k"))
    edges = sequence.weighted_edges(sequence.with_neighbours(df, ["channel_name"]), ["kind"], ["channel_name"])
    got = {(r.current.channel_name, r.next and r.next.channel_name, r.step): r.weight for r in edges.collect()}
    assert got == {("a", "b", 2): 2, ("b", None, 1): 2}


def test_encoder_ties_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "t string")
    assert {r.t: r.n for r in encode.frequency_encoder(df, "t").collect()} == {"c": 0, "a": 1, "b": 2}


def test_any_number_of_channels(spark):
    """200 channels: four words of mask, presence strings of 200 places, and a matrix that agrees with both."""
    df = spark.range(200).select(
        F.explode(F.array(F.col("id") % 7, F.lit(99))).alias("transaction_id"), F.lit(1).cast("bigint").alias("item_id"), F.format_string("t%03d", "id").alias("t")
    ).where("transaction_id <> 99 or t < 't100'")
    encoder = encode.mask_encoder(df, "t")
    place = {r.t: r.n for r in encoder.collect()}
    want = {}
    for r in df.collect():
        want.setdefault(r.transaction_id, set()).add(place[r.t])
    masks = encode.channel_masks(df, encoder, "t")
    got = {r.transaction_id: {63 * w + k for w, m in enumerate(r.mask_words) for k in range(63) if m >> k & 1} for r in masks.collect()}
    assert got == want and masks.where("size(mask_words) = 1").select("channel_mask").where("channel_mask is null").count() == 0
    strings = {r.transaction_id: r.presence for r in encode.presence_strings(df, encoder, "t").collect()}
    assert strings == {i: "".join("1" if n in s else "0" for n in range(200)) for i, s in want.items()}
    matrix = encode.mask_matrix(masks, encoder, "t")
    assert matrix.count() == 200 * len(want) and matrix.agg(F.sum("present")).first()[0] == sum(map(len, want.values()))
    forty = encode.mask_encoder(spark.range(40).select(F.concat(F.lit("t"), "id").alias("t")), "t")
    assert forty.agg(F.max("mask"), F.max("word")).first() == (2**39, 0)


def test_mask_has_one_bit_per_channel(spark):
    rows = merged(spark, SF).select(*paths.OUTCOME, F.coalesce("channel_name", F.lit("Unassigned")).alias("channel_name"))
    masks = encode.channel_masks(rows, encode.mask_encoder(rows, "channel_name"), "channel_name")
    distinct = rows.groupBy(*paths.OUTCOME).agg(F.count_distinct("channel_name").alias("n"))
    assert masks.join(distinct, list(paths.OUTCOME)).where(F.bit_count("channel_mask") != F.col("n")).count() == 0


def test_presence(spark):
    df = matches(spark, (1, 1, "a"), (1, 2, "b"), (2, 3, "a"), (3, 4, "c"))
    encoder = encode.frequency_encoder(df, "channel_name")
    got = {r.transaction_id: r.presence for r in encode.presence_strings(df, encoder, "channel_name").collect()}
    assert got == {1: "110", 2: "100", 3: "001"}
