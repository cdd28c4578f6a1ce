"""Exact duplicates and vector codes against plain versions."""

import hashlib
import math
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from pathweave.llm import cover_tree, exact_dedup


def plain_groups(rows):
    ids = defaultdict(list)
    for i, t in rows:
        ids[t or ""].append(i)
    out, seen = Counter(), set()
    for i, t in rows:
        own = ids[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        kept = i == keep and (i, t or "") not in seen
        if kept:
            seen.add((i, t or ""))
        out[(i, keep, len(own), kept)] += 1
    return out


def weak(text):
    """A digest of two bits: nearly all texts share theirs with others."""
    return F.unhex(F.translate(F.substring(F.md5(text), 1, 1), "0123456789abcdef", "0123012301230123"))


@pytest.mark.parametrize("hot_rows", [exact_dedup.HOT_ROWS, 1])
@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
def test_exact_groups(spark, digest, hot_rows):
    df = brute.awkward(spark, 500)
    again = df.union(df.where("doc_id = 7 or doc_id is null")).union(df.where("doc_id = 5")).repartition(7)
    rows = [(r.doc_id, r.text) for r in again.select("doc_id", "text").collect()]
    got = exact_dedup.exact_groups(again, digest=digest, hot_rows=hot_rows).drop("digest")
    assert Counter(map(tuple, got.collect())) == plain_groups(rows)
    assert exact_dedup.exact_groups(brute.none(spark), digest=digest, hot_rows=hot_rows).count() == 0


def test_a_third_of_all_rows_are_copies(spark):
    """Winners of a hot digest are made in each task, and no task gets all of its rows."""
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_groups(df.repartition(8), hot_rows=500)
    assert got.where("keep_id = 29997 and group_size = 10000").count() == 10_000
    assert got.where("kept").count() == 20_001
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = exact_dedup.exact_groups(df.repartition(8), hot_rows=500)
        hot = got.where("group_size > 1").withColumn("at", F.spark_partition_id()).groupBy("at").count().agg(F.max("count")).first()[0]
        assert hot < 3_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_without_copies(spark):
    df = brute.awkward(spark, 500)
    stay = exact_dedup.without_copies(df)
    assert stay.columns == df.columns
    want = Counter({(i, t or ""): 1 for (i, t) in {(r.doc_id, r.text or "") for r in df.collect()} if i == max((r.doc_id or -1 for r in df.collect() if (r.text or "") == t), default=None)})
    assert Counter((r.doc_id, r.text or "") for r in stay.collect()) == want


def plain_codes(vectors, parts=4, entries=256, rounds=4):
    """(id, code, error) and the codebooks of (id, vector) rows, in Python integers."""
    kept = [(i, v) for i, v in vectors if v and not any(x is None or not math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(1024 * x) for x in v] for _, v in kept]
    d = len(whole[0]) // parts
    cut = [[v[p * d : (p + 1) * d] for v in whole] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def nearest(part, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(books[part]))

    for _ in range(rounds):
        for part in range(parts):
            members = defaultdict(list)
            for x in cut[part]:
                members[nearest(part, x)[1]].append(x)
            books[part] = [[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else y for e, y in enumerate(books[part])]
    out = Counter()
    for k, (i, _) in enumerate(kept):
        found = [nearest(part, cut[part][k]) for part in range(parts)]
        out[(i, "".join(f"{e:02x}" for _, e in found), sum(x for x, _ in found))] += 1
    return out, ",".join(str(c) for book in books for y in book for c in y)


def check_codes(spark, rows, **kind):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, code string, error long")
    fitted = cover_tree.Codes(df.repartition(3), **kind)
    want, books = plain_codes(rows, **kind)
    got = Counter((r.vec_id, r.code, r.error) for r in fitted.codes().collect())
    assert got == want
    assert fitted.books_sha256() == hashlib.sha256(books.encode()).hexdigest()


def test_codes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(i % 7, 0.05, 8)]) for i in range(400)]
    rows += [(i, rows[i % 5][1]) for i in range(400, 450)]  # copies
    rows += [(500, None), (501, [None] + [0.5] * 7), (502, [math.nan] * 8), (503, [math.inf] * 8), (505, []), (None, rows[3][1]), (7, rows[9][1])]
    check_codes(spark, rows, entries=20)
    check_codes(spark, rows[:10])  # fewer vectors than entries
    check_codes(spark, [(i, [0.25] * 8) for i in range(50)], entries=4, rounds=2)  # all alike: ties


def test_codes_over_several_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.choice([-1, 0, 1], 4) + rng.normal(0, 0.01, 4)]) for i in range(4000)]
    check_codes(spark, rows, entries=16, rounds=2)


def test_codes_of_large_components(spark):
    rows = [(i, [float((-1) ** i * 10**11 + i * k) for k in range(4)]) for i in range(60)]
    check_codes(spark, rows, parts=2, entries=4, rounds=2)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    fitted = cover_tree.Codes(df, columns=("label",))
    assert fitted.codes().columns == ["vec_id", "label", "code", "error"] and fitted.codes().count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        cover_tree.Codes(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_whole_subtrees_are_assigned():
    """Well separated clusters need few comparisons, and each place is assigned once."""
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(0, 1, (900, 4)) + 1000 * rng.integers(0, 5, (900, 1)))
    tree = cover_tree.Tree(x)
    book = np.repeat(np.arange(5)[:, None] * 1000.0, 4, axis=1)
    found = list(tree.assign(x[tree.order], book))
    places = np.concatenate([np.arange(a, e) for at, end, _ in found for a, e in zip(at, end)])
    assert sorted(places) == list(range(900)) and sum(len(at) for at, _, _ in found) < 100
    for at, end, entry in found:
        for a, e, y in zip(at, end, entry):
            assert (np.abs(x[tree.order][a:e] - book[y]) < 400).all()
