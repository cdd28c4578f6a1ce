"""The conversation trie against a plain version."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from pathweave.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k0 string, node long, chars string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, None) for r in rows], SCHEMA)


def rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1]) if node else 0
    out = Counter()
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[(min(own), len(node), parent, len(own), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def check(spark, rows, **kind):
    turns = prefix_trie.numbered_turns(frame(spark, rows).repartition(3))
    got = prefix_trie.trie(*prefix_trie.rebuilt(turns), **kind)
    assert Counter(map(tuple, got.collect())) == plain(rebuilt(rows))


def awkward():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c % 3 if t > 1 else 0} {t}") for c in range(0, 130) for t in range(c % 6)]
    rows += [(200 + c, t, "u", "same" * t) for c in range(40) for t in range(9)]  # many alike, over several segments of few turns
    rows += [(300, t, None if t == 2 else "u", None if t == 3 else f"long {t}") for t in range(40)] + [(400, t, "u", f"long {t}") for t in range(40)]
    rows += [(500, None, "u", "no number"), (500, None, None, None), (500, 1, "u", "é🙂"), (500, 1, "u", "é🙂"), (500, 1, "a", "b")]
    rows += [(None, 1, "u", "nobody's"), (601, 0, "u", "alone"), (-7, 0, "u", "minus"), (-150, 1, "u", "x"), (-150, 2, "u", "y"), (-100, 0, "u", "base")]
    rows += [(700 + c, t, "u", "" if t == 1 else "z" * 5000) for c in (0, 3, 4) for t in range(7)]
    rows += [(800, 0, "a", "b:c"), (801, 0, "a:b", "c"), (802, 0, None, None), (803, 0, "", "")]
    return rows


@pytest.mark.parametrize("kind", [{}, {"width": 3, "shards": 9}])
def test_trie(spark, kind):
    check(spark, awkward(), **kind)


def test_empty(spark):
    check(spark, [], shards=2)
    check(spark, [(None, 0, "u", "x")])


def test_one_conversation_has_a_third_of_the_turns(spark):
    """Its turns are numbered over many slices, and its segments pass on what came before them."""
    rows = [(5, t, "u", f"{t % 50}") for t in range(300)] + [(100 + c, t, "u", f"{t % 50}") for c in range(30) for t in range(20)]
    check(spark, rows, width=16, shards=5)


def test_places_do_not_depend_on_slices(spark):
    from pathweave.operators.ordered import numbered

    df = spark.range(5000).selectExpr("id % 3 as g", "id", "cast(id / 700 as int) as t")
    found = numbered(df, ["g"], ["t", "id"], "n", number=13)
    assert {(r.g, r.id): r.n for r in found.collect()} == {(i % 3, i): i // 3 + 1 for i in range(5000)}
