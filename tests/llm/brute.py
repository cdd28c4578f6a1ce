"""Plain versions of the operators, and a small table of awkward rows."""

import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, a string, n_words string, kept string, score string, block int, copies int, record string"


def awkward(spark, long_words=60_000):
    base = " ".join(f"w{i}" for i in range(80))
    texts = [
        (1, base), (2, base), (3, base + " tail"), (4, "Head " + base.upper()), (5, None), (6, ""), (7, " \n\t "), (8, "a b c"), (9, "A  B\nc"),
        (10, "ünïcode 日本語   🙂 x" + " é" * 70), (11, " ".join(f"q{i % 977}" for i in range(long_words))), (None, base), (None, None), (12, "x" * 100_000),
        (13, base), (13, base), (14, "same id one " + base), (14, "same id two"), (15, "it's <|endoftext|> he'll  go\r\n\n"), (16, "0 " * 60 + "idiot"),
        (17, " ".join(f"v{i}" for i in range(60)) + " " + base),
    ]
    rows = [(i, t, None if i == 3 else "en", None if i in (2, 9) else f"s{(i or 0) % 3}", None, 7, None, "x", "y", None, "z", 1, None, "r") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def groups(rows):
    """(id, size) to component for rows (id, text)."""
    sets = [(i, shingles(t)) for i, t in rows]
    inverted, parent = defaultdict(list), {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared = Counter()
    for k, (_, s) in enumerate(sets):
        for g in s:
            shared.update((j, k) for j in inverted[g])
            inverted[g].append(k)
    for (j, k), n in shared.items():
        if 100 * n >= 75 * (len(sets[j][1]) + len(sets[k][1]) - n):
            a, b = root(sets[j][0]), root(sets[k][0])
            parent[max(a, b)] = min(a, b)
    return Counter((i, len(s), root(i)) for i, s in sets)


def kept(rows, length=50):
    """(id, n_words, n_removed, kept) for rows (id, text)."""
    owner = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - length + 1):
            if i is not None:
                g = tuple(w[k : k + length])
                owner[g] = min(owner.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - length + 1):
            if i is not None and owner[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def statistics(text):
    w = WORD.findall(text or "")
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    many = Counter(tri)
    inside = {k + j for k, g in enumerate(tri) if many[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)
