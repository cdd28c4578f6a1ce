"""Quality rules: a learned decision list over native text statistics.

The statistics are built-in Spark expressions.  Arrays that several steps need are bound once with ``transform`` over an
array of one, because an expression repeated inside a lambda would be evaluated again for every element.

Sequential covering learns the list on the driver from the statistics of a bounded sample of labelled texts: grow a
conjunction of threshold tests by information gain on two thirds of the sample, prune its last tests on the other third,
keep it if what it covers there is precise enough, take the covered texts away, and go on.  The list becomes one ordered
CASE expression, so judging all texts is native again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.mixing import WHITE
from pathweave.llm.shared import cut

SAMPLE = 8192  # labelled texts that are fitted at most
PRECISION = 0.9  # of a rule on the texts it was not grown on
MIN_COVER = 5
MAX_TESTS = 4
CUTS = 48  # thresholds tried per statistic
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")

_BLANKS = " " * len(WHITE)
# neighbouring equal hashes in sorted order mark both windows; each marked window adds the words that the one before left
_REPEATS = """
transform(array({words}), w -> if(size(w) < 4, 0, aggregate(sort_array(flatten(transform(filter(
  transform(array(sort_array(transform(
    arrays_zip(slice(w, 1, size(w) - 2), slice(w, 2, size(w) - 2), slice(w, 3, size(w) - 2)),
    (x, i) -> named_struct('h', xxhash64(x.`0`, x.`1`, x.`2`), 'i', i)))),
    s -> arrays_zip(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1)))[0],
  y -> y.`0`.h = y.`1`.h), y -> array(y.`0`.i, y.`1`.i)))),
  named_struct('n', 0, 'last', -3), (a, x) -> named_struct('n', a.n + least(3, x - a.last), 'last', x), a -> a.n)))[0]
"""


def _dropped(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and COUNTS (long) of each whole text; a null text has none of anything.

    word_chars: characters in words; n_symbols: of ``#*$%&|<>``; n_dup_lines: lines with a word that equal an earlier one;
    n_repeat_words: words in 3-word windows found at least twice (windows are compared by a 64-bit hash within the text);
    n_lines: lines with a word; n_capitals: A-Z; n_marks: exclamation marks.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(F.translate(text, WHITE, _BLANKS), " +"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.translate(x, WHITE, _BLANKS))) > 0)
    rows = docs.select(F.col(id_col), text.alias("__text"), words.alias("__words"), lines.alias("__lines"))
    t = F.col("__text")
    made = {
        "n_words": F.size("__words"),
        "word_chars": F.length(F.translate(t, WHITE, "")),
        "n_symbols": _dropped(t, SYMBOLS),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.expr(_REPEATS.format(words="__words")),
        "n_lines": F.size("__lines"),
        "n_capitals": _dropped(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_marks": _dropped(t, "!"),
    }
    return rows.select(id_col, *[c.cast("long").alias(n) for n, c in made.items()])


def shares() -> dict[str, Column]:
    """What the rules test: sizes and shares of the counts."""

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
        "marks": share("n_marks", "n_words"),
    }


@dataclass
class Rule:
    """Texts that pass all tests (statistic, above, threshold) are of low quality."""

    tests: list[tuple[str, bool, float]] = field(default_factory=list)
    precision: float = 0.0

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        good = np.ones(len(next(iter(x.values()))), bool)
        for name, above, t in self.tests:
            good &= x[name] > t if above else x[name] <= t
        return good

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, t in self.tests:
            value = shares()[name]
            out = out & (value > F.lit(t) if above else value <= F.lit(t))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if a else '<='} {t:.6g}" for n, a, t in self.tests)


def _gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    return p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2((p0 + 1e-9) / (p0 + n0 + 1e-9)))


def _grow(x: dict[str, np.ndarray], low: np.ndarray) -> Rule:
    rule, inside = Rule(), np.ones(len(low), bool)
    while len(rule.tests) < MAX_TESTS and (~low & inside).any():
        p0, n0 = (low & inside).sum(), (~low & inside).sum()
        best, found = 1e-9, None
        for name, values in x.items():
            v, y = values[inside], low[inside]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1)[1:-1]))
            at_most = v[:, None] <= cuts
            p, n = (at_most & y[:, None]).sum(axis=0), (at_most & ~y[:, None]).sum(axis=0)
            for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                g = np.where(a >= MIN_COVER, _gain(p0, n0, a, b), -1)
                k = int(g.argmax()) if len(g) else 0
                if len(g) and g[k] > best:
                    best, found = g[k], (name, above, float(cuts[k]))
        if found is None:
            break
        name, above, t = found
        sign = 1.0 if above else -1.0  # move the threshold from the edge of the other texts to the middle of the gap
        v, y = sign * x[name][inside], low[inside]
        edge = float(np.quantile(v[y & (v > sign * t if above else v >= sign * t)], 0.01))
        other = float(v[~y & (v < edge)].max(initial=sign * t))
        found = name, above, sign * max(sign * t, (edge + max(other, sign * t)) / 2) if edge > sign * t else t
        rule.tests.append(found)
        inside &= Rule([found]).covers(x)
    return rule


def learn(x: dict[str, np.ndarray], low: np.ndarray, seed: int = 0) -> list[Rule]:
    """The ordered rules for low quality; empty if the labels are of one kind or nothing precise is found."""
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    left = np.ones(len(low), bool)
    while (low & left).sum() >= 3 * MIN_COVER:
        rows = np.flatnonzero(left)
        grow = np.zeros(len(low), bool)
        grow[rng.permutation(rows)[: 2 * len(rows) // 3]] = True
        prune = left & ~grow
        part = lambda where: {k: v[where] for k, v in x.items()}
        rule = _grow(part(grow), low[grow])
        if not rule.tests:
            break
        at, y, best = part(prune), low[prune], None
        for n in range(len(rule.tests), 0, -1):
            inside = Rule(rule.tests[:n]).covers(at)
            p, q = int((inside & y).sum()), int((inside & ~y).sum())
            worth = (p - q) / max(1, p + q)
            if best is None or worth >= best[0]:
                best = worth, n, (p + 1) / (p + q + 2)
        rule = Rule(rule.tests[: best[1]], best[2])
        covered = rule.covers(x) & left
        if rule.precision < PRECISION or not (covered & low).any():
            break
        rules.append(rule)
        left &= ~covered
    return rules


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[Rule]:
    """Learn from at most SAMPLE labelled texts, the first in the order of the ids' MD5; null ids and labels are not used."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, (F.col(label_col) == 0).alias("__low")).distinct()
    rows = stats.join(known, id_col).orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(SAMPLE)
    rows = rows.select("__low", *[c.alias(n) for n, c in shares().items()]).collect()
    x = {n: np.array([r[n] for r in rows], float) for n in shares()}
    return learn(x, np.array([r["__low"] for r in rows], bool))


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that covers a text, null if none does: one ordered conditional expression."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(rule.column(), i) if out is None else out.when(rule.column(), i)
    return (F.lit(None) if out is None else out).cast("int")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, the counts, base_failed, rule (of the decision list, null if none) and kept of each row of ``docs``.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows; these are not kept.  The list is
    learned from texts that pass.  Null texts have no words and fail; ids may be null or repeated; an empty table gives
    an empty result, and without labels of both kinds every text that passes is kept.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = cut(statistics(docs, id_col, text_col).withColumn("base_failed", failed))
    rules = fit(stats.where(~F.col("base_failed")), labels, id_col, label_col)
    judged = stats.withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
