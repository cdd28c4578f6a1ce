"""Mix sources by temperature and realise the weights as budgeted block permutations.

A source's weight is its share of all tokens to the power a, normalised; a = 1 is the corpus as it is, a = 0 gives every
source the same.  The exponent is bisected to the largest one that meets a target entropy, unless a limit on how often a
source may be repeated asks for a larger one.  Each halving only needs sums over the table of sources, and eight
halvings (256 exponents) are tried in one job, so the sources need not fit the driver.

A source's tokens then come as whole passes over its documents and one partial pass.  Documents are dealt into blocks by
a hash of their id; the partial pass takes blocks in a permuted order while they fit the budget, and of the block that
does not fit, documents in a permuted order.  Only block totals are ranked per source, never a source's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathweave.llm.shared import cut

BLOCK_DIGITS = 3  # hex digits of the hash that name a block: 4096 blocks
STEPS = 256
ROUNDS = 5
WHITE = " \t\n\x0b\f\r"


def word_count(text) -> F.Column:
    """Words of a text, native: runs other than white space."""
    spaced = F.trim(F.translate(text, WHITE, " " * len(WHITE)))
    return F.when(F.length(spaced) > 0, F.size(F.split(spaced, " +"))).otherwise(0).cast("long")


def exponent(sources: DataFrame, entropy: float, repeats: float, budget: float | None) -> float:
    """The largest exponent in [0, 1] whose weights have ``entropy`` times the largest possible entropy, or if larger the
    smallest one that repeats no source more than ``repeats`` times.  ``sources``: tokens (> 0) of each.

    Without a budget the most common source is passed over once, and repeats count against that.  A budget of more than ``repeats`` times
    all tokens cannot keep the limit: then the exponent is 1, by which all sources repeat alike, as little as possible.
    """
    total, count, most = sources.agg(F.sum("tokens"), F.count("*"), F.max("tokens")).first()
    if not count or count == 1:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))

    def largest(meets) -> float:
        """meets(a) holds up to some exponent; the last that does (0 if none)."""
        low, width = 0.0, 1.0
        for _ in range(ROUNDS):
            tried = sources.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS)))).withColumn("a", F.lit(low) + F.col("step") * F.lit(width / STEPS))
            sums = tried.groupBy("a").agg(
                F.sum(F.pow(share, "a")).alias("z"),
                F.sum(F.pow(share, "a") * F.col("a") * F.log(share)).alias("s"),
                F.max(F.pow(share, F.col("a") - 1)).alias("steepest"),
            )
            good = [r["a"] for r in sums.where(meets).select("a").collect()]
            low, width = max(good, default=low), width / STEPS
            if not good:
                return low
            if low >= 1.0:
                return 1.0
        return low

    # entropy of the weights: log z - s / z
    flat = largest((F.log("z") - F.col("s") / F.col("z")) >= F.lit(entropy) * F.log(F.lit(float(count))))
    if budget is None:
        times = F.col("steepest") * F.pow(F.lit(most / total), 1 - F.col("a"))
    else:
        times = F.col("steepest") / F.col("z") * F.lit(float(budget) / total)
    repeated = largest(times > repeats)
    return max(flat, repeated)


def copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    entropy: float = 0.95,
    repeats: float = 4.0,
    budget_ratio: float | None = 1.0,
    seed: str = "mix",
) -> DataFrame:
    """id, source, n_tokens, block and copies (how often it comes) of each row of ``docs``.

    ``budget_ratio`` is the tokens to deal out in corpora; None passes the most common source over exactly once and every
    other at least once, so no document is lost.  Tokens are words.  Documents without tokens come once and cost
    nothing.  A null source is a source of its own ('').  Rows that repeat an id and null ids are dealt like others.
    """
    key = lambda *parts: F.md5(F.concat_ws(":", F.lit(seed), *parts))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    base = cut(
        docs.select(
            F.col(id_col), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
            word_count(F.col(text_col).cast("string")).alias("n_tokens"), F.substring(key(name), 1, BLOCK_DIGITS).alias("block"),
        ).withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
    )
    blocks = cut(base.groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block")))
    sources = cut(blocks.groupBy("source").agg(F.sum("in_block").alias("tokens")).where("tokens > 0"))
    total, most = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("tokens"), F.lit(0))).first()
    budget = None if budget_ratio is None else budget_ratio * total
    a = exponent(sources, entropy, repeats, budget)
    raw = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a))
    if budget is None:
        quota = F.greatest(F.floor(raw / F.pow(F.lit(most / (total or 1)), F.lit(a)) * F.lit(most)), F.col("tokens"))
    else:
        z = sources.agg(F.coalesce(F.sum(raw), F.lit(1.0))).first()[0]
        quota = F.floor(raw / F.lit(z) * F.lit(budget))
    plan = sources.withColumn("quota", quota).select(
        "source", F.expr("quota div tokens").alias("passes"), F.expr("quota % tokens").alias("rest")
    )
    order = W.partitionBy("source").orderBy(key(F.lit("block"), F.col("source"), F.col("block")), "block").rowsBetween(W.unboundedPreceding, -1)
    dealt = (
        blocks.join(plan, "source")
        .withColumn("before", F.coalesce(F.sum("in_block").over(order), F.lit(0)))
        .withColumn("whole", F.col("before") + F.col("in_block") <= F.col("rest"))
        .withColumn("left", F.when(~F.col("whole") & (F.col("before") < F.col("rest")), F.col("rest") - F.col("before")))
    )
    inside = W.partitionBy("source", "block").orderBy(key(F.lit("place"), name), "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    some = F.col("left").isNotNull()
    joined = base.join(dealt.select("source", "block", "passes", "whole", "left"), ["source", "block"], "left")
    part = joined.where(some).withColumn("fits", F.sum("n_tokens").over(inside) <= F.col("left"))
    rest = joined.where(~some | F.col("left").isNull()).withColumn("fits", F.coalesce("whole", F.lit(False)))
    taken = F.when(F.col("n_tokens") == 0, 1).otherwise(F.col("passes") + F.col("fits").cast("int"))
    return rest.unionByName(part).select(id_col, "source", "n_tokens", "block", F.coalesce(taken, F.lit(0)).cast("int").alias("copies"))


def schedule(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """id, source, n_tokens, epoch (from 0) and block: one row each time a document comes.  See ``copies``."""
    found = copies(docs, id_col=id_col, **how).where("copies > 0")
    return found.select(id_col, "source", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"), "block")


def mixed(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` with every row as often as it comes; its columns stay as they are."""
    found = copies(docs, id_col=id_col, **how).groupBy(F.col(id_col).alias("__id")).agg(F.max("copies").alias("__copies"))
    joined = docs.join(found, docs[id_col].eqNullSafe(F.col("__id")), "left")
    return joined.where("__copies > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[docs[c] for c in docs.columns])
