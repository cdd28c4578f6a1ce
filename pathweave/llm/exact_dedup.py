"""Exact duplicates by skew-safe combining.

A digest only says which texts have to be compared; whether they are equal is decided on the texts, at every stage:

1. *locally*: the partial aggregation of a task makes one row of its equal texts, before anything is shuffled;
2. *salted*: a digest with more than HOT_ROWS rows is cut into salts, each of which merges the winners of some tasks only;
3. *globally*: the winners of the salts of a digest, few by then, are combined.

Digests that are not hot have one salt, so their texts are shuffled once, and a text whose digest is hot is shuffled as often
as there are tasks and salts, not rows.  The documents find their group by digest again, without their texts; rows of
a hot digest are dealt over as many parts as it has salts.  At most MAX_HOT digests are hot, whatever the size of the data.

What is defined: a null text is empty; a null id is smaller than any other; of rows that repeat both id and text one
is kept; an empty table gives none.  Other columns are not looked at, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.shared import cut

HOT_ROWS = 100_000
MAX_HOT = 10_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _salted(rows: DataFrame, hot: DataFrame, salt: Column) -> DataFrame:
    """``rows`` with a ``_part``: 0, or one of the parts of a hot digest."""
    part = F.coalesce(F.pmod(salt, F.col("_parts")), F.lit(0)).cast("int")
    return rows.join(F.broadcast(hot), "digest", "left").withColumn("_part", part).drop("_parts")


def _winners(rows: DataFrame) -> DataFrame:
    """(digest, text, keep_id, group_size) of rows (digest, _part, text, doc_id)."""
    return rows.groupBy("digest", "_part", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).drop("_part")


def _combined(texts: DataFrame, hot: DataFrame, any_hot: bool) -> DataFrame:
    """(digest, text, keep_id, group_size), one row for each distinct text of ``texts`` (digest, text, doc_id)."""
    cold = _winners(texts.join(F.broadcast(hot), "digest", "left_anti").withColumn("_part", F.lit(0)) if any_hot else texts.withColumn("_part", F.lit(0)))
    if not any_hot:
        return cold
    of_hot = texts.join(F.broadcast(hot.select("digest")), "digest", "left_semi")
    by_salt = _winners(_salted(of_hot, hot, F.spark_partition_id()))
    globally = by_salt.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return cold.unionByName(globally)


def _assigned(rows: DataFrame, groups: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of their group; a hot digest's rows are dealt over copies of its group."""
    left = _salted(rows, hot, F.xxhash64("row"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    right = groups.join(F.broadcast(hot), "digest", "left").withColumn("_part", copies).drop("_parts")
    return left.join(right, [*keys, "_part"]).drop("_part")


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest (binary), keep_id (the largest id with an equal text), group_size and kept.

    ``digest`` may be any function of a text to BINARY; one that is the same for different texts costs time, not results.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    texts = texts.select("doc_id", "text", digest(F.col("text")).alias("digest"))
    rows = cut(texts.select("doc_id", "digest", F.monotonically_increasing_id().alias("row")))
    limit = max(hot_rows, -(-rows.count() // MAX_HOT))
    found = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    hot = cut(found.select("digest", F.ceil(F.col("n") / limit).cast("int").alias("_parts")))
    any_hot = not hot.isEmpty()
    groups = _combined(texts, hot, any_hot)
    by_digest = cut(
        groups.groupBy("digest").agg(F.count(F.lit(1)).alias("_texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    )
    one = F.lit(None).cast("string").alias("_text")
    result = _assigned(rows, by_digest.where("_texts = 1").drop("_texts"), hot, ["digest"]).select("doc_id", "digest", "row", one, "keep_id", "group_size")
    several = by_digest.where("_texts > 1").select("digest")
    if not several.isEmpty():  # different texts of one digest: their rows find their group by text
        unclear = cut(texts.withColumn("row", F.lit(None).cast("long")).join(several, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()))
        told = _assigned(unclear, _combined(unclear.drop("row"), hot, any_hot), hot, ["digest", "text"])
        result = result.unionByName(told.select("doc_id", "digest", "row", F.col("text").alias("_text"), "keep_id", "group_size"))
    same = ["digest", "_text", "doc_id"]
    best = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        kept = result.withColumn("kept", best)
    else:  # of the rows that repeat the id and text of a winner the first stays
        result = cut(result)
        winners = result.where(best)
        first = winners.groupBy(*same).agg(F.min("row").alias("_first"))
        a, b = winners.alias("a"), first.alias("b")
        match = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same]
        kept = a.join(b, match).select("a.*", (F.col("a.row") == F.col("b._first")).alias("kept"))
        kept = kept.unionByName(result.where(~best).withColumn("kept", F.lit(False)))
    return kept.select("doc_id", "digest", "keep_id", "group_size", "kept")


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text any one."""
    stay = exact_groups(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    rows = docs.withColumns({"_own_id": F.col(doc_id).cast("long"), "_own_digest": sha256(F.coalesce(text, F.lit("")))})
    match = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_digest") == F.col("_digest"))
    return rows.join(stay, match, "left_semi").dropDuplicates(["_own_id", "_own_digest"]).drop("_own_id", "_own_digest")
