"""Which paths hold which tokens, as bitmaps: a bit per path, in words of 63.

Paths are dealt over blocks by a hash and numbered inside a block, so 63 paths share a word, and a token has one BIGINT per word in which it occurs.
How many paths hold two tokens is the number of bits that their words have in common, summed over the words: each word is
looked at once for all its pairs, whatever the number of paths it stands for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .paths import OUTCOME

BITS = 63
BLOCKS = 4096


def bitmap_index(rows: DataFrame, token: str, outcome: Sequence[str] = OUTCOME, blocks: int = BLOCKS) -> DataFrame:
    """(_block, _word, token, bits) of rows that name the tokens of each outcome, repeated or not.

    One shuffle, by block.  Outcomes without a token have bits under the null token.
    """
    block = F.pmod(F.xxhash64(*outcome), F.lit(blocks)).alias("_block")
    place = F.dense_rank().over(W.partitionBy("_block").orderBy(*outcome)) - 1
    placed = rows.select(block, *outcome, F.col(token)).withColumn("_place", place)
    placed = placed.select("_block", F.floor(F.col("_place") / BITS).alias("_word"), token, F.expr(f"shiftleft(1L, cast(_place % {BITS} as int))").alias("_bit"))
    return placed.groupBy("_block", "_word", token).agg(F.bit_or("_bit").alias("bits"))


def common_counts(index: DataFrame, token: str, excluded: Sequence[str] = ()) -> DataFrame:
    """(token_1, token_2, n): paths with both; with ``token_1`` (``token_2`` is null); all paths (both are null).

    ``excluded`` tokens are counted among the paths only.  Pairs are sorted, and those that never meet are not listed.
    """
    words = index.groupBy("_block", "_word").agg(F.sort_array(F.collect_list(F.struct(F.col(token).alias("t"), "bits"))).alias("all"))
    shown = F.filter("all", lambda x: x["t"].isNotNull() & ~x["t"].isin(*excluded) if excluded else x["t"].isNotNull())
    words = words.withColumn("shown", shown)
    none = F.lit(None).cast("string")

    def row(one: Column, two: Column, n: Column) -> Column:
        return F.struct(one.cast("string").alias("token_1"), two.cast("string").alias("token_2"), n.cast("bigint").alias("n"))

    def with_later(one: Column, i: Column) -> Column:
        later = F.slice("shown", i + 2, F.size("shown"))
        return F.transform(later, lambda two: row(one["t"], two["t"], F.bit_count(one["bits"].bitwiseAND(two["bits"]))))

    either = F.aggregate("all", F.lit(0).cast("bigint"), lambda seen, x: seen.bitwiseOR(x["bits"]))
    found = F.concat(
        F.array(row(none, none, F.bit_count(either))),
        F.transform("shown", lambda one: row(one["t"], none, F.bit_count(one["bits"]))),
        F.filter(F.flatten(F.transform("shown", with_later)), lambda x: x["n"] > 0),
    )
    return words.select(F.inline(found)).groupBy("token_1", "token_2").agg(F.sum("n").alias("n"))
