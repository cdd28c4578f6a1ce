"""Encode the set of channels (or tokens) of an outcome."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .paths import OUTCOME

MASK_BITS = 63


def frequency_encoder(df: DataFrame, token: str) -> DataFrame:
    """``n``: 0-based rank of a token by falling count, equal counts by name.

    The ranking runs over the list of tokens, not over the rows.
    """
    counts = df.groupBy(token).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select(
        token, "cnt", (F.row_number().over(W.orderBy(F.desc("cnt"), token)) - 1).alias("n")
    )


def mask_encoder(df: DataFrame, token: str) -> DataFrame:
    """Where each token's bit is: ``word`` and, in it, ``mask``; 63 tokens to a word, so words stay positive."""
    word, mask = F.expr(f"cast(n div {MASK_BITS} as int)"), F.expr(f"shiftleft(1L, n % {MASK_BITS})")
    return frequency_encoder(df, token).select(token, "n", word.alias("word"), mask.alias("mask"))


def channel_masks(
    df: DataFrame, encoder: DataFrame, token: str, outcome: Sequence[str | Column] = OUTCOME
) -> DataFrame:
    """Bitmask of the distinct tokens of each outcome, for any number of tokens.

    ``mask_words`` holds a BIGINT for every 63 tokens, up to the last one that
    has a bit set; ``channel_mask`` is the only word where there is one, else
    null.  Spark broadcasts the encoder while it is small.
    """
    coded = df.join(encoder.select(token, "word", "mask"), token, "left")
    words = coded.groupBy(*outcome, F.coalesce("word", F.lit(0)).alias("_word")).agg(
        F.coalesce(F.bit_or("mask"), F.lit(0)).alias("_mask")
    )
    names = [c for c in words.columns if c not in ("_word", "_mask")]
    sets = words.groupBy(*names).agg(
        F.map_from_entries(F.collect_list(F.struct("_word", "_mask"))).alias("_masks"), F.max("_word").alias("_last")
    )
    dense = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda i: F.coalesce(F.col("_masks")[i], F.lit(0).cast("bigint")))
    only = F.when(F.size("mask_words") == 1, F.col("mask_words")[0])
    return sets.withColumn("mask_words", dense).select(*names, only.alias("channel_mask"), "mask_words")


def presence_strings(
    df: DataFrame, encoder: DataFrame, token: str, outcome: Sequence[str | Column] = OUTCOME
) -> DataFrame:
    """0/1 string per outcome, position ``n`` telling whether token ``n`` occurs, for any number of tokens."""
    sized = encoder.select(token, "n", F.max("n").over(W.partitionBy()).alias("_last"))
    codes = df.join(sized, token).groupBy(*outcome).agg(
        F.array_sort(F.collect_set("n")).alias("_codes"), F.max("_last").alias("_last")
    )
    # zeros up to each code, then its one; zeros after the last: work follows the string, not codes times tokens
    gaps = F.transform("_codes", lambda c, i: c - F.when(i > 0, F.col("_codes")[i - 1]).otherwise(-1) - 1)
    ones = F.array_join(F.transform(gaps, lambda g: F.concat(F.repeat(F.lit("0"), g), F.lit("1"))), "")
    rest = F.repeat(F.lit("0"), F.col("_last") - F.element_at("_codes", -1))
    return codes.withColumn("presence", F.concat(ones, rest)).drop("_codes", "_last")


def mask_matrix(masks: DataFrame, encoder: DataFrame, token: str, excluded: Sequence[str] = ()) -> DataFrame:
    """Long presence matrix: each kind of path (its mask), how many there are, and each token's 0/1.

    Equal masks are counted first, so the matrix has one row per kind of path
    and token.
    """
    kinds = masks.groupBy("channel_mask", "mask_words").agg(F.count(F.lit(1)).alias("n_paths"))
    last = encoder.agg(F.max("n")).scalar()
    tokens = encoder.where(~F.col(token).isin(*excluded)) if excluded else encoder
    word = F.coalesce(F.get("mask_words", F.col("word")), F.lit(0).cast("bigint"))
    return (
        kinds.select("*", F.explode(F.sequence(F.lit(0), last)).alias("n"))
        .join(tokens.select(token, "n", "word", "mask"), "n")
        .select(
            "channel_mask", "mask_words", "n_paths", token,
            (word.bitwiseAND(F.col("mask")) != 0).cast("int").alias("present"),
        )
    )
