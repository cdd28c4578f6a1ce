"""A training corpus from the documents table, in five stages; each calls one operator of pathweave.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm import bpe, mixing, ngram_join, substring, toxicity
from pathweave.llm.queries import BYTE_BPE, held_out
from pathweave.llm.shared import cut, new_path

#: A source is passed over at most twice.
REPEATS = 2.0
ENTROPY = 0.95


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject, as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, ~held_out())
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; rows without an id stay.

    Of rows that repeat both id and text one stays, the least by its other columns; rows of one id with different texts
    are told apart by nothing else and stay or go together.
    """
    groups = ngram_join.similar_groups(docs)
    others = groups.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    repeated = cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("least"))
    once = once.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"least.{c}").alias(c) for c in docs.columns])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long passages that an earlier document has; other texts as they are."""
    cut = substring.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of rarer sources up to twice."""
    return mixing.mixed(docs, entropy=ENTROPY, repeats=REPEATS, budget_ratio=None)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of the ids and of what they decode to."""
    coded = bpe.encode(docs, BYTE_BPE, decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("temperature_mixing", mix_sources),
    ("bpe", to_tokens),
]

# A trained model, graph components and BPE are not expressible in SQL; tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
