"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm import bpe, cover_tree, exact_dedup, licenses, mixing, ngram_join, prefix_trie, quality, substring, token_files, topk, toxicity, warc
from pathweave.llm.shared import cut, new_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), to)
    records = warc.with_sizes(warc.read_archives(spark, to))
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def held_out():
    """Rows whose labels are for measuring only."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs, licenses.fit(docs))
    probability = F.round(F.array_max(F.transform("found", lambda x: x["probability"])), 6)
    return found.select("doc_id", "n_paragraphs", F.array_join("families", ",").alias("families"), "unconfirmed", probability.alias("probability"))


@query
def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


@query
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = new_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), to, BYTE_BPE)
    return token_files.read_tokens(spark, to, with_ids=False)


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.withColumn("digest", F.lower(F.hex("digest"))).withColumnRenamed("digest", "text_sha256")


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.rebuilt(turns))


@query
def op13_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = cover_tree.Codes(table(spark, sf_dir, "embeddings"), columns=("label",))
    codes = cut(fitted.codes())
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(fitted.books_sha256()).alias("codebooks_sha256")
    )


ORACLES["op9_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

ORACLES["op2_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h, n) END AS first FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

ORACLES["op11_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

# CRC-32 of the characters of x, which are ASCII, bit by bit
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(x) + 1),
  lambda i: list_concat([1000 + ascii(x[i])::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b - 1000) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""

ORACLES["op12_prefix_trie"] = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM conversations WHERE conv_id IS NOT NULL),
cv AS (SELECT c, c - c % 100 AS base, {_CRC32} % 6 AS h FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS x FROM t)),
re AS (SELECT cv.c, 0 AS own, place, r, x FROM cv JOIN t ON t.c = cv.base AND place <= h
  UNION ALL SELECT cv.c, 1, place, r, x FROM cv JOIN t ON t.c = cv.c AND place > h),
m AS MATERIALIZED (SELECT c, row_number() OVER w AS d, list(sha256(concat(length(r), ':', r, x))) OVER w AS node, length(x) AS chars
  FROM re WINDOW w AS (PARTITION BY c ORDER BY own, place ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c, 0, []::VARCHAR[], 0 FROM cv),
len AS (SELECT c, max(d) AS d FROM m GROUP BY c),
n AS MATERIALIZED (SELECT node, m.d, min(m.c) AS c, count(*) AS n, any_value(chars) AS chars, count(*) FILTER (WHERE len.d > m.d) = 0 AS leaf,
  coalesce(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) FILTER (WHERE len.d = m.d), '') AS ends FROM m JOIN len USING (c) GROUP BY node, m.d),
kids AS (SELECT node[1:d - 1] AS node, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
sums AS (SELECT m.node, count(*) FILTER (WHERE n.leaf) AS leaves, sum((n.n - 1) * n.chars) AS saved FROM n JOIN m ON m.c = n.c AND m.d <= n.d GROUP BY m.node)
SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN sums ON sums.node = n.node LEFT JOIN kids ON kids.node = n.node LEFT JOIN n p ON n.d > 0 AND p.node = n.node[1:n.d - 1]
"""


def _codes_sql(parts: int = cover_tree.PARTS, entries: int = cover_tree.ENTRIES, rounds: int = cover_tree.ROUNDS) -> str:
    views = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS k, vec_id, label,
          list_transform(embedding, lambda x: floor({cover_tree.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""p AS MATERIALIZED (SELECT k, part, c, list_inner_product(c, c) AS cc FROM (SELECT k, part,
          v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS c FROM v, (SELECT unnest(range({parts})) AS part)))""",
        f"b0 AS MATERIALIZED (SELECT part, k - 1 AS e, c, cc FROM p WHERE k <= {entries})",
    ]
    for r in range(rounds + 1):
        views.append(
            f"""a{r} AS MATERIALIZED (SELECT p.k, p.part, min({{'d': p.cc + b.cc - 2 * list_inner_product(p.c, b.c), 'e': b.e}}) AS m
            FROM p JOIN b{r} b ON p.part = b.part GROUP BY p.k, p.part)"""
        )
        if r < rounds:
            views.append(
                f"""b{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.c, b.c) AS c, list_inner_product(coalesce(n.c, b.c), coalesce(n.c, b.c)) AS cc
                FROM b{r} b LEFT JOIN (SELECT part, e, list(x ORDER BY i) AS c FROM (
                  SELECT part, e, i, floor(sum(x) / count(*)) AS x FROM (
                    SELECT p.part, a.m.e AS e, unnest(p.c) AS x, generate_subscripts(p.c, 1) AS i FROM p JOIN a{r} a ON p.k = a.k AND p.part = a.part)
                  GROUP BY part, e, i) GROUP BY part, e) n ON b.part = n.part AND b.e = n.e)"""
            )
    views.append(
        f"""f AS MATERIALIZED (SELECT k, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY k)"""
    )
    views.append(
        f"""h AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, i)) AS codebooks_sha256
        FROM (SELECT part, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM b{rounds}))"""
    )
    return (
        "WITH " + ",\n".join(views) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,"
        " codebooks_sha256 FROM f JOIN v USING (k) CROSS JOIN h"
    )


ORACLES["op13_cover_tree_codes"] = _codes_sql()
