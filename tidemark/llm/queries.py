"""One query per operator over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, exact, near_dedup, ngram_join, phrases, prefix_trie, quality, repeats, sharding, suffix_tree, toxicity, url_filters
from tidemark.llm.common import remainder_of_five, table

SHARDS = 24
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ["doc_id"])
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return suffix_tree.learn_and_score(docs, remainder_of_five("doc_id") == 1)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.similar(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, remainder_of_five("doc_id") != 0)
    return model.score(docs, ["doc_id"]).select(
        "doc_id", (remainder_of_five("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source stands for the host, source and language for the path."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rated = quality.classify(docs, labels, remainder_of_five("doc_id") != 0, "doc_id", "text", F.col("source"), F.concat_ws("/", "source", "lang"))
    return rated.withColumn("held_out", remainder_of_five("doc_id") == 0)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """Changes of three lists over the hosts of a table: some hosts come, go and return, some stay, and some have one path listed."""
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    h = F.conv(F.substring(F.md5("host"), 1, 8), 16, 10).cast("bigint")
    hosts = hosts.withColumn("h", h)

    def change(where: str, name: str, kind: str, pattern: str, action: str, day: str) -> DataFrame:
        return hosts.where(where).select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), F.expr(pattern).alias("pattern"), F.lit(action).alias("action"),
                                         F.expr(f"date_add(DATE'2024-01-01', CAST({day} AS INT))").alias("at"))

    parts = [change("h % 4 = 0", "blocked", "domain", "host", "add", "h % 600"),
             change("h % 8 = 0", "blocked", "domain", "host", "remove", "h % 600 + 60"),
             change("h % 8 = 0", "blocked", "domain", "host", "add", "h % 600 + 120"),
             change("host rlike 'casino|ads|track'", "spam", "domain", "host", "add", "0"),
             change("h % 5 = 1", "paths", "prefix", "concat(host, '/de')", "add", "100"),
             change("h % 5 = 1", "paths", "prefix", "concat(host, '/de')", "remove", "500")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


FETCHED = "date_add(DATE'2024-01-01', CAST(pmod(page_id * 37, 720) AS INT))"


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("fetched_at", F.expr(FETCHED))
    return url_filters.judge(pages, dated_lists(pages), "page_id", "url", "fetched_at")


OP9_SQL = r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1)) AS host,
  regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
  DATE '2024-01-01' + (((page_id * 37) % 720 + 720) % 720)::INT AS fetched_at FROM pages),
h AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 8))::BIGINT AS h FROM p WHERE host <> ''),
e AS (
  SELECT 'blocked' AS list, host, '' AS path, DATE '2024-01-01' + (h % 600)::INT AS start, CASE WHEN h % 8 = 0 THEN DATE '2024-01-01' + (h % 600 + 60)::INT END AS stop FROM h WHERE h % 4 = 0
  UNION ALL SELECT 'blocked', host, '', DATE '2024-01-01' + (h % 600 + 120)::INT, NULL FROM h WHERE h % 8 = 0
  UNION ALL SELECT 'spam', host, '', DATE '2024-01-01', NULL FROM h WHERE regexp_matches(host, 'casino|ads|track')
  UNION ALL SELECT 'paths', host, '/de', DATE '2024-01-01' + 100, DATE '2024-01-01' + 500 FROM h WHERE h % 5 = 1),
m AS (SELECT p.page_id, e.list FROM p JOIN e ON (p.host = e.host OR (e.path = '' AND p.host LIKE '%.' || e.host))
  AND (e.path = '' OR p.path = e.path OR starts_with(p.path, e.path || '/')) AND p.fetched_at >= e.start AND (e.stop IS NULL OR p.fetched_at < e.stop)),
c AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM m GROUP BY page_id)
SELECT page_id, host, fetched_at, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_entries, coalesce(lists, '') AS lists FROM p LEFT JOIN c USING (page_id)"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_near_dedup": op4_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_url_filters": op9_url_filters,
    "op10_decontamination": op10_decontamination,
    "op11_ngram_join": op11_ngram_join,
    "op12_collocations": op12_collocations,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL = {"op8_exact_dedup": exact.QUERY_SQL, "op9_url_filters": OP9_SQL, "op12_collocations": phrases.QUERY_SQL, "op13_prefix_trie": prefix_trie.QUERY_SQL}
