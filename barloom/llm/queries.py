"""The queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bit_planes, byte_cnn, decontaminate, fm_index, importance, minhash, piece_codec, pitman_yor, quality, spelling, sql, suffix_buckets, token_count, url_cascade
from barloom.llm.common import documents, shared_dir, words_column

Query = Callable[[SparkSession, str], DataFrame]


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), percent=85, n=5)


def _covered(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, s: a + (s["to"] - s["from"]).cast("bigint"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_buckets.remove_repeats(documents(spark, sf_dir), length=200)
    return cut.select("doc_id", "n_bytes", _covered("spans").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)
    hit = _covered("spans")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), decontaminate.items_digest(F.col("items")).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fm_index.remove_earlier(documents(spark, sf_dir), window=50)
    return cut.select("doc_id", "n_words", _covered("spans").alias("n_removed"), F.sha2(F.array_join(words_column(F.col("kept")), " "), 256).alias("kept_sha256"))


#: Sites all of whose pages are listed, and marks of junk in a page's html that put its url on the list.
LISTED_SITES = ["ads-track.example.com", "casino-win.example.net", "spam-farm.example.org", "adult-x.example.com", "cheap-pills.example.net", "free-bets.example.net"]
JUNK = r"%%%|\*\*\*|###"
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "example.net", "/de/8"), ("allow", "net", "/de/"), ("block", "org", "/es/")]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the keys (host and path) of pages of some sites and of pages whose content is junk: the url alone does not show which."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.col("html").rlike(JUNK).alias("junk"))
    host, path = url_cascade.host_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"), "junk")
    key = F.concat("host", "path")
    on_list = F.coalesce("junk", F.lit(False))
    for site in LISTED_SITES:
        on_list = on_list | (F.col("host") == site) | F.col("host").endswith("." + site)
    judged = url_cascade.listed_urls(pages.drop("junk"), key, pages.where(on_list).select(key.alias("key")))
    rule, action = url_cascade.longest_rule(F.col("host"), F.col("path"), RULES)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))


def op8_bit_plane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    bit_planes.write_ids(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), path, end_id=2)
    return bit_planes.read_ids(spark, path)


def op9_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(documents(spark, sf_dir))


def op10_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir), least=7, times=2, factor=10)


def op12_importance_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = importance.importance_ranks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=25, least_words=20, seed=7)
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


def op13_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    scored = byte_cnn.quality_scores(docs, byte_cnn.learn(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_distribution_divergence, op2_minhash_near_dedup, op3_suffix_array_dedup, op4_benchmark_decontamination, op5_token_counts, op6_substring_dedup, op7_url_filters, op8_bit_plane_ids, op9_pitman_yor_scores, op10_sentencepiece_codec, op11_spelling_variants, op12_importance_ranks, op13_byte_cnn_quality)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
