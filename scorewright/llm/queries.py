"""The queries opN_<name>: each applies its operator to its whole table and derives the digests it returns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import audit, bpe, exact, fim, neardup, oracle, packing, quality, simhash, substring, tokencount, tokenfile, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, radius=3)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    both = bpe.bpe_decode(bpe.bpe_encode(_table(spark, sf_dir, "documents"), path), path)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), min_bytes=0).drop("payload")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, manifest = tokenfile.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    rows = docs.select("file", "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return rows.join(manifest.select("file", "base"), "file").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op6_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=0, keep_ids=False)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(_table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    grammar = toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id")))
    found = toxicity.score(docs, grammar)
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.drop("filter")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fim.restore(fim.transform(_table(spark, sf_dir, "documents"), plain=10, spm=20, seed=1))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_token_counts,
        op3_bpe_round_trip,
        op4_warc_bundles,
        op5_token_files,
        op6_line_first_quality,
        op7_best_fit_packing,
        op8_embedding_near_dedup,
        op9_substring_dedup,
        op10_toxicity,
        op11_exact_dedup,
        op12_filter_audit,
        op13_fill_in_middle,
    )
}
#: The others rest on a hash, a tokenizer, packing or learnt weights that SQL lacks; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_warc_bundles": oracle.WARC,
    "op6_line_first_quality": oracle.QUALITY,
    "op8_embedding_near_dedup": oracle.NEAR_DUPLICATES,
    "op9_substring_dedup": oracle.REPEATS,
    "op11_exact_dedup": oracle.EXACT,
    "op12_filter_audit": oracle.AUDIT,
    "op13_fill_in_middle": oracle.FILL_IN_MIDDLE,
}
