"""One query for each operator, on its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import fingerprints, html, langid, mixing, packing, phrases, secrets, simhash, suffixes, tokens, topk, toxicity, tries
from quarry.llm.common import read_table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("_id") % 20 == 0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(read_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read_table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = toxicity.as_categories(read_table(spark, sf_dir, "labels"))
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), labels)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(read_table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_exact_topk": op2_exact_topk, "op3_simhash": op3_simhash, "op5_fingerprints": op5_fingerprints, "op6_secret_scan": op6_secret_scan, "op4_mixing": op4_mixing, "op7_token_counts": op7_token_counts, "op8_html_text": op8_html_text, "op9_toxicity": op9_toxicity, "op10_packing": op10_packing,
           "op11_phrases": op11_phrases, "op12_language_id": op12_language_id, "op13_prefix_trie": op13_prefix_trie}
ORACLES = {"op2_exact_topk": topk.ORACLE_SQL, "op4_mixing": mixing.ORACLE_SQL, "op11_phrases": phrases.ORACLE_SQL}
