"""The queries of the corpus operators, with the SQL they must agree with where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import (
    block_search, decontaminate, language, lexical, mixing, ngram_join, quality, runs, secret_scan, token_files, toxicity, url_rules, vector_dups,
)
from barloom.llm.common import table
from barloom.llm.supervised import score_documents


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_rows(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")), limit=0.3)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.link_vectors(table(spark, sf_dir, "embeddings"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_history(table(spark, sf_dir, "documents")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search.nearest_vectors(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(table(spark, sf_dir, "documents"), runs.repeated_tail)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_language_id, op3_toxicity, op4_token_files, op5_ngram_join,
        op6_quality, op7_source_mix, op8_vector_dups, op9_url_rules, op10_secret_scan,
        op11_lexical_search, op12_block_search, op13_periodic_runs,
    )
}
ORACLES = {"op9_url_rules": url_rules.SQL, "op11_lexical_search": lexical.SQL, "op12_block_search": block_search.SQL}
