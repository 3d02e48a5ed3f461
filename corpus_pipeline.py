"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between stages the documents are
written as Parquet to the shared folder and read again. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontaminate, mixing, ngram_join, supervised, token_files, toxicity
from barloom.llm.common import table
from barloom.session import cut_lineage, recorded_tables, remove_tables


#: Bytes of words that a task remembers while it encodes; its executor's memory is shared with what other stages left.
WORD_MEMORY = 96 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject."""
    return supervised.below(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return ngram_join.one_of_each(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.without_contamination(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources at their target weights, one row per copy taken."""
    return mixing.mix_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: one row per row of the mix."""
    return token_files.token_report(docs, public_tokenizers.path("byte_bpe_50k.json"), memory=WORD_MEMORY, shared=False)


#: Rows and bytes that end an Arrow batch; a batch is held whole by a Python worker, and beside the heap by its executor.
BATCH_ROWS, BATCH_BYTES = 2000, 1 << 20


def _in_small_batches(stage):
    """``stage`` with texts sent to Python in batches of bounded size, whoever runs it."""

    @wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return call


STAGES = [
    ("toxicity", _in_small_batches(drop_toxic)),
    ("ngram_join", _in_small_batches(keep_one_of_each_group)),
    ("decontamination", _in_small_batches(drop_contaminated)),
    ("mixing", _in_small_batches(mix_sources)),
    ("token_files", _in_small_batches(write_tokens)),
]
#: A trained classifier, hashes and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. When a stage's result is written, the tables it and its predecessor left are removed."""
    docs, old = table(spark, sf_dir, "documents"), []
    *early, (_, last) = STAGES
    for _, stage in early:
        with recorded_tables() as written:
            docs = cut_lineage(stage(spark, docs, sf_dir))
        *left, kept = written
        remove_tables(spark, [*old, *left])
        old = [kept]
    return last(spark, docs, sf_dir)
