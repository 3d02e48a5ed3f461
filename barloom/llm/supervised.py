"""What the supervised text scorers share: folds, bounded samples of labelled rows, scoring of whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fold

FOLDS = 5


def even_share(key) :
    """A number in [0, 1) from a hash of ``key``."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 31)) / float(1 << 31)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int) -> DataFrame:
    """Rows (text, y): about ``per_class`` documents of each label, chosen by a hash of the id, without fold ``held``.

    Ids that are null, have a null label or differing labels are not learnt from; of rows that repeat an id only one is.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).filter("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").filter(fold(F.col("id"), folds) != held)
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, per_class / max(counts.get(1, 0), 1)).otherwise(per_class / max(counts.get(0, 0), 1))
    chosen = known.filter(even_share("id") < share).select("id", "y")
    # about two times per_class ids, whatever the size of the tables
    return documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def scorer(model, spark):
    """A column function text -> probability; ``model`` needs ``score(texts)`` and is of fixed size."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(list(texts)), dtype=float)

    return score


def score_documents(documents: DataFrame, model, limit: float = 0.5, folds: int = FOLDS) -> DataFrame:
    """One row per row of ``documents``: doc_id, held_out, score, predicted (1 from ``limit`` on).

    Null and empty texts are scored as the empty text; a null doc_id is kept with held_out null; repeated rows
    are scored alike; other columns are ignored; an empty table gives an empty result.
    """
    score = scorer(model, documents.sparkSession)
    rows = documents.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= limit).cast("int"))


def below(documents: DataFrame, model, limit: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that score under ``limit``, all columns as they are.

    Null and empty texts are scored as the empty text; repeated rows all stay or all go; an empty table stays empty.
    """
    return documents.filter(scorer(model, documents.sparkSession)(documents["text"]) < limit)
