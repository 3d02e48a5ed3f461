"""Helpers shared by the corpus operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barloom.session import cut_lineage

#: What separates words in every contract: ASCII blanks only.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_case(c: Column) -> Column:
    """A-Z in lower case, all else untouched."""
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow where ``fn`` turns an iterator of batches into tuples of columns."""
    fields = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)

    def run(batches):
        for columns in fn(batches):
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, arrow)], schema=arrow)

    return df.mapInArrow(run, fields)


#: Largest list of row keys sent to every task, at some 30 bytes a row; a longer one is joined by shuffle.
SENT_ROWS = 500_000


def small_side(df: DataFrame) -> DataFrame:
    """``df`` written and counted: broadcast when it has at most ``SENT_ROWS`` rows, else left to a shuffle join."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def slices(df: DataFrame, *order) -> DataFrame:
    """Range-partition by ``order`` and keep each row's slice number; written, so that slices stay fixed."""
    return cut_lineage(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))


def carried(sliced: DataFrame, value: str, key: str) -> DataFrame:
    """Per slice, the last non-null ``value`` (by ``key``) of the slices before it; one row a slice."""
    last = sliced.filter(F.col(value).isNotNull()).groupBy("_slice").agg(F.max_by(value, key).alias("_last"))
    every = sliced.select("_slice").distinct().join(last, "_slice", "left")
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("_slice", F.last("_last", ignorenulls=True).over(before).alias("_carry"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps; every step is an aggregate with map-side combine and
    a join of two written tables, which adaptive execution splits at a hub. Each step is written to the shared folder.
    """
    links = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = links.union(links.select("v", "u")).toDF("u", "v")
        low = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut_lineage(large)
        low = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(low, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        links = cut_lineage(small.distinct())
        now = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(hash(u, v))")).first()
        if now == state:
            break
        state = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.toDF("node", "root").union(roots)
