"""The five stages in a row on odd rows, against the stages one by one."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import decontaminate


def test_stages_one_by_one(spark, tmp_path):
    body = " ".join(f"w{k}" for k in range(60))
    texts = [body, body + " tail", "short text", "", None, "a b c " * 30, "zz " * 50, "another one, quite plain"]
    docs = [(k if k != 6 else None, t, "en", "s1" if k % 2 else None, len(t or "")) for k, t in enumerate(texts)] + [(0, body, "en", None, len(body))]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "quite plain another one")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, 0), (0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rows = spark.read.parquet(f"{d}/documents.parquet")
    columns = rows.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = spark.createDataFrame(stage(spark, rows, d).collect(), rows.schema)
        assert rows.columns == columns, name
    want = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, rows, d).collect()), key=repr)
    got = sorted(map(tuple, corpus_pipeline.run(spark, d).collect()), key=repr)
    assert got == want and want


def test_each_stage_alone_bounds_its_batches(spark, tmp_path):
    """A driver that runs the stages without ``run`` gets small batches too."""
    limits = [f"spark.sql.execution.arrow.{x}PerBatch" for x in ("maxRecords", "maxBytes")]
    d, wide = str(tmp_path), spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("abcde"), 1000).alias("text"))
    docs = spark.createDataFrame([(k, f"text number {k}", "en", "s", 13) for k in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "quite plain another one")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    for name, stage in corpus_pipeline.STAGES:
        for x in limits:
            spark.conf.unset(x)
        stage(spark, docs, d)
        largest = max(r.n for r in wide.mapInArrow(sizes, "n long").collect())
        assert largest < corpus_pipeline.BATCH_BYTES + 50_000, (name, largest)


def test_search_makes_no_rows_on_the_driver(spark):
    """No empty table of the driver's is part of the result, which may take further Python workers on executors."""
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("one two three four five").alias("text"))
    items = spark.range(1).select(F.col("id").alias("item_id"), F.lit("one two three four five").alias("text"))
    found = decontaminate.find_contamination(docs, items)
    assert "ExistingRDD" not in found._jdf.queryExecution().toString()
    assert sorted(r.doc_id for r in found.collect()) == [0, 1, 2]
    assert decontaminate.find_contamination(docs, items.limit(0)).collect() == []
