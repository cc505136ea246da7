"""What Python workers hold in a stage and keep between stages."""

import re

import corpus_pipeline
import public_tokenizers
import pyarrow as pa

from ledgerloom.llm import bpe


def test_encoding_leaves_no_tokens_in_the_workers(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.range(400, numPartitions=4).selectExpr("id AS doc_id", "concat('word', id, ' other', id * 7) AS text")
    assert bpe.encode(docs, path, pattern, ["doc_id"]).where("n_tokens > 0").count() == 400

    def left(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(bpe.encoder(path, pattern).known)], pa.int64())})

    assert {r.n for r in spark.range(64, numPartitions=8).mapInArrow(left, "n long").collect()} == {0}


def test_stages_leave_no_python_to_whoever_writes_them(spark):
    rows = [(i, f"some words of the text number {i} and {i * 7} others", "en" if i % 2 else "de", f"s{i % 3}", 40) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, "")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search("InArrow|InPandas|EvalPython", plan), name
        assert name == "byte_bpe" or found.columns == docs.columns


def test_written_stages_send_few_rows_at_a_time(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    stage = corpus_pipeline.written(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "n long"))
    found = [r.n for r in stage(spark, spark.range(3000, numPartitions=1), "").collect()]
    assert sum(found) == 3000 and max(found) <= corpus_pipeline.WIDE and spark.conf.get(key) == before
