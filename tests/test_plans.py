"""Physical plans: what is pushed down, what is shuffled, what is not."""

import re

import pytest
from pyspark.sql import functions as F

from lakesearch.operators import chunking, filters, topk
from lakesearch.operators.embedding import HashedEmbedder, embed_chunks


@pytest.fixture
def files(spark, tmp_path):
    rows = [(1, "a.py", "def f(): pass\n"), (1, "b.js", "function g() { }\n"), (2, "c.md", "x")]
    spark.createDataFrame(rows, "repo_id bigint, path string, text string").write.parquet(
        str(tmp_path / "files")
    )
    return spark.read.parquet(str(tmp_path / "files"))


def formatted(spark, frame):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return frame._sc._jvm.PythonSQLUtils.explainString(
            frame._jdf.queryExecution(), "formatted"
        )
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def exchanges(plan):
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)


def test_chunk_planning_shuffles_no_source_text(spark, files):
    plan = formatted(spark, chunking.plan_chunks(files))
    shuffled = exchanges(plan)
    assert len(shuffled) == 3  # line facts, bracket facts, spans
    for columns in shuffled:
        for wide in ("text#", "code#", "gap#", "piece#", "masked#"):
            assert wide not in columns


def test_cutting_shuffles_texts_at_most_once(spark, files):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = formatted(spark, chunking.chunk_files(files))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("text#" in columns for columns in exchanges(plan)) == 1
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_path_filters_come_before_content(spark, files, tmp_path):
    named = files.withColumnRenamed("text", "content")
    plan = formatted(spark, filters.source_files(named).select("path"))
    assert "Exchange" not in plan and "BatchEvalPython" not in plan


def test_embedding_needs_no_shuffle_and_no_python(spark, files):
    chunks = chunking.chunk_files(files).withColumn("chunk_pos", F.lit(0).cast("bigint"))
    chunks.write.mode("overwrite").parquet(str(files.inputFiles()[0]) + "-chunks")
    stored = spark.read.parquet(str(files.inputFiles()[0]) + "-chunks")
    plan = formatted(spark, embed_chunks(stored, HashedEmbedder(16)))
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert "file_path" not in re.search(r"ReadSchema: .*", plan).group(0)


def test_vectors_are_not_shuffled(spark, tmp_path):
    rows = [(r, i, [float(i), 1.0]) for r in (1, 2) for i in range(4)]
    frame = spark.createDataFrame(rows, "repo_id bigint, chunk_pos bigint, embedding array<float>")
    frame.write.partitionBy("repo_id").parquet(str(tmp_path / "vectors"))
    vectors = spark.read.parquet(str(tmp_path / "vectors"))
    queries = spark.createDataFrame(
        [(0, 2, [1.0, 0.0], 2)], "query_id bigint, repo_id bigint, embedding array<float>, k int"
    )
    plan = formatted(spark, topk.top_k(vectors, queries))
    assert len(exchanges(plan)) == 1 and "embedding" not in exchanges(plan)[0]
    assert re.search(r"PartitionFilters: \[.*repo_id.*= 2", plan)
