"""Table schemas, declared once and used on every read and write."""

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

REPOS = StructType(
    [
        StructField("repo_id", LongType(), False),
        StructField("path_or_url", StringType(), False),
        StructField("indexed_at", TimestampType(), True),
    ]
)

FILES = StructType(
    [
        StructField("repo_id", LongType(), True),
        StructField("path", StringType(), True),
        StructField("content", BinaryType(), True),
    ]
)

CHUNKS = StructType(
    [
        StructField("repo_id", LongType(), False),
        StructField("chunk_pos", LongType(), False),
        StructField("file_path", StringType(), False),
        StructField("node_type", StringType(), False),
        StructField("name", StringType(), False),
        StructField("start_line", IntegerType(), False),
        StructField("end_line", IntegerType(), False),
        StructField("source_text", StringType(), False),
        StructField("docstring", StringType(), True),
    ]
)

VECTORS = StructType(
    [
        StructField("repo_id", LongType(), False),
        StructField("chunk_pos", LongType(), False),
        StructField("embedding", ArrayType(FloatType()), False),
    ]
)

QUERIES = StructType(
    [
        StructField("query_id", LongType(), True),
        StructField("repo_id", LongType(), True),
        StructField("text", StringType(), True),
        StructField("k", IntegerType(), True),
    ]
)

# Term statistics of an indexed repository, read by the default pair scorer.
TERMS = StructType(
    [
        StructField("repo_id", LongType(), False),
        StructField("term", StringType(), False),
        StructField("chunks_with_term", LongType(), False),
    ]
)

NOT_NULL = {
    "repos": ["repo_id", "path_or_url"],
    "vectors": ["repo_id", "chunk_pos", "embedding"],
    "terms": ["repo_id", "term", "chunks_with_term"],
    "chunks": [
        "repo_id",
        "chunk_pos",
        "file_path",
        "node_type",
        "name",
        "start_line",
        "end_line",
        "source_text",
    ],
}
