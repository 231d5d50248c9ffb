"""The search workload: a short list of queries asked in turn, all in one job."""

from pyspark.sql import DataFrame

from lakesearch.operators.metrics import workload_queries
from lakesearch.plans.searching import search_tables


def run_workload(
    vectors: DataFrame, chunks: DataFrame, embedder, scorer, count: int, repo_id: int
) -> DataFrame:
    """All reranked candidates of `count` queries at k = 10, without a final cut."""
    queries = workload_queries(vectors.sparkSession, count, repo_id)
    return search_tables(vectors, chunks, queries, embedder, scorer, cut=False)
