"""Lookups and audits over repos, chunks and vectors."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["repo_id", "chunk_pos"]
# Hits up to this many rows are sent to every executor; more are left to the join planner.
BROADCAST_HITS = 100_000


def lookup_positions(chunks: DataFrame, repo_id: int, positions: Iterable[int]) -> DataFrame:
    """Chunks of one repository by position; both tests reach the file scan."""
    wanted = [int(p) for p in positions]
    return chunks.where((F.col("repo_id") == repo_id) & F.col("chunk_pos").isin(wanted))


def lookup_table(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks whose key is in a table of ids."""
    return chunks.join(ids, KEY, "left_semi")


def attach_chunks(hits: DataFrame, chunks: DataFrame, rows: int | None = None) -> DataFrame:
    """Hits with their chunk columns; hits without a chunk are dropped.

    `rows` is a known upper bound of the hits. Below BROADCAST_HITS the chunk table
    is filtered where it is read; otherwise the planner decides from its own sizes.
    """
    small = rows is not None and rows <= BROADCAST_HITS
    return (F.broadcast(hits) if small else hits).join(chunks, KEY)


def orphan_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    return hits.join(chunks.select(*KEY), KEY, "left_anti")


def repo_chunks(repos: DataFrame, chunks: DataFrame) -> DataFrame:
    return repos.join(chunks, "repo_id")


def delete_repos(table: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of a repo-keyed table without those of the removed repositories."""
    return table.join(removed.select("repo_id").distinct(), "repo_id", "left_anti")


def unknown_repos(queries: DataFrame, repos: DataFrame) -> DataFrame:
    """Queries against a repository that is not indexed."""
    return queries.join(repos.select("repo_id"), "repo_id", "left_anti")


def known_repos(queries: DataFrame, repos: DataFrame) -> DataFrame:
    return queries.join(repos.select("repo_id"), "repo_id", "left_semi")


def empty_repos(repos: DataFrame, chunks: DataFrame) -> DataFrame:
    """Repositories without any chunk. The ids are made distinct before they are shuffled."""
    return repos.join(chunks.select("repo_id").distinct(), "repo_id", "left_anti")


def index_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("repo_id").agg(F.count("*").alias("chunks_indexed"))


def vector_stats(vectors: DataFrame) -> DataFrame:
    """Vector count and stored dimension per repository."""
    return vectors.groupBy("repo_id").agg(
        F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dim")
    )


def duplicate_positions(chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy(*KEY).agg(F.count("*").alias("copies"))
    return counts.where(F.col("copies") > 1)


def distinct_names(chunks: DataFrame) -> DataFrame:
    """Distinct definition names with the number of chunks of that name."""
    return chunks.groupBy("repo_id", "name").agg(F.count("*").alias("chunks"))
