"""Index a corpus: chunk, place, write, embed, write, and commit everything at once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesearch.operators import scoring
from lakesearch.operators.catalog import empty_repos
from lakesearch.operators.chunking import decoded, place_chunks, plan_chunks
from lakesearch.operators.embedding import embed_chunks
from lakesearch.session import cut_lineage, remove, shared_path
from lakesearch.sources.store import IndexStore, checked_vectors
from lakesearch.sources.tables import read_corpus
from lakesearch.sources.tree import read_source_tree


def index_files(store: IndexStore, files: DataFrame, repos: DataFrame, embedder) -> DataFrame:
    """Index `files` (repo_id, path, content) of the repositories in `repos`.

    Returns (repo_id, chunks_indexed). Repositories without any file raise an error
    before anything is written. Running it again replaces the repositories' chunks, vectors, terms
    and `repos` rows, all in one commit: a search sees the old index or the new one, and a run that
    fails leaves the old one. Files of repositories that `repos` does not name are left out.
    `files` is read several times, for the columns each step needs: pass a table.
    """
    named = repos.select("repo_id").distinct()
    texts = decoded(files.join(named, "repo_id", "left_semi"))
    plan = cut_lineage(plan_chunks(texts))
    missing = [r.path_or_url for r in empty_repos(repos, plan).limit(10).collect()]
    if missing:
        more = " and perhaps others" if len(missing) == 10 else ""
        raise ValueError(f"repositories without a file to index: {', '.join(missing)}{more}")
    with store.writing() as write:
        # The rest goes on from the written chunks: positions are computed once and shared.
        chunks = write.replace("chunks", place_chunks(texts, plan), sort=["chunk_pos"], scope=named)
        vectors = checked_vectors(embed_chunks(chunks, embedder), embedder.dim)
        write.replace("vectors", vectors, sort=["chunk_pos"], clustered=True, scope=named)
        write.replace("terms", scoring.term_statistics(chunks), sort=["term"], scope=named)
        write.replace("repos", repos)
    return write.counts("chunks").select("repo_id", F.col("rows").alias("chunks_indexed"))


def index_location(store: IndexStore, location: str, embedder) -> DataFrame:
    """Index one local source tree under a new repository id."""
    spark = store.spark
    repos = store.new_repos(spark.createDataFrame([(location,)], "path_or_url string"))
    repo_id = repos.first().repo_id
    fixed = spark.createDataFrame([(repo_id, location)], "repo_id bigint, path_or_url string")
    marked = fixed.withColumn("indexed_at", F.current_timestamp())
    # The tree is walked and read once.
    landed = shared_path(spark, "files")
    read_source_tree(spark, location, repo_id).write.parquet(landed)
    try:
        return index_files(store, read_corpus(spark, landed), marked, embedder)
    finally:
        remove(spark, landed)
