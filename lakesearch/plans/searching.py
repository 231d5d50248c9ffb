"""Answer a table of queries in one job: embed, top-k, metadata, second score, cut."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesearch.operators import scoring
from lakesearch.operators.catalog import attach_chunks, known_repos, unknown_repos
from lakesearch.operators.embedding import embed_queries
from lakesearch.operators.scoring import SHORTLIST
from lakesearch.operators.topk import DEFAULT_K, top_k_bounded
from lakesearch.sources.store import IndexStore

# The result columns of a search; the last two are our own.
RESULTS = [
    "query_id",
    "rank",
    "file_path",
    "name",
    "node_type",
    "start_line",
    "end_line",
    "score",
    "snippet",
    "retrieval_score",
    "repo_id",
]


def shortlist(
    vectors: DataFrame, chunks: DataFrame, queries: DataFrame, embedder, minimum: int = SHORTLIST
) -> DataFrame:
    """The greatest(k, 10) nearest chunks of each query, with metadata and rank."""
    hits, bound = top_k_bounded(vectors, embed_queries(queries, embedder), minimum=minimum)
    return attach_chunks(hits, chunks, bound)


def search_tables(
    vectors: DataFrame,
    chunks: DataFrame,
    queries: DataFrame,
    embedder,
    scorer,
    cut: bool = True,
) -> DataFrame:
    """Results of `queries` (query_id, repo_id, text, k), best first by `rank`.

    `score` is the second score; the retrieval score is kept beside it. The scorer
    sees shortlisted pairs only.
    """
    asked = queries.withColumn("k", F.coalesce("k", F.lit(DEFAULT_K)))
    ranked = scoring.rerank(shortlist(vectors, chunks, asked, embedder), asked, scorer)
    if cut:
        limits = asked.select(*scoring.QUERY, "k")
        ranked = ranked.join(limits, scoring.QUERY).where(F.col("final_rank") <= F.col("k"))
    ranked = ranked.drop("rank").withColumnRenamed("final_rank", "rank")
    return ranked.withColumn("snippet", F.col("source_text")).select(*RESULTS)


def search_index(
    store: IndexStore, queries: DataFrame, embedder, scorer=None, on_unknown: str = "raise"
) -> DataFrame:
    """Search the stored index, all tables in the version that is the last one now. A query of a
    repository that is not indexed is an error, or is left out with `on_unknown="skip"`."""
    index = store.snapshot()
    repos = index.read("repos")
    if on_unknown == "raise":
        lost = [r.repo_id for r in unknown_repos(queries, repos).limit(10).collect()]
        if lost:
            more = " and perhaps others" if len(lost) == 10 else ""
            raise LookupError(f"repositories not in the index: {sorted(set(lost))}{more}")
    elif on_unknown != "skip":
        raise ValueError("on_unknown must be 'raise' or 'skip'")
    asked = known_repos(queries, repos)
    chunks = index.read_for("chunks", asked)
    if scorer is None:
        scorer = scoring.LexicalScorer(
            index.read_for("terms", asked), scoring.repo_sizes(chunks)
        )
    return search_tables(index.read_for("vectors", asked), chunks, asked, embedder, scorer)
