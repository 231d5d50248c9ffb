"""Second scoring pass over a shortlist: every (query, chunk text) pair on its own."""

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from lakesearch.functions import text as T
from lakesearch.operators.positions import dense_positions
from lakesearch.session import cut_lineage

SHORTLIST = 10
#: Longest list that one task sorts.
RANKED = 100_000
#: One id may ask several repositories.
QUERY = ["query_id", "repo_id"]


def term_statistics(chunks: DataFrame) -> DataFrame:
    """Number of chunks of a repository that contain a term.

    Terms are counted before the shuffle, so a common term is a few rows, not one
    row per chunk.
    """
    text = T.retrieval_text(F.col("name"), F.col("docstring"), F.col("source_text"))
    terms = chunks.select("repo_id", F.explode(F.array_distinct(T.tokens(text))).alias("term"))
    return terms.groupBy("repo_id", "term").agg(F.count("*").alias("chunks_with_term"))


def repo_sizes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("repo_id").agg(F.count("*").alias("chunks_in_repo"))


def term_weights(queries: DataFrame, terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per query, its distinct terms in order with their inverse chunk frequency."""
    words = queries.select(
        "query_id",
        "repo_id",
        F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"),
    )
    n = F.coalesce(F.col("chunks_in_repo"), F.lit(0))
    df = F.coalesce(F.col("chunks_with_term"), F.lit(0))
    # First only the statistics of asked terms: the words are the small side, and the
    # larger table need not be shuffled for it.
    known = terms.join(words.select("repo_id", "term").distinct(), ["repo_id", "term"])
    weighted = (
        words.join(known, ["repo_id", "term"], "left")
        .join(sizes, "repo_id", "left")
        .select("query_id", "repo_id", "term", F.log1p((n - df + 0.5) / (df + 0.5)).alias("weight"))
    )
    # One row per distinct word of a query text.
    return weighted.groupBy("query_id", "repo_id").agg(
        F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("weights")
    )


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring tokens."""
    return T.once(
        words,
        lambda w: F.array_distinct(
            F.transform(
                F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))),
                lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)),
            )
        ),
    )


def _total(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0.0), lambda total, e: total + e["weight"])


def term_coverage(weights: Column, words: Column) -> Column:
    """Weight of the query terms found in the text, as a share of all query terms."""
    found = T.once(
        F.array_intersect(F.transform(weights, lambda e: e["term"]), words),
        lambda hit: _total(F.filter(weights, lambda e: F.array_contains(hit, e["term"]))),
    )
    return F.when(F.size(weights) > 0, found / _total(weights)).otherwise(0.0)


def bigram_coverage(query_pairs: Column, text_pairs: Column) -> Column:
    shared = F.size(F.array_intersect(query_pairs, text_pairs))
    return F.when(F.size(query_pairs) > 0, shared / F.size(query_pairs)).otherwise(0.0)


class LexicalScorer:
    """Weighted coverage of the query's terms plus coverage of its bigrams, in [0, 2].

    Rounded to 9 decimals, so that the order of a sum does not decide between equals.

    `terms` and `sizes` are the statistics of the indexed chunks.
    """

    def __init__(self, terms: DataFrame, sizes: DataFrame):
        self._terms = terms
        self._sizes = sizes

    def score(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        words = T.tokens(F.col("candidate_text"))
        # What depends on the query alone is worked out once per query.
        weights = queries.select(
            *QUERY, bigrams(T.tokens(F.col("text"))).alias("query_pairs")
        ).join(term_weights(queries, self._terms, self._sizes), QUERY, "left")

        def coverage(w: Column) -> Column:
            return term_coverage(F.col("weights"), w) + bigram_coverage(
                F.col("query_pairs"), bigrams(w)
            )

        none = F.array().cast("array<struct<term:string,weight:double>>")
        return (
            pairs.join(weights, QUERY)
            .withColumn("weights", F.coalesce("weights", none))
            .withColumn(
                "score",
                F.round(T.once(words, coverage), 9),
            )
            .drop("weights", "query_pairs")
        )


class ModelScorer:
    """A user model behind a two-column `predict_batch_udf` (query text, chunk text)."""

    def __init__(self, make_predict: Callable, batch_size: int = 32):
        self._udf = predict_batch_udf(
            make_predict, return_type=FloatType(), batch_size=batch_size
        )

    def score(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        value = self._udf(F.col("query_text"), F.col("candidate_text"))
        return pairs.withColumn("score", value.cast("double"))


def pair_up(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Each candidate with its query text; `hits` already carries the chunk columns."""
    texts = queries.select(*QUERY, F.col("text").alias("query_text"))
    text = T.retrieval_text(F.col("name"), F.col("docstring"), F.col("source_text"))
    return hits.join(texts, QUERY).withColumn("candidate_text", text)


def rerank(candidates: DataFrame, queries: DataFrame, scorer) -> DataFrame:
    """Score every candidate and rank per query; equal scores keep their retrieval order.

    The lists of queries with k up to `RANKED` are sorted one by one. Longer ones are numbered in
    range partitions, so a query with any number of candidates is spread over tasks.
    """
    if not queries.where(F.col("k") > RANKED).limit(1).count():
        return _ranked(candidates, queries, scorer)
    long = queries.where(F.col("k") > RANKED).select(*QUERY)
    short = _ranked(candidates.join(long, QUERY, "left_anti"), queries, scorer)
    scored = scorer.score(pair_up(candidates.join(long, QUERY, "left_semi"), queries), queries)
    order = [-F.col("score"), F.col("rank")]
    keyed = cut_lineage(scored.drop("query_text", "candidate_text"))
    places = dense_positions(keyed.select(*QUERY, "score", "rank"), QUERY, order, name="place")
    numbered = keyed.join(places.select(*QUERY, "rank", "place"), [*QUERY, "rank"])
    placed = numbered.withColumn("final_rank", (F.col("place") + 1).cast("int")).drop("place")
    return short.unionByName(placed)


def _ranked(candidates: DataFrame, queries: DataFrame, scorer) -> DataFrame:
    scored = scorer.score(pair_up(candidates, queries), queries)
    order = Window.partitionBy(*QUERY).orderBy(F.desc("score"), F.asc("rank"))
    return scored.withColumn("final_rank", F.row_number().over(order)).drop(
        "query_text", "candidate_text"
    )
