"""Embedders: objects with `dim` and `column(text) -> unit vector column`.

Chunks and queries go through the same column, so their vectors are comparable.
"""

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lakesearch.functions import text as T
from lakesearch.functions import vectors as V


class HashedEmbedder:
    """Term counts hashed into `dim` buckets: no model, no shuffle, no Python worker."""

    def __init__(self, dim: int = 64):
        if dim < 1:
            raise ValueError("dim must be positive")
        self.dim = dim
        # Counting in blocks of about sqrt(dim) buckets visits every token twice
        # sqrt(dim) times; one pass per bucket would visit it dim times.
        self._block = max(1, int(dim**0.5))

    def bucket(self, token: Column) -> Column:
        head = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")
        return F.pmod(head, F.lit(self.dim)).cast("int")

    def counts(self, text: Column) -> Column:
        last, width = self.dim - 1, self._block

        def count_block(first: Column, members: Column) -> Column:
            ids = F.sequence(first, F.least(first + width - 1, F.lit(last)))
            return F.transform(
                ids, lambda b: F.size(members) - F.size(F.array_remove(members, b))
            )

        def count_all(buckets: Column) -> Column:
            starts = F.sequence(F.lit(0), F.lit(last), F.lit(width))
            return F.flatten(
                F.transform(
                    starts,
                    lambda first: T.once(
                        F.filter(buckets, lambda b: (b >= first) & (b < first + width)),
                        lambda members: count_block(first, members),
                    ),
                )
            )

        return T.once(F.transform(T.tokens(text), self.bucket), count_all)

    def column(self, text: Column) -> Column:
        return V.unit(self.counts(text))


class ModelEmbedder:
    """A user model behind `predict_batch_udf`: loaded once per worker, run on Arrow batches.

    `make_predict` returns a function from a batch of texts to an array (batch, dim).
    """

    def __init__(self, make_predict: Callable, dim: int, batch_size: int = 64):
        self.dim = dim
        self._udf = predict_batch_udf(
            make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size
        )

    def column(self, text: Column) -> Column:
        return V.unit(V.checked_dim(self._udf(text), self.dim))


def embed_chunks(chunks: DataFrame, embedder) -> DataFrame:
    """One vector per chunk, on the same (repo_id, chunk_pos) key."""
    text = T.retrieval_text(F.col("name"), F.col("docstring"), F.col("source_text"))
    return chunks.select("repo_id", "chunk_pos", embedder.column(text).alias("embedding"))


def embed_queries(queries: DataFrame, embedder) -> DataFrame:
    return queries.withColumn("embedding", embedder.column(F.col("text")))
