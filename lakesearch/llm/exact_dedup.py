"""Exact deduplication: group by a 128-bit content hash, compare bytes inside the groups.

Method. The rows are aggregated by (128-bit hash, normalised text). The text as a second grouping
key *is* the byte comparison: two texts that collide on the hash stay two classes. Copies are
combined inside each map task before anything is shuffled, so a group that holds a third of the
table reaches its reducer as one row per task. Afterwards each document finds its class by
(hash, SHA-256) in a join of narrow rows; a hash that collides is thus no problem there either, and a
class that shares both digests with another one is reported as an error, not merged.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.llm.common import lower_ascii, one_row_each


def content_hash(normalised: Column) -> Column:
    """128 bits of the content."""
    return F.unhex(F.md5(normalised))


def exact_groups(
    docs: DataFrame, digest: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; a null text is the empty text.
    The largest doc_id of a group stays. Rows that repeat an id with an equal text are the same
    document given twice: they count in group_size and are all marked kept when their id stays.
    A null id is smaller than any other and stays only where its group has no other.
    Other columns of `docs` are ignored; an empty table gives an empty result.
    """
    normalised = lower_ascii(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", normalised.alias("norm"))
    hashed = rows.select("doc_id", "norm", digest(F.col("norm")).alias("h"))
    classes = (
        hashed.groupBy("h", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    # The classes differ in their bytes; two with the same two digests cannot be told apart below.
    told_apart = classes.groupBy("h", "text_sha256").agg(
        F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
        F.count("*").alias("classes"),
    )
    found = told_apart.select(
        "h",
        "text_sha256",
        "keep_id",
        F.when(F.col("classes") == 1, F.col("group_size"))
        .otherwise(F.raise_error(F.lit("two texts share both digests")))
        .alias("group_size"),
    )
    narrow = hashed.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
    return narrow.join(found, ["h", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """One row of `docs` per group, with all its columns: of a row given twice only one stays."""
    stay = exact_groups(docs).where("kept").select("doc_id", F.col("text_sha256").alias("digest"))
    digest = F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256)
    return one_row_each(docs, digest, stay)
