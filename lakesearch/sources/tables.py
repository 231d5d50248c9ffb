"""Corpora that already are tables, and metadata kept in a relational database."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(
    spark: SparkSession,
    location: str,
    repo_id: str = "repo_id",
    path: str = "path",
    content: str = "content",
) -> DataFrame:
    """(repo_id, path, content) of a Parquet table; only those columns are read."""
    return spark.read.parquet(location).select(
        F.col(repo_id).cast("bigint").alias("repo_id"),
        F.col(path).alias("path"),
        F.col(content).alias("content"),
    )


def jdbc_options(url: str, table: str, **more: str) -> dict[str, str]:
    if not url.startswith("jdbc:"):
        raise ValueError(f"not a JDBC URL: {url}")
    return {"url": url, "dbtable": table, **more}


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    bounds: tuple[int, int] | None = None,
    partitions: int = 16,
    column: str = "chunk_pos",
    **more: str,
) -> DataFrame:
    """A metadata table of an external database. Simple filters are sent to it.

    With `bounds` of a numeric column the table is read in parallel ranges.
    """
    options = jdbc_options(url, table, **more)
    if bounds is not None:
        options |= {
            "partitionColumn": column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return spark.read.format("jdbc").options(**options).load()


def write_jdbc(rows: DataFrame, url: str, table: str, mode: str = "append", **more: str) -> None:
    rows.write.format("jdbc").options(**jdbc_options(url, table, **more)).mode(mode).save()
