"""Latency summaries and the cyclic query workload."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.operators.positions import running_offset

# The base list of the search workload.
WORKLOAD_QUERIES = [
    "parse a configuration file",
    "handle an HTTP request",
    "validate user input",
    "connect to a database",
    "read a file from disk",
    "write data to a file",
    "send a network request",
    "log an error message",
    "authenticate a user",
    "serialize an object to JSON",
    "run tests",
    "create a class instance",
    "handle an exception",
    "loop over a list",
    "define a function decorator",
    "cache a computed value",
    "sort a collection",
    "format a string",
    "compute a hash",
    "close a connection",
]

PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def floor_rank(count: Column, fraction: float) -> Column:
    """0-based index of a percentile: floor of count x fraction, at most the last one."""
    index = F.floor(count * F.lit(float(fraction)))
    return F.least(index, count - 1).cast("bigint")


def latency_summary(
    samples: DataFrame,
    group: list[str],
    value: str,
    percentiles: dict[str, float] = PERCENTILES,
) -> DataFrame:
    """Count, mean, min, max and floor-rank percentiles per group.

    Equal values are counted before they are ordered, and the ordered values of a
    group are spread over range partitions: a group may hold most of the table.
    """
    distinct = (
        samples.where(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).alias("value"))
        .agg(F.count("*").alias("times"))
    )
    placed = running_offset(
        distinct, group, [F.col("value")], F.col("times"), name="first", total="size"
    )
    picks = []
    for name, fraction in percentiles.items():
        index = floor_rank(F.col("size"), fraction)
        here = (F.col("first") <= index) & (index < F.col("first") + F.col("times"))
        picks.append(F.max(F.when(here, F.col("value"))).alias(name))
    return placed.groupBy(*group).agg(
        F.coalesce(F.sum("times"), F.lit(0)).alias("samples"),
        (F.sum(F.col("value") * F.col("times")) / F.sum("times")).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        *picks,
    )


def floor_percentile(
    samples: DataFrame, group: list[str], value: str, fraction: float, name: str = "percentile"
) -> DataFrame:
    return latency_summary(samples, group, value, {name: fraction}).select(*group, name)


def summary_or_zero(summary: DataFrame) -> DataFrame:
    """An ungrouped summary of no samples reads 0.0, not NULL."""
    return summary.na.fill(0.0)


def cyclic_workload(base: DataFrame, count: int) -> DataFrame:
    """`count` queries that repeat `base` (item, text) in turn, numbered from 0.

    `base.item` must be 0 .. n-1.
    """
    spark = base.sparkSession
    n = base.count()
    slots = spark.range(count).withColumnRenamed("id", "query_id")
    return slots.withColumn("item", F.col("query_id") % n).join(base, "item")


def workload_queries(spark, count: int, repo_id: int, k: int = 10) -> DataFrame:
    base = spark.createDataFrame(list(enumerate(WORKLOAD_QUERIES)), "item bigint, text string")
    return cyclic_workload(base, count).select(
        "query_id", F.lit(repo_id).cast("bigint").alias("repo_id"), "text", F.lit(k).alias("k")
    )
