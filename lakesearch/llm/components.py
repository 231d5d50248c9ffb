"""Connected components of a graph given as a table of links, by alternating star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesearch.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b) that is not its own root.

    Every step hangs the neighbours of a node onto its smallest neighbour: large steps those above
    the node, small steps those below it. The links stay a table throughout; minima are combined
    before the shuffle, and a node with very many neighbours meets only its one minimum in a join.
    The steps end when a pair of them leaves the links as they were.
    """
    edges = cut_lineage(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
            .distinct()
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(
            F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")
        )
        edges = cut_lineage(
            small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        now = edges.agg(
            F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.max("a"), F.max("b")
        ).first()
        if now == mark:
            return edges.toDF("node", "root")
        mark = now
