"""Dense positions inside a group without putting a whole group into one task."""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lakesearch.session import cut_lineage

# monotonically_increasing_id keeps the row number of a partition in its low 33 bits.
_ROW_BITS = (1 << 33) - 1


def running_offset(
    rows: DataFrame,
    group: list[str],
    order: list[Column],
    weight: Column,
    name: str = "offset",
    total: str | None = None,
) -> DataFrame:
    """Add the sum of `weight` over the earlier rows of the group, in `order`,
    and as `total` the sum over the whole group.

    The rows are range-partitioned on group and order, so a group that holds most
    of the table is spread over many partitions. Each partition sums its own rows;
    only one total per (partition, group) is summed across partitions.
    Pass narrow rows and join wide columns back: they are written once, because the
    partition numbers must not change between the two passes.
    """
    keys = [f"__o{i}" for i in range(len(order))]
    ranged = cut_lineage(_ranged(rows, group, order, keys, weight.alias("__w")))
    inside = Window.partitionBy("__part", *group).orderBy(*keys)
    local = ranged.withColumn("__local", _sum_before("__w", inside))
    totals = ranged.groupBy("__part", *group).agg(
        F.sum("__w").alias("__total"), F.lit(0).alias("__first")
    )
    return _across(local, totals, group, rows.columns, name, total)


def dense_positions(
    rows: DataFrame, group: list[str], order: list[Column], name: str = "chunk_pos"
) -> DataFrame:
    """0-based position of each row in its group; `order` must be a total order.

    As above, with the row number inside the sorted partition for the local sum.
    """
    keys = [f"__o{i}" for i in range(len(order))]
    sorted_rows = _ranged(rows, group, order, keys).sortWithinPartitions(*group, *keys)
    local = cut_lineage(
        sorted_rows.withColumn(
            "__local", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
        ).drop(*keys)
    )
    totals = local.groupBy("__part", *group).agg(
        F.count("*").alias("__total"), F.min("__local").alias("__first")
    )
    return _across(local, totals, group, rows.columns, name, None)


def continue_positions(
    existing: DataFrame,
    new: DataFrame,
    order: list[Column],
    group: str = "repo_id",
    name: str = "chunk_pos",
) -> DataFrame:
    """Positions for `new` rows that go on after the last position of their group."""
    ends = existing.groupBy(group).agg((F.max(name) + 1).alias("next"))
    return continue_after(ends, new, order, group, name)


def continue_after(
    ends: DataFrame,
    new: DataFrame,
    order: list[Column],
    group: str = "repo_id",
    name: str = "chunk_pos",
) -> DataFrame:
    """Positions for `new` rows that begin, in each group, with the `next` one of `ends`.

    Only the order keys are range-partitioned and written; wide rows meet their position in a join
    on these keys, which therefore must tell the rows of a group apart.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    keyed = new.select("*", *[o.alias(k) for o, k in zip(order, keys)])
    ranked = dense_positions(keyed.select(group, *keys), [group], [F.col(k) for k in keys], name="__pos")
    names = {c: f"__r{i}" for i, c in enumerate([group, *keys])}
    ranked = ranked.join(ends.withColumnRenamed("next", "__next"), group, "left").select(
        *[F.col(c).alias(r) for c, r in names.items()],
        (F.col("__pos") + F.coalesce("__next", F.lit(0))).alias("__place"),
    )
    same = [F.col(c).eqNullSafe(F.col(r)) for c, r in names.items()]
    placed = keyed.join(ranked, same).withColumn(name, F.col("__place"))
    return placed.select(*[c for c in new.columns if c != name], name)


def _ranged(
    rows: DataFrame, group: list[str], order: list[Column], keys: list[str], *more: Column
) -> DataFrame:
    keyed = rows.select("*", *[o.alias(k) for o, k in zip(order, keys)], *more)
    return keyed.repartitionByRange(*group, *keys).withColumn("__part", F.spark_partition_id())


def _across(
    local: DataFrame,
    totals: DataFrame,
    group: list[str],
    columns: list[str],
    name: str,
    total: str | None,
) -> DataFrame:
    """Add to each local sum what the earlier partitions of its group hold."""
    # At most one row per range partition and group.
    parts = Window.partitionBy(*(group or [F.lit(0)]))
    starts = totals.select(
        F.col("__part").alias("__p"),
        *[F.col(g).alias(f"__g_{g}") for g in group],
        (_sum_before("__total", parts.orderBy("__part")) - F.col("__first")).alias("__start"),
        F.sum("__total").over(parts).alias("__all"),
    )
    same = F.col("__part") == F.col("__p")
    for g in group:
        # Null-safe, so that rows of a NULL group keep their positions too.
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    added = [(F.col("__local") + F.col("__start")).alias(name)]
    if total:
        added.append(F.col("__all").alias(total))
    return local.join(starts, same).select(*columns, *added)


def _sum_before(column: str, window: WindowSpec) -> Column:
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0))
