"""Pieces that several operators of this package share."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesearch.session import remove, shared_path

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. `lower` does the same on texts that are all ASCII, and faster."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def remainder(ids: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; a null id counts as empty text."""
    return F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")) % divisor


def one_row_each(docs: DataFrame, digest: Column, winners: DataFrame) -> DataFrame:
    """One row of `docs`, with all its columns, for each pair in `winners` (doc_id, digest).

    `digest` is the one of a row of `docs`. Rows of one pair are told apart by nothing that matters;
    all but one of each task go before the shuffle, so a row given often does not fill a task.
    """
    id_of = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    stay = winners.select(id_of.alias("__id"), F.col("digest").alias("__digest")).distinct()
    hashed = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = docs.withColumn("__id", id_of).withColumn("__digest", digest)
    order = Window.partitionBy("__id", "__digest").orderBy(F.xxhash64(*hashed))
    single = keyed.withColumn("__row", F.row_number().over(order)).where("__row = 1")
    return single.join(stay, ["__id", "__digest"], "left_semi").select(docs.columns)


def write_out(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write `rows` below the shared checkpoint folder; returns them as read back, and the path.

    Unlike checkpoint() the file is columnar and compressed, so later steps read only the columns
    they need, and the planner knows its size. `discard` removes it when nothing needs it any more.
    """
    spark = rows.sparkSession
    path = shared_path(spark, name)
    # What was shuffled for this file is of no use after it; otherwise it stays on the executors'
    # disks until the driver happens to collect its garbage.
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(rows.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        remove(spark, path)
