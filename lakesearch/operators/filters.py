"""Corpus filters and audits of chunks and vectors."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.functions import vectors as V
from lakesearch.functions import text as T
from lakesearch.schemas import NOT_NULL

# Directory names that are never scanned.
EXCLUDED_DIRECTORIES = (
    ".git",
    ".hg",
    ".svn",
    "node_modules",
    "venv",
    ".venv",
    "env",
    "__pycache__",
    ".pytest_cache",
    ".mypy_cache",
    ".tox",
    "dist",
    "build",
)
EXCLUDED_SUFFIX = ".egg-info"


def has_extension(path: Column, extensions: Iterable[str] = T.SOURCE_EXTENSIONS) -> Column:
    return T.extension(path).isin(*extensions)


def excluded_directory(name: Column) -> Column:
    return (
        name.isin(*EXCLUDED_DIRECTORIES) | name.startswith(".") | name.endswith(EXCLUDED_SUFFIX)
    )


def under_excluded_directory(path: Column) -> Column:
    """Any directory of a root-relative path is excluded; the file name itself is not tested."""
    return T.once(
        T.path_parts(path),
        lambda parts: F.exists(F.slice(parts, 1, F.size(parts) - 1), excluded_directory),
    )


def is_text(content: Column) -> Column:
    """The bytes are valid UTF-8; an empty file is text."""
    return F.is_valid_utf8(content.cast("string"))


def source_files(
    files: DataFrame, extensions: Iterable[str] = T.SOURCE_EXTENSIONS
) -> DataFrame:
    """The files of a corpus table that a scan of its tree would give.

    The path tests come first: they need no file content.
    """
    path = F.col("path")
    kept = files.where(has_extension(path, extensions) & ~under_excluded_directory(path))
    return kept.where(is_text(F.col("content")))


def dimension_mismatches(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors that an index of dimension `dim` would reject: other sizes, and values that are
    not finite."""
    size = F.size("embedding")
    return vectors.withColumn("found_dim", size).where(
        F.col("embedding").isNull() | (size != dim) | ~V.finite(F.col("embedding"))
    )


def not_null_violations(table: DataFrame, name: str) -> DataFrame:
    """One row per required column with its number of NULLs, in a single pass."""
    required = NOT_NULL[name]
    counts = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counts.unpivot([], required, "column_name", "nulls")


def require_not_null(table: DataFrame, name: str) -> DataFrame:
    """The table itself; a job that reads it fails on a NULL in a required column."""
    checked = table
    for column in NOT_NULL[name]:
        if column in table.columns:
            guard = F.assert_true(
                F.col(column).isNotNull(), F.lit(f"NOT NULL constraint failed: {name}.{column}")
            )
            checked = checked.withColumn(column, F.when(guard.isNull(), F.col(column)))
    return checked
