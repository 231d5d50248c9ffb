"""Source trees as tables: a listing source, and file contents read in parallel.

Paths must be visible to all executors (a shared file system). The built-in binary
file source leaves out empty files and names starting with `_` or `.`; this one
gives every regular file outside excluded directories.
"""

import os
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lakesearch.functions import text as T
from lakesearch.operators.filters import EXCLUDED_DIRECTORIES, EXCLUDED_SUFFIX, is_text
from lakesearch.operators.positions import running_offset
from lakesearch.session import cut_lineage

_FORMAT = "source_tree"

# File bytes gathered before they are handed to Spark, and read by one task, about.
BATCH_BYTES = 8 * 1024 * 1024
READ_BYTES = 64 * 1024 * 1024
# Directories that a task lists in one round; fewer while there is not yet one for every task.
LISTED, FIRST_LISTED = 2_000, 64


def _skipped(directory: str) -> bool:
    return (
        directory in EXCLUDED_DIRECTORIES
        or directory.startswith(".")
        or directory.endswith(EXCLUDED_SUFFIX)
    )


class _Subtree(InputPartition):
    """Root-relative directories: `deep` ones are walked, `flat` ones only listed."""

    def __init__(self, deep: list[str], flat: list[str]):
        self.deep = deep
        self.flat = flat


class SourceTree(DataSource):
    """`spark.read.format("source_tree").option("extensions", ".py,.go").load(root)`.

    Rows are (path relative to the root, size in bytes) of files with one of the
    extensions, outside excluded directories. Symbolic links to directories are not followed.
    """

    @classmethod
    def name(cls) -> str:
        return _FORMAT

    def schema(self) -> str:
        return "path string, size bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        extensions = self.options.get("extensions")
        return _TreeReader(
            self.options["path"],
            tuple(extensions.split(",")) if extensions else T.SOURCE_EXTENSIONS,
            int(self.options.get("partitions", "64")),
        )


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, extensions: tuple[str, ...], partitions: int):
        self._root = root
        self._extensions = extensions
        self._partitions = partitions

    def partitions(self) -> list[InputPartition]:
        """Open directories level by level until there is enough to share out.

        The driver lists about as many directories as there are partitions; the rest
        of the tree is walked by the tasks.
        """
        if not os.path.exists(self._root):
            raise FileNotFoundError(f"Path does not exist: {self._root}")
        deep, flat = [""], []
        while deep and len(deep) < self._partitions:
            opened = deep.pop(0)
            flat.append(opened)
            deep.extend(self._children(opened))
            if len(flat) >= self._partitions:
                break
        count = max(1, min(self._partitions, len(deep) + len(flat)))
        return [_Subtree(deep[i::count], flat[i::count]) for i in range(count)]

    def _children(self, directory: str) -> list[str]:
        try:
            with os.scandir(os.path.join(self._root, directory)) as entries:
                return sorted(
                    os.path.join(directory, e.name)
                    for e in entries
                    if e.is_dir(follow_symlinks=False) and not _skipped(e.name)
                )
        except OSError:
            return []

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        for directory in partition.flat:
            yield from self._files(directory)
        pending = list(partition.deep)
        while pending:
            directory = pending.pop()
            yield from self._files(directory)
            pending.extend(self._children(directory))

    def _files(self, directory: str) -> Iterator[tuple]:
        try:
            entries = os.scandir(os.path.join(self._root, directory))
        except OSError:
            return
        with entries:
            for entry in entries:
                suffix = _suffix(entry.name)
                if suffix in self._extensions and entry.is_file():
                    yield os.path.join(directory, entry.name), entry.stat().st_size


def _suffix(name: str) -> str:
    dot = name.rfind(".")
    return name[dot:] if 0 < dot < len(name) - 1 else ""


def list_tree(
    spark: SparkSession, root: str, extensions: Iterable[str] = T.SOURCE_EXTENSIONS
) -> DataFrame:
    """(path, size) of the files of a tree, as the listing source gives them, walked in rounds.

    A task lists up to `LISTED` directories, nearest ones first, and hands back those it has not come to,
    which the next round spreads over all tasks again. So neither a large subtree nor what hangs below
    a long chain stays with one task.
    """
    if not os.path.exists(root):
        raise FileNotFoundError(f"Path does not exist: {root}")
    reader = _TreeReader(root, tuple(extensions), 1)
    tasks = _tasks(spark)

    def walk(limit: int):
        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pending = deque(path for batch in batches for path in batch["path"].to_pylist())
            for _ in range(limit):
                if not pending:
                    break
                directory = pending.popleft()
                files = list(reader._files(directory))
                pending.extend(reader._children(directory))
                yield _listing([f for f, _ in files], [n for _, n in files])
            yield _listing(list(pending), [None] * len(pending))

        return listed

    found = spark.createDataFrame([], "path string, size bigint")
    left, n = spark.createDataFrame([("",)], "path string"), 1
    while n:
        spread = left.repartition(min(n, tasks))
        limit = LISTED if n >= tasks else FIRST_LISTED
        step = cut_lineage(spread.mapInArrow(walk(limit), "path string, size bigint"))
        found = found.unionByName(step.where("size is not null"))
        left = step.where("size is null").select("path")
        n = left.count()
    return found


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _listing(paths: list[str], sizes: list[int | None]) -> pa.RecordBatch:
    columns = [pa.array(paths, pa.string()), pa.array(sizes, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["path", "size"])


def read_contents(listing: DataFrame, root: str, read_bytes: int = READ_BYTES) -> DataFrame:
    """Add the bytes of each file of `listing` (path, size); files that cannot be read are dropped.

    Running sums of the sizes cut the listing into shares of about `read_bytes`, one for each task: many
    small files, or a large one and no other. Arrow batches are cut by content size too.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, contents, size = [], [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with open(os.path.join(root, path), "rb") as file:
                        content = file.read()
                except OSError:
                    continue
                paths.append(path)
                contents.append(content)
                size += len(content)
                if size >= BATCH_BYTES:
                    yield _batch(paths, contents)
                    paths, contents, size = [], [], 0
        yield _batch(paths, contents)

    total = listing.agg(F.sum("size")).first()[0] or 0
    tasks = _tasks(listing.sparkSession)
    # Small trees are read by all tasks, too.
    share = max(1, min(read_bytes, -(-total // tasks)))
    placed = running_offset(listing.select("path", "size"), [], [F.col("path")], F.col("size"), name="before")
    parts = -(-total // share) + 1
    numbered = placed.select("path", F.expr(f"cast(before div {share} as int)").alias("share"))
    spread = numbered.repartitionById(parts, "share").select("path")
    return spread.mapInArrow(load, "path string, content binary")


def _batch(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(paths, pa.string()), pa.array(contents, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["path", "content"])


def read_source_tree(
    spark: SparkSession,
    root: str,
    repo_id: int,
    extensions: Iterable[str] = T.SOURCE_EXTENSIONS,
) -> DataFrame:
    """The text files of a tree as (repo_id, path, content); each file is read once."""
    listing = cut_lineage(list_tree(spark, str(root), extensions))
    files = read_contents(listing, str(root)).where(is_text(F.col("content")))
    return files.select(F.lit(repo_id).cast("bigint").alias("repo_id"), "path", "content")
