"""The index as a versioned store below one folder.

Every write is a run: a folder of Parquet files partitioned by repository that one job writes and
nothing changes any more. What belongs to the index is said by its version: a small Parquet table with the
`repos` rows and, for each table and repository, the runs that hold its rows. A write prepares runs and a
draft of the next version; one atomic rename of the draft makes all of it visible, for all tables at
once. Until then, and for good if a job fails in between, readers see the version before.

    data/<table>/run=<run>/repo_id=<id>/…     versions/<number>/…

A reader pins a version, so what it reads belongs together while others write. Two writers that start from
the same version cannot both commit: the second one gets a `WriteConflict` and has changed nothing. The
file system must rename folders atomically, as HDFS and local ones do.
"""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lakesearch import schemas as S
from lakesearch.functions import vectors as V
from lakesearch.operators.filters import require_not_null
from lakesearch.operators.positions import continue_after, dense_positions
from lakesearch.session import child_names, cut_lineage, remove, rename_folder

#: Longest list of partitions, of one table, that a reader names one by one.
NAMED_PARTS = 1000
#: Bytes of a row group before compression. Readers split files between row groups, and what they do with a
#: text (embedding, terms) takes far longer than reading it.
ROW_GROUP = 4 * 1024 * 1024

TABLES = {"repos": S.REPOS, "chunks": S.CHUNKS, "vectors": S.VECTORS, "terms": S.TERMS}
#: A version: rows of `repos`, and for the other tables one row per repository and run. `rows` counts the
#: run's rows of the repository; `next_pos` is the position after its last one.
STATE = StructType(
    [
        StructField("table", StringType(), False),
        StructField("repo_id", LongType(), False),
        StructField("run", StringType(), True),
        StructField("rows", LongType(), True),
        StructField("next_pos", LongType(), True),
        *[StructField(f.name, f.dataType, True) for f in S.REPOS if f.name != "repo_id"],
    ]
)


class WriteConflict(RuntimeError):
    """Another writer committed first; nothing was changed."""


class Snapshot:
    """One version of the store, for reading."""

    def __init__(self, spark: SparkSession, location: str, version: int | None):
        self.spark = spark
        self.location = location
        self.version = version
        if version is None:
            self.state = spark.createDataFrame([], STATE)
        else:
            self.state = spark.read.schema(STATE).parquet(f"{location}/versions/{version}")

    def parts(self, table: str) -> DataFrame:
        return self.state.where(F.col("table") == table)

    def read(self, table: str, repo_ids: list[int] | None = None) -> DataFrame:
        """A table, or the partitions of some repositories."""
        wanted = self.parts(table)
        if repo_ids is not None:
            wanted = wanted.where(F.col("repo_id").isin([int(r) for r in repo_ids]))
        return self._read(table, wanted)

    def read_for(self, table: str, rows: DataFrame) -> DataFrame:
        """A table without the repositories that `rows` does not name."""
        return self._read(table, self.parts(table).join(rows.select("repo_id").distinct(), "repo_id", "left_semi"))

    def dim(self, repo_id: int) -> int | None:
        """Dimension of the stored vectors of a repository."""
        found = self.read("vectors", [repo_id]).agg(F.max(F.size("embedding")).alias("d")).first()
        return found.d

    def _read(self, table: str, wanted: DataFrame) -> DataFrame:
        """The rows of some parts of the state.

        Few parts are named by their folders, so nothing else is even listed. More of them are a
        join of the runs that hold them, whose small side prunes partitions at run time.
        """
        schema = TABLES[table]
        if table == "repos":
            return wanted.select(*schema.names)
        base = f"{self.location}/data/{table}"
        reader = self.spark.read.schema(schema).option("basePath", base)
        named = wanted.select("run", "repo_id").limit(NAMED_PARTS + 1).collect()
        if not named:
            return self.spark.createDataFrame([], schema)
        if len(named) <= NAMED_PARTS:
            paths = [f"{base}/run={p.run}/repo_id={p.repo_id}" for p in named]
            return reader.parquet(*paths).select(*schema.names)
        runs = [p.run for p in wanted.select("run").distinct().collect()]  # one per write
        keyed = self.spark.read.schema(StructType([*schema, StructField("run", StringType())]))
        rows = keyed.option("basePath", base).parquet(*[f"{base}/run={r}" for r in runs])
        return rows.join(wanted.select("run", "repo_id"), ["run", "repo_id"], "left_semi").select(*schema.names)


class Transaction:
    """Writes on top of a version, which become visible together, or not at all."""

    def __init__(self, base: Snapshot):
        self.base = base
        self.spark = base.spark
        self.state = base.state
        self.runs: list[str] = []
        self._counted: dict[str, DataFrame] = {}

    def replace(
        self,
        table: str,
        rows: DataFrame,
        sort: list[str] | None = None,
        clustered: bool = False,
        scope: DataFrame | None = None,
    ) -> DataFrame:
        """Write `rows` in place of what is there for their repositories, and for those of `scope`.

        `clustered` rows come from a table that is partitioned by repository already and are written
        where they are, without a shuffle. Returns the rows as written.
        """
        written, parts = self._write(table, rows, sort, clustered)
        gone = parts.select("repo_id")
        if scope is not None:
            gone = gone.unionByName(scope.select(F.col("repo_id").cast("bigint"))).distinct()
        self._drop([table], gone)
        self.state = self.state.unionByName(parts)
        return written

    def append(
        self, table: str, rows: DataFrame, sort: list[str] | None = None
    ) -> DataFrame:
        """Write `rows` beside what is there."""
        written, parts = self._write(table, rows, sort, False)
        self.state = self.state.unionByName(parts)
        return written

    def delete(self, repo_ids: DataFrame) -> None:
        """Remove repositories with everything that belongs to them, in one pass over the version."""
        self._drop(list(TABLES), repo_ids.select(F.col("repo_id").cast("bigint")).distinct())

    def _drop(self, tables: list[str], ids: DataFrame) -> None:
        named = ids.select("repo_id", F.explode(F.array(*map(F.lit, tables))).alias("table"))
        self.state = self.state.join(named, ["table", "repo_id"], "left_anti").select(*STATE.names)

    def _write(
        self, table: str, rows: DataFrame, sort: list[str] | None, clustered: bool
    ) -> tuple[DataFrame, DataFrame]:
        schema: StructType = TABLES[table]
        shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        if table in S.NOT_NULL:
            shaped = require_not_null(shaped, table)
        if table == "repos":
            # These live in the version itself; written once, as ids and times must not change.
            kept = cut_lineage(shaped)
            return kept, _state_rows(kept, table)
        # Rebalancing splits a large repository over several files and packs small ones.
        even = shaped if clustered else shaped.hint("rebalance", "repo_id")
        if sort:
            even = even.sortWithinPartitions("repo_id", *sort)
        run = f"r{uuid.uuid4().hex}"
        base = f"{self.base.location}/data/{table}"
        path = f"{base}/run={run}"
        even.write.partitionBy("repo_id").option("parquet.block.size", ROW_GROUP).parquet(path)
        self.runs.append(path)
        written = self.spark.read.schema(schema).parquet(path).select(*schema.names)
        counts = [F.count("*").alias("rows")]
        if "chunk_pos" in schema.names:
            counts.append((F.max("chunk_pos") + 1).alias("next_pos"))
        parts = written.groupBy("repo_id").agg(*counts).withColumn("run", F.lit(run))
        # Counted when the version is written; a run does not change until then, or later.
        self._counted[table] = _state_rows(parts, table)
        return written, self._counted[table]

    def counts(self, table: str) -> DataFrame:
        """repo_id, rows, next_pos of the last write to a table."""
        return self._counted[table].select("repo_id", "rows", "next_pos")

    def commit(self) -> int:
        """Make the writes visible with one rename; returns the version's number."""
        draft = f"{self.base.location}/versions/_draft-{uuid.uuid4().hex}"
        target = 0 if self.base.version is None else self.base.version + 1
        try:
            self.state.write.parquet(draft)
            if not rename_folder(self.spark, draft, f"{self.base.location}/versions/{target}"):
                raise WriteConflict(f"version {target} was committed by another writer")
        except BaseException:
            remove(self.spark, draft)
            raise
        return target

    def forget(self) -> None:
        """Remove the runs of a transaction that was not committed."""
        for path in self.runs:
            remove(self.spark, path)


def _state_rows(rows: DataFrame, table: str) -> DataFrame:
    held = set(rows.columns)
    return rows.select(
        F.lit(table).alias("table"),
        *[
            (F.col(f.name) if f.name in held else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in STATE
            if f.name != "table"
        ],
    )


class IndexStore:
    def __init__(self, spark: SparkSession, location: str):
        self.spark = spark
        self.location = location.rstrip("/")

    # Versions

    def versions(self) -> list[int]:
        names = child_names(self.spark, f"{self.location}/versions")
        return sorted(int(n) for n in names if n.isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version to read from; the last one, if none is named."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else None
        elif version not in known:
            raise LookupError(f"no version {version}")
        return Snapshot(self.spark, self.location, version)

    @contextmanager
    def writing(self) -> Iterator[Transaction]:
        """A transaction that commits at the end of the block, unless it raises."""
        transaction = Transaction(self.snapshot())
        try:
            yield transaction
            transaction.commit()
        except BaseException:
            transaction.forget()
            raise

    def create(self) -> "IndexStore":
        """Make an empty first version, if there is none."""
        if not self.versions():
            try:
                Transaction(Snapshot(self.spark, self.location, None)).commit()
            except WriteConflict:
                pass  # someone else made it
        return self

    def vacuum(self, keep: int = 1) -> None:
        """Remove versions but the last `keep`, and runs that none of those names.

        Readers of removed versions fail; a transaction that is not committed yet loses its runs, so no
        one may write meanwhile. Rows of deleted repositories go with their run; `compact` first to
        write the others of that run anew.
        """
        known = self.versions()
        kept = [self.snapshot(v).state for v in known[-keep:]]
        for version in known[:-keep]:
            remove(self.spark, f"{self.location}/versions/{version}")
        named: set[tuple[str, str]] = set()
        for state in kept:
            named |= {(p.table, p.run) for p in state.select("table", "run").distinct().collect()}
        for table in TABLES:
            folder = f"{self.location}/data/{table}"
            for name in child_names(self.spark, folder):
                if (table, name.removeprefix("run=")) not in named:
                    remove(self.spark, f"{folder}/{name}")

    def compact(self) -> None:
        """Write every table as one run: many small runs and rows of deleted repositories go."""
        with self.writing() as write:
            for table in TABLES:
                if table != "repos":
                    sort = ["term"] if table == "terms" else ["chunk_pos"]
                    write.replace(table, write.base.read(table), sort, scope=write.base.parts(table))

    # Tables

    def register(self, database: str) -> None:
        """Name the tables of the last version in the session catalog, as views."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        version = self.snapshot().version
        state = f"parquet.`{self.location}/versions/{version}`"
        for name, schema in TABLES.items():
            columns = ", ".join(schema.names)
            data = f"{self.location}/data/{name}"
            if name == "repos":
                rows = f"SELECT {columns} FROM {state} WHERE table = 'repos'"
            elif child_names(self.spark, data):
                rows = (
                    f"SELECT {columns} FROM parquet.`{data}` LEFT SEMI JOIN "
                    f"(SELECT run, repo_id FROM {state} WHERE table = '{name}') USING (run, repo_id)"
                )
            else:
                typed = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in schema)
                rows = f"SELECT {typed} WHERE false"
            self.spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS {rows}")

    def read(self, table: str, repo_ids: list[int] | None = None) -> DataFrame:
        return self.snapshot().read(table, repo_ids)

    def read_for(self, table: str, rows: DataFrame) -> DataFrame:
        return self.snapshot().read_for(table, rows)

    def dim(self, repo_id: int) -> int | None:
        return self.snapshot().dim(repo_id)

    def replace(
        self, table: str, rows: DataFrame, sort: list[str] | None = None, clustered: bool = False
    ) -> None:
        """Write `rows` in place of the partitions of their repositories only."""
        with self.writing() as write:
            write.replace(table, rows, sort, clustered)

    def append(self, table: str, rows: DataFrame, sort: list[str] | None = None) -> None:
        with self.writing() as write:
            write.append(table, rows, sort)

    def delete(self, repo_ids: "list[int] | DataFrame") -> None:
        """Remove repositories with everything that belongs to them."""
        if not isinstance(repo_ids, DataFrame):
            rows = [(int(r),) for r in repo_ids]
            repo_ids = self.spark.createDataFrame(rows, "repo_id bigint")
        with self.writing() as write:
            write.delete(repo_ids)

    def new_repos(self, locations: DataFrame) -> DataFrame:
        """(repo_id, path_or_url, indexed_at) for new locations, with ids after the last one.

        Ids follow the order of the locations. Of two writers that take ids from the same version
        only one can commit them.
        """
        last = self.read("repos").agg(F.coalesce(F.max("repo_id"), F.lit(0)).alias("m")).first().m
        numbered = dense_positions(
            locations.select("path_or_url"), [], [F.col("path_or_url")], name="n"
        )
        return numbered.select(
            (F.col("n") + last + 1).alias("repo_id"),
            "path_or_url",
            F.current_timestamp().alias("indexed_at"),
        )

    def save_vectors(self, vectors: DataFrame, dim: int, clustered: bool = False) -> None:
        """Replace the vectors of their repositories; a wrong dimension fails the job."""
        self.replace("vectors", checked_vectors(vectors, dim), ["chunk_pos"], clustered)

    def add_vectors(self, vectors: DataFrame, dim: int, order: list) -> None:
        """Append (repo_id, embedding, …) rows, numbered after the stored ones in `order`, a total order
        of the rows of a repository. The version knows the last positions; no stored row is read."""
        with self.writing() as write:
            stored = write.base.parts("vectors").select("repo_id", "next_pos")
            ends = stored.groupBy("repo_id").agg(F.max("next_pos").alias("next"))
            placed = continue_after(ends, checked_vectors(vectors, dim), order)
            write.append("vectors", placed, sort=["chunk_pos"])


def checked_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.withColumn("embedding", V.checked_dim(F.col("embedding"), dim))
