import pytest
from pyspark.sql import functions as F

from lakesearch.operators import catalog, filters, positions
from lakesearch.operators.embedding import HashedEmbedder
from lakesearch.plans.indexing import index_files, index_location
from lakesearch.plans.searching import search_index
from lakesearch.sources import store as S
from lakesearch.sources.store import IndexStore, Transaction, WriteConflict

EMBEDDER = HashedEmbedder(32)
QUERIES = "query_id bigint, repo_id bigint, text string, k int"


@pytest.fixture
def store(spark, tmp_path):
    return IndexStore(spark, str(tmp_path / "index")).create()


def repos(spark, *ids):
    rows = spark.createDataFrame([(i, f"r{i}") for i in ids], "repo_id bigint, path_or_url string")
    return rows.withColumn("indexed_at", F.current_timestamp())


def files(spark, *rows):
    return spark.createDataFrame(
        [(r, p, t.encode()) for r, p, t in rows], "repo_id bigint, path string, content binary"
    )


def test_index_and_search_a_tree(spark, store, tree):
    summary = index_location(store, tree, EMBEDDER).collect()
    assert [tuple(r) for r in summary] == [(1, 7)]
    assert store.read("vectors").count() == store.read("chunks").count() == 7
    assert store.dim(1) == 32
    positions = [r.chunk_pos for r in store.read("chunks").orderBy("chunk_pos").collect()]
    assert positions == list(range(7))
    queries = spark.createDataFrame([(5, 1, "app function", 2)], QUERIES)
    found = search_index(store, queries, EMBEDDER).orderBy("rank").collect()
    assert [r["rank"] for r in found] == [1, 2] and found[0].name == "app"
    # Indexing again is a new repository; the first one stays.
    assert [r.repo_id for r in index_location(store, tree, EMBEDDER).collect()] == [2]
    assert {r.repo_id for r in store.read("repos").collect()} == {1, 2}


def test_reindexing_an_id_replaces_only_its_partition(spark, store):
    both = files(spark, (1, "a.py", "def a(): pass\n"), (2, "b.py", "def b(): pass\n"))
    index_files(store, both, repos(spark, 1, 2), EMBEDDER)
    again = files(spark, (2, "c.py", "def c(): pass\n\ndef d(): pass\n"))
    index_files(store, again, repos(spark, 2), EMBEDDER)
    names = {(r.repo_id, r.name) for r in store.read("chunks").collect()}
    assert names == {(1, "a"), (2, "c"), (2, "d")}
    assert store.read("repos").count() == 2
    assert store.read("vectors").count() == 3


def test_empty_repository_is_an_error(spark, store):
    some = files(spark, (1, "a.py", "x = 1\n"))
    with pytest.raises(ValueError, match="without a file to index: r2"):
        index_files(store, some, repos(spark, 1, 2), EMBEDDER)
    assert store.read("chunks").count() == 0


def test_unknown_repository(spark, store):
    index_files(store, files(spark, (1, "a.py", "def a(): pass\n")), repos(spark, 1), EMBEDDER)
    queries = spark.createDataFrame([(1, 1, "a", 1), (2, 8, "a", 1)], QUERIES)
    with pytest.raises(LookupError):
        search_index(store, queries, EMBEDDER)
    found = search_index(store, queries, EMBEDDER, on_unknown="skip").collect()
    assert [r.query_id for r in found] == [1]


def test_delete_cascades(spark, store):
    both = files(spark, (1, "a.py", "def a(): pass\n"), (2, "b.py", "def b(): pass\n"))
    index_files(store, both, repos(spark, 1, 2), EMBEDDER)
    store.delete([1])
    for table in ("repos", "chunks", "vectors", "terms"):
        assert {r.repo_id for r in store.read(table).collect()} == {2}, table


def test_append_continues_positions_and_equals_build(spark, store):
    rows = [(1 + i % 2, i, [float(i), 1.0]) for i in range(10)]
    named = spark.createDataFrame(rows, "repo_id bigint, vec_id bigint, embedding array<float>")
    order = [F.col("vec_id")]
    store.add_vectors(named.where("vec_id < 6"), 2, order)
    store.add_vectors(named.where("vec_id >= 6"), 2, order)
    got = sorted((r.repo_id, r.chunk_pos, r.embedding[0]) for r in store.read("vectors").collect())
    assert got == sorted((1 + i % 2, i // 2, float(i)) for i in range(10))


def test_wrong_dimension_is_rejected(spark, store):
    rows = [(1, 0, [1.0, 2.0]), (1, 1, [1.0])]
    vectors = spark.createDataFrame(rows, "repo_id bigint, chunk_pos bigint, embedding array<float>")
    assert [r.chunk_pos for r in filters.dimension_mismatches(vectors, 2).collect()] == [1]
    with pytest.raises(Exception, match="dimension mismatch"):
        store.save_vectors(vectors, 2)


def test_required_columns_are_checked_on_write(spark, store):
    bad = spark.createDataFrame([(1, None)], "repo_id bigint, path_or_url string").withColumn(
        "indexed_at", F.current_timestamp()
    )
    with pytest.raises(Exception, match="NOT NULL"):
        store.append("repos", bad)


def test_tables_are_created_once_and_can_be_named(spark, store):
    index_files(store, files(spark, (3, "a.py", "def a(): pass\n")), repos(spark, 3), EMBEDDER)
    store.create()
    assert store.read("chunks").count() == 1
    store.register("named_index")
    store.register("named_index")
    assert spark.sql("SELECT count(*) AS n FROM named_index.chunks WHERE repo_id = 3").first().n == 1


def test_positions_are_scoped_to_their_repository(spark, store):
    both = files(spark, (1, "a.py", "def a(): pass\n"), (2, "b.py", "def b(): pass\n"))
    index_files(store, both, repos(spark, 1, 2), EMBEDDER)
    chunks = store.read("chunks")
    assert [r.name for r in catalog.lookup_positions(chunks, 2, [0, 5]).collect()] == ["b"]
    assert catalog.lookup_positions(chunks, 1, []).count() == 0
    plan = catalog.lookup_positions(chunks, 2, [0, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repo_id" in plan and "In(chunk_pos" in plan


def test_new_ids_follow_the_last_one(spark, store):
    first = store.new_repos(spark.createDataFrame([("b",), ("a",)], "path_or_url string"))
    store.append("repos", first)
    more = store.new_repos(spark.createDataFrame([("c",)], "path_or_url string")).collect()
    assert {(r.repo_id, r.path_or_url) for r in store.read("repos").collect()} == {(1, "a"), (2, "b")}
    assert [r.repo_id for r in more] == [3]


# Versions


def contents(index):
    return {
        table: sorted(map(repr, index.read(table).drop("indexed_at").collect()))
        for table in ("repos", "chunks", "vectors", "terms")
    }


def search_text(spark, store, text):
    queries = spark.createDataFrame([(1, 1, text, 3)], QUERIES)
    return sorted(tuple(r) for r in search_index(store, queries, EMBEDDER).collect())


OLD = "def alpha(): pass\n\ndef beta(): pass\n"
NEW = "def gamma(): pass\n"


@pytest.mark.parametrize("stops_at", ["chunks", "vectors", "terms", "repos", "commit", "rename"])
def test_a_write_that_stops_leaves_the_old_index(spark, store, monkeypatch, stops_at):
    index_files(store, files(spark, (1, "a.py", OLD)), repos(spark, 1), EMBEDDER)
    before, found = contents(store), search_text(spark, store, "alpha")
    known = store.versions()
    write, commit, rename = Transaction._write, Transaction.commit, S.rename_folder

    def failing_write(self, table, *args):
        done = write(self, table, *args)  # what is written already stays behind a failure too
        if table == stops_at:
            raise RuntimeError("stopped")
        return done

    def failing(*args):
        raise RuntimeError("stopped")

    if stops_at == "commit":
        monkeypatch.setattr(Transaction, "commit", failing)
    elif stops_at == "rename":
        monkeypatch.setattr(S, "rename_folder", failing)
    else:
        monkeypatch.setattr(Transaction, "_write", failing_write)
    with pytest.raises(RuntimeError, match="stopped"):
        index_files(store, files(spark, (1, "a.py", NEW)), repos(spark, 1), EMBEDDER)
    assert store.versions() == known and contents(store) == before
    assert search_text(spark, store, "alpha") == found
    # No draft and no run of the failed write stays.
    assert all(n.isdigit() for n in S.child_names(spark, f"{store.location}/versions"))
    assert len(S.child_names(spark, f"{store.location}/data/chunks")) <= 2
    monkeypatch.undo()
    index_files(store, files(spark, (1, "a.py", NEW)), repos(spark, 1), EMBEDDER)
    assert {r.name for r in store.read("chunks").collect()} == {"gamma"}


def test_a_reader_keeps_its_version(spark, store):
    index_files(store, files(spark, (1, "a.py", OLD)), repos(spark, 1), EMBEDDER)
    pinned = store.snapshot()
    held = contents(pinned)
    index_files(store, files(spark, (1, "a.py", NEW)), repos(spark, 1), EMBEDDER)
    store.delete([1])
    assert contents(pinned) == held and contents(store.snapshot(pinned.version)) == held
    assert store.read("repos").count() == store.read("chunks").count() == 0
    with pytest.raises(LookupError):
        store.snapshot(99)


def test_of_two_writers_one_commits(spark, store):
    rows = spark.createDataFrame([(1, 0, [1.0])], "repo_id bigint, chunk_pos bigint, embedding array<float>")
    with pytest.raises(WriteConflict):
        with store.writing() as slow:
            slow.replace("vectors", rows)
            store.replace("vectors", rows.withColumn("repo_id", F.lit(2)))
    assert [r.repo_id for r in store.read("vectors").collect()] == [2]
    assert len(S.child_names(spark, f"{store.location}/data/vectors")) == 1


def test_many_repositories_go_in_one_commit(spark, store, monkeypatch):
    vectors = spark.range(60).selectExpr("id AS repo_id", "0L AS chunk_pos", "array(cast(id AS float)) AS embedding")
    with store.writing() as write:
        write.replace("vectors", vectors)
        write.replace("repos", repos(spark, *range(60)))
    calls = []
    monkeypatch.setattr(S, "remove", lambda *a: calls.append(a))
    store.delete(spark.range(10_000).selectExpr("id * 2 AS repo_id"))
    assert not calls  # nothing is done per repository
    for table in ("repos", "vectors"):
        assert {r.repo_id for r in store.read(table).collect()} == set(range(1, 60, 2))


def test_many_parts_are_read_by_a_join(spark, store, monkeypatch):
    vectors = spark.range(12).selectExpr("id % 4 AS repo_id", "id AS chunk_pos", "array(cast(id AS float)) AS embedding")
    store.replace("vectors", vectors)
    store.replace("vectors", vectors.where("repo_id = 2 and chunk_pos > 5"))
    few = sorted(map(repr, store.read("vectors").collect()))
    assert len(few) == 11
    monkeypatch.setattr(S, "NAMED_PARTS", 1)
    assert sorted(map(repr, store.read("vectors").collect())) == few
    wanted = spark.createDataFrame([(2,), (2,), (7,)], "repo_id bigint")
    assert {r.chunk_pos for r in store.read_for("vectors", wanted).collect()} == {6, 10}


def test_vacuum_and_compact(spark, store):
    index_files(store, files(spark, (1, "a.py", OLD), (2, "b.py", OLD)), repos(spark, 1, 2), EMBEDDER)
    index_files(store, files(spark, (1, "a.py", NEW)), repos(spark, 1), EMBEDDER)
    store.delete([2])
    before = contents(store)
    store.compact()
    store.vacuum()
    assert contents(store) == before and len(store.versions()) == 1
    for table in ("chunks", "vectors", "terms"):
        assert len(S.child_names(spark, f"{store.location}/data/{table}")) == 1
    index_files(store, files(spark, (3, "c.py", OLD)), repos(spark, 3), EMBEDDER)
    assert {r.repo_id for r in store.read("repos").collect()} == {1, 3}


def test_append_shuffles_keys_and_reads_no_stored_row(spark, store, monkeypatch):
    rows = [(1 + i % 2, i, [float(i), 1.0]) for i in range(10)]
    named = spark.createDataFrame(rows, "repo_id bigint, vec_id bigint, embedding array<float>")
    store.add_vectors(named, 2, [F.col("vec_id")])
    ranged = []
    cut = positions.cut_lineage
    monkeypatch.setattr(positions, "cut_lineage", lambda df: ranged.append(df.columns) or cut(df))
    monkeypatch.setattr(S.Snapshot, "read", lambda *a: pytest.fail("stored rows were read"))
    monkeypatch.setattr(S.Snapshot, "read_for", lambda *a: pytest.fail("stored rows were read"))
    store.add_vectors(named, 2, [F.col("vec_id")])
    assert ranged and all("embedding" not in columns for columns in ranged)
    monkeypatch.undo()
    got = sorted((r.repo_id, r.chunk_pos, r.embedding[0]) for r in store.read("vectors").collect())
    assert got == sorted((1 + i % 2, i // 2 + 5 * k, float(i)) for i in range(10) for k in (0, 1))


def test_a_large_file_can_be_read_by_several_tasks(spark):
    """Long texts of one repository: row groups that splits can be cut between."""
    import glob

    import pyarrow.parquet as pq

    from lakesearch.session import shared_path

    store = IndexStore(spark, shared_path(spark, "groups")).create()
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(400)), lambda i: F.md5(F.concat_ws("-", "id", i))), " ")
    rows = spark.range(2_000).select(
        F.lit(1).cast("bigint").alias("repo_id"), F.col("id").alias("chunk_pos"), F.lit("a").alias("file_path"),
        F.lit("file").alias("node_type"), F.lit("a").alias("name"), F.lit(1).alias("start_line"),
        F.lit(1).alias("end_line"), text.alias("source_text"), F.lit(None).cast("string").alias("docstring"),
    )
    store.append("chunks", rows, sort=["chunk_pos"])
    paths = glob.glob(store.location.removeprefix("file:") + "/data/chunks/**/*.parquet", recursive=True)
    groups = [pq.ParquetFile(path).metadata for path in paths]
    sizes = [m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)]
    assert sum(sizes) > 25 << 20 and max(sizes) < 8 << 20
    assert store.read("chunks").agg(F.sum("chunk_pos")).first()[0] == 1999 * 1000
