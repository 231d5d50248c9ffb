import os

import pytest
from pyspark.sql import functions as F

from lakesearch.sources import tree as tree_source
from lakesearch.sources.tables import jdbc_options, read_corpus
from lakesearch.sources.tree import read_source_tree

KEPT = {
    "main.py", "util.go", "src/app.js", "src/_private/__init__.py", ".hidden.py", "a/b.py", "a-b.py",
}


def test_tree_gives_text_files_outside_excluded_directories(spark, tree):
    rows = read_source_tree(spark, tree, 7).collect()
    assert {r.path for r in rows} == KEPT
    assert {r.repo_id for r in rows} == {7}
    contents = {r.path: bytes(r.content) for r in rows}
    assert contents["main.py"] == b"def main():\r\n    return 1\r\n"
    assert contents["src/_private/__init__.py"] == b""


def test_tree_extensions_can_be_chosen(spark, tree):
    rows = read_source_tree(spark, tree, 1, extensions=[".md"]).collect()
    assert [r.path for r in rows] == ["notes.md"]


def test_missing_root_is_an_error(spark, tree):
    with pytest.raises(FileNotFoundError):
        read_source_tree(spark, tree + "/nowhere", 1)


def test_directory_links_are_not_followed(spark, tree):
    os.symlink(os.path.join(tree, "src"), os.path.join(tree, "linked"))
    os.symlink(os.path.join(tree, "main.py"), os.path.join(tree, "alias.py"))
    os.symlink(os.path.join(tree, "gone.py"), os.path.join(tree, "broken.py"))
    paths = {r.path for r in read_source_tree(spark, tree, 1).collect()}
    assert paths == KEPT | {"alias.py"}


def test_deep_and_wide_trees_are_walked_completely(spark, tmp_path):
    expected = set()
    for i in range(90):
        name = f"d{i % 9}/e{i}/f/g{i % 4}/m{i}.py"
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"x = {i}\n")
        expected.add(name)
    paths = [r.path for r in read_source_tree(spark, str(tmp_path), 1).collect()]
    assert len(paths) == 90 and set(paths) == expected


def test_the_listing_source_equals_the_rounds(spark, tree):
    spark.dataSource.register(tree_source.SourceTree)
    listed = spark.read.format("source_tree").load(tree)
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, tree_source.list_tree(spark, tree).collect()))


def test_a_subtree_below_a_deep_chain_is_walked_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree_source, "LISTED", 20)
    monkeypatch.setattr(tree_source, "FIRST_LISTED", 15)
    bottom = tmp_path.joinpath(*["d"] * 60)
    expected = {f"{'d/' * 60}e{i}/m.py" for i in range(120)}
    for i in range(120):
        (bottom / f"e{i}").mkdir(parents=True)
        (bottom / f"e{i}" / "m.py").write_text(f"x = {i}\n")
    rounds = []
    cut = tree_source.cut_lineage
    counted = F.count_if(F.col("size").isNull())

    def watched(df):
        done = cut(df)
        per_task = done.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), counted.alias("left"))
        rounds.append([(r.n, r.left) for r in per_task.collect()])
        return done

    monkeypatch.setattr(tree_source, "cut_lineage", watched)
    found = tree_source.list_tree(spark, str(tmp_path)).collect()
    assert {r.path for r in found} == expected and len(found) == 120
    assert all(n - left <= 20 for tasks in rounds for n, left in tasks)
    assert max(len(tasks) for tasks in rounds) > 1


def test_reads_are_balanced_by_bytes(spark, tmp_path):
    sizes = [200_000] + [100] * 3000 + [5_000] * 20
    for i, n in enumerate(sizes):
        (tmp_path / f"m{i:05}.py").write_bytes(b"#" * n)
    listing = tree_source.list_tree(spark, str(tmp_path))
    read = tree_source.read_contents(listing, str(tmp_path), read_bytes=40_000)
    shares = read.groupBy(F.spark_partition_id()).agg(F.sum(F.length("content")).alias("n"), F.count("*").alias("files")).collect()
    assert sum(r.files for r in shares) == len(sizes) and sum(r.n for r in shares) == sum(sizes)
    # The large file has a task to itself but for what is before it in its share.
    assert sorted(r.n for r in shares)[-2] <= 45_000 and len(shares) >= 9


def test_corpus_table_reads_three_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.py", "x", "big")], "id long, p string, c string, other string")
    rows.write.parquet(str(tmp_path / "t"))
    corpus = read_corpus(spark, str(tmp_path / "t"), "id", "p", "c")
    assert corpus.columns == ["repo_id", "path", "content"]
    plan = corpus._jdf.queryExecution().executedPlan().toString()
    assert "other" not in plan.split("ReadSchema")[1]


def test_jdbc_options():
    options = jdbc_options("jdbc:postgresql://host/db", "chunks", user="u")
    assert options == {"url": "jdbc:postgresql://host/db", "dbtable": "chunks", "user": "u"}
    with pytest.raises(ValueError):
        jdbc_options("postgresql://host/db", "chunks")


def test_text_validity_on_bytes(spark):
    from lakesearch.operators.filters import is_text

    rows = spark.createDataFrame(
        [(1, b"ok"), (2, b""), (3, b"\xff"), (4, b"\xed\xa0\x80"), (5, b"\xef\xbb\xbfx")],
        "id long, content binary",
    )
    assert {r.id for r in rows.where(is_text(F.col("content"))).collect()} == {1, 2, 5}
