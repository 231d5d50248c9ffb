import pytest
from pyspark.sql import functions as F

from lakesearch.functions import vectors as V
from lakesearch.operators import filters, topk
from lakesearch.operators.embedding import HashedEmbedder
from lakesearch.plans.indexing import index_files
from lakesearch.plans.searching import search_index
from lakesearch.session import shared_path
from lakesearch.sources.store import IndexStore

VECTORS = "repo_id bigint, chunk_pos bigint, embedding array<float>"
ASKED = "query_id bigint, repo_id bigint, embedding array<float>, k int"
PASSES = {"normal k": 64 << 20, "large k": 24}


def searches(vectors, queries, k):
    """The same search by every path."""
    first = queries.first().embedding
    return [
        *(lambda size=size: topk.top_k(vectors, queries, pass_bytes=size) for size in PASSES.values()),
        lambda: topk.top_k_single(vectors, first, k),
    ]


@pytest.mark.parametrize("bad", [[float("nan"), 0.0], [float("inf"), 0.0], [1.0], [1.0, None]])
def test_every_path_rejects_the_same_vectors(spark, bad):
    rows = [(1, k, [1.0, k / 10]) for k in range(8)] + [(1, 8, bad)]
    vectors = spark.createDataFrame(rows, VECTORS)
    queries = spark.createDataFrame([(0, 1, [1.0, 1.0], 3)], ASKED)
    for search in searches(vectors, queries, 3):
        with pytest.raises(Exception, match="not finite|dimension|mismatch"):
            search().collect()
    assert filters.dimension_mismatches(vectors, 2).count() == 1


def test_one_query_id_in_two_repositories(spark):
    rows = [(r, k, [float(r), k / 10]) for r in (1, 2) for k in range(6)]
    vectors = spark.createDataFrame(rows, VECTORS)
    queries = spark.createDataFrame([(0, 1, [1.0, 1.0], 2), (0, 2, [1.0, -1.0], 2)], ASKED)
    want = [(1, 5, 1), (1, 4, 2), (2, 0, 1), (2, 1, 2)]
    for size in PASSES.values():
        hits = topk.top_k(vectors, queries, pass_bytes=size)
        got = sorted((r.repo_id, r["rank"], r.chunk_pos) for r in hits.collect())
        assert got == sorted((r, n, p) for r, p, n in want)


def test_many_queries_do_not_pass_the_driver(spark, monkeypatch):
    rows = [(1 if k % 3 else 2, k, [k / 50, 1 - k / 50]) for k in range(50)]
    vectors = spark.createDataFrame(rows, VECTORS)
    queries = spark.createDataFrame([(k, 1 + k % 2, [1.0, k / 9], 2) for k in range(40)], ASKED)
    key = ["query_id", "repo_id", "rank", "chunk_pos"]
    want = sorted(map(tuple, topk.top_k(vectors, queries).select(key).collect()))

    def refuse(*_):
        raise AssertionError("a query table came to the driver")

    monkeypatch.setattr(type(vectors), "toArrow", refuse)
    monkeypatch.setattr(type(vectors), "toPandas", refuse)
    hits = topk.top_k(vectors, queries, pass_bytes=400)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert sorted(map(tuple, hits.select(key).collect())) == want and len(want) == 80


def test_a_model_sees_each_query_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def model(text):
        seen.add(1)
        return [1.0, float(len(text))]

    texts = spark.createDataFrame([(k, 1, "x" * k, 2) for k in range(10)], "query_id bigint, repo_id bigint, text string, k int")
    queries = texts.withColumn("embedding", model("text"))
    vectors = spark.createDataFrame([(1, k, [1.0, float(k)]) for k in range(5)], VECTORS)
    assert topk.top_k(vectors, queries).count() == 20
    assert seen.value == 10


def corpus(spark, texts):
    rows = [(r, f"f{i}.txt", t.encode()) for i, (r, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "repo_id bigint, path string, content binary")


def marked(spark, *ids):
    rows = spark.createDataFrame([(i, f"at/{i}") for i in ids], "repo_id bigint, path_or_url string")
    return rows.withColumn("indexed_at", F.current_timestamp())


def test_only_named_repositories_are_written_again(spark):
    store = IndexStore(spark, shared_path(spark, "named")).create()
    embedder = HashedEmbedder(16)
    index_files(store, corpus(spark, [(1, "alpha"), (1, "beta"), (2, "gamma")]), marked(spark, 1, 2), embedder)
    changed = corpus(spark, [(1, "other"), (2, "delta"), (2, "gamma")])
    index_files(store, changed, marked(spark, 2), embedder)
    counts = {
        t: {r.repo_id: r["count"] for r in store.read(t).groupBy("repo_id").count().collect()}
        for t in ("chunks", "vectors")
    }
    assert counts["chunks"] == counts["vectors"] == {1: 2, 2: 2}
    texts = {r.source_text for r in store.read("chunks", [1]).collect()}
    assert texts == {"alpha", "beta"}


def test_stale_terms_go(spark):
    store = IndexStore(spark, shared_path(spark, "stale")).create()
    embedder = HashedEmbedder(16)
    index_files(store, corpus(spark, [(1, "alpha beta")]), marked(spark, 1), embedder)
    assert "alpha" in {r.term for r in store.read("terms").collect()}
    empty = spark.createDataFrame([(1, "é", b"")], "repo_id bigint, path string, content binary")
    index_files(store, empty, marked(spark, 1), embedder)
    assert not store.read("terms").where("term in ('alpha', 'beta')").count()


def test_search_of_one_id_in_two_repositories(spark):
    store = IndexStore(spark, shared_path(spark, "two")).create()
    embedder = HashedEmbedder(16)
    files = corpus(spark, [(1, "red apple"), (1, "blue sky"), (2, "red apple pie"), (2, "deep sea")])
    index_files(store, files, marked(spark, 1, 2), embedder)
    queries = spark.createDataFrame(
        [(7, 1, "blue sky", 1), (7, 2, "red apple", 2)], "query_id bigint, repo_id bigint, text string, k int"
    )
    found = search_index(store, queries, embedder).collect()
    got = {(r.repo_id, r["rank"]): r.snippet for r in found}
    assert got[1, 1] == "blue sky" and got[2, 1] == "red apple pie" and len(got) == 3


def test_finite(spark):
    rows = [([1.0, 2.0],), ([float("nan")],), ([float("-inf")],), ([None],), ([],)]
    table = spark.createDataFrame(rows, "v array<double>")
    assert [r[0] for r in table.select(V.finite(F.col("v"))).collect()] == [True, False, False, False, True]
