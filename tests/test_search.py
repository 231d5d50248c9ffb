import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesearch.operators import catalog, scoring, topk
from lakesearch.operators.embedding import HashedEmbedder, ModelEmbedder, embed_chunks
from lakesearch.plans.searching import search_tables

VECTORS = "repo_id bigint, chunk_pos bigint, embedding array<float>"
QUERIES = "query_id bigint, repo_id bigint, embedding array<float>, k int"


def unit_rows(n, dim=16, seed=42):
    data = np.random.default_rng(seed).normal(size=(n, dim)).astype("float32")
    return data / np.linalg.norm(data, axis=1, keepdims=True)


def frame(spark, data, repo=1):
    return spark.createDataFrame([(repo, i, v.tolist()) for i, v in enumerate(data)], VECTORS)


def asked(spark, data, k=3, repo=1):
    return spark.createDataFrame([(i, repo, v.tolist(), k) for i, v in enumerate(data)], QUERIES)


def ranking(hits):
    rows = hits.collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.chunk_pos)
    return found


def brute(data, query, k):
    scores = data.astype("f8") @ query.astype("f8")
    return sorted(range(len(data)), key=lambda i: (-round(scores[i], 12), i))[:k]


def test_self_match_and_order(spark):
    data = unit_rows(5)
    hits = topk.top_k(frame(spark, data), asked(spark, data, k=10)).collect()
    assert len(hits) == 25  # k is capped at the number of vectors
    best = {r.query_id: r for r in hits if r["rank"] == 1}
    assert all(best[i].chunk_pos == i and best[i].retrieval_score > 0.999 for i in range(5))


def test_top_k_equals_brute_force_with_copies(spark):
    data = unit_rows(300)
    data[100:220] = data[7]  # more than a third of all rows are copies of one vector
    queries = np.concatenate([unit_rows(20, seed=1), data[7:8]])
    got = ranking(topk.top_k(frame(spark, data).repartition(5), asked(spark, queries, k=9)))
    assert got == {i: brute(data, q, 9) for i, q in enumerate(queries)}


def test_passes_and_partitions_agree(spark):
    data, queries = unit_rows(200), unit_rows(30, seed=3)
    vectors = frame(spark, data)
    plain = ranking(topk.top_k(vectors.repartition(1), asked(spark, queries)))
    assert ranking(topk.top_k(vectors.repartition(16), asked(spark, queries))) == plain
    assert ranking(topk.top_k(vectors, asked(spark, queries), pass_bytes=1000)) == plain


def test_a_very_large_k_is_a_whole_ranking(spark):
    data, queries = unit_rows(60), unit_rows(4, seed=5)
    got = ranking(topk.top_k(frame(spark, data), asked(spark, queries, k=1000), pass_bytes=2000))
    assert got == {i: brute(data, q, 60) for i, q in enumerate(queries)}


def test_k_is_per_query_and_prefixes_agree(spark):
    data, queries = unit_rows(80), unit_rows(3, seed=9)
    mixed = asked(spark, queries).withColumn("k", (F.col("query_id") + 1).cast("int"))
    short = ranking(topk.top_k(frame(spark, data), mixed))
    assert [len(short[i]) for i in range(3)] == [1, 2, 3]
    longer = ranking(topk.top_k(frame(spark, data), asked(spark, queries, k=8)))
    assert all(longer[i][: len(short[i])] == short[i] for i in range(3))
    shortlist = ranking(topk.top_k(frame(spark, data), mixed, minimum=10))
    assert all(len(shortlist[i]) == 10 for i in range(3))


def test_repositories_are_searched_separately(spark):
    data = unit_rows(40)
    both = frame(spark, data[:20], 1).unionByName(frame(spark, data[20:], 2))
    hits = topk.top_k(both, asked(spark, data[:2], repo=2)).collect()
    assert {r.repo_id for r in hits} == {2}
    assert topk.top_k(both, asked(spark, data[:2], repo=9)).count() == 0


def test_empty_inputs_and_bad_k(spark):
    data = unit_rows(5)
    none = spark.createDataFrame([], VECTORS)
    assert topk.top_k(none, asked(spark, data)).count() == 0
    assert topk.top_k(frame(spark, data), asked(spark, data).where("false")).count() == 0
    with pytest.raises(ValueError, match="k must be"):
        topk.top_k(frame(spark, data), asked(spark, data, k=0))


def test_wrong_dimension_is_an_error(spark):
    with pytest.raises(Exception, match="dimension mismatch"):
        topk.top_k(frame(spark, unit_rows(3, 17)), asked(spark, unit_rows(3, 16))).collect()


def test_single_query(spark):
    data = unit_rows(50)
    best = topk.top_k_single(frame(spark, data), data[4].tolist(), 5)
    assert [r.chunk_pos for r in best.collect()] == brute(data, data[4], 5)
    assert "TakeOrderedAndProject" in best._jdf.queryExecution().executedPlan().toString()


def test_top_k_keeps_k_rows_per_partition_before_the_shuffle(spark):
    data = unit_rows(20)
    plan = topk.top_k(frame(spark, data), asked(spark, data))._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.count("WindowGroupLimit") == 2
    assert "Cartesian" not in text and "NestedLoop" not in text


CHUNKS = (
    "repo_id bigint, chunk_pos bigint, file_path string, node_type string, name string, "
    "start_line int, end_line int, source_text string, docstring string"
)


@pytest.fixture
def chunks(spark):
    texts = [
        ("draw", "def draw(canvas): paint(canvas)", None),
        ("login", "def login(user, password): check(user, password)", "Authenticate a user."),
        ("parse", "def parse(path): return read(path)", "Parse a configuration file."),
    ]
    rows = [(1, i, "a.py", "function", n, i + 1, i + 1, s, d) for i, (n, s, d) in enumerate(texts)]
    return spark.createDataFrame(rows, CHUNKS)


def text_queries(spark, *texts, k=3):
    rows = [(i, 1, t, k) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id bigint, repo_id bigint, text string, k int")


def lexical(chunks):
    return scoring.LexicalScorer(scoring.term_statistics(chunks), scoring.repo_sizes(chunks))


def test_search_puts_the_right_chunk_first(spark, chunks):
    embedder = HashedEmbedder(64)
    queries = text_queries(spark, "authenticate a user", "parse a configuration file")
    found = search_tables(embed_chunks(chunks, embedder), chunks, queries, embedder, lexical(chunks))
    rows = found.collect()
    best = {r.query_id: r.name for r in rows if r["rank"] == 1}
    assert best == {0: "login", 1: "parse"}
    assert len(rows) == 6  # no candidate is lost
    for q in (0, 1):
        scores = [r.score for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q]
        assert scores == sorted(scores, reverse=True)


def test_query_without_known_terms_keeps_retrieval_order(spark, chunks):
    embedder = HashedEmbedder(64)
    queries = text_queries(spark, "", "zzz")
    found = search_tables(
        embed_chunks(chunks, embedder), chunks, queries, embedder, lexical(chunks)
    ).collect()
    assert len(found) == 6 and {r.score for r in found} == {0.0}
    ordered = sorted((r for r in found if r.query_id == 1), key=lambda r: r["rank"])
    scores = [r.retrieval_score for r in ordered]
    assert scores == sorted(scores, reverse=True)


def test_hits_without_metadata_are_dropped(spark, chunks):
    hits = spark.createDataFrame(
        [(0, 1, 0, 0.9, 1), (0, 1, 77, 0.8, 2)],
        "query_id bigint, repo_id bigint, chunk_pos bigint, retrieval_score double, rank int",
    )
    assert [r.chunk_pos for r in catalog.attach_chunks(hits, chunks, 2).collect()] == [0]
    assert [r.chunk_pos for r in catalog.orphan_hits(hits, chunks).collect()] == [77]


def test_hashed_embedder_counts_every_token(spark):
    text = "alpha beta alpha_1 beta Alpha " * 50
    for dim in (1, 7, 64, 100):
        embedder = HashedEmbedder(dim)
        row = spark.createDataFrame([(text,)], "t string").select(
            embedder.counts(F.col("t")).alias("c"), embedder.column(F.col("t")).alias("v")
        ).first()
        assert len(row.c) == dim and sum(row.c) == 250
        assert abs(sum(x * x for x in row.v) - 1) < 1e-5


def models():
    """(embedding model, pair model); local functions travel to the workers by value."""

    def lengths():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype="float32")

    def overlap():
        def predict(queries, texts):
            shared = [len(set(q.split()) & set(t.split())) for q, t in zip(queries, texts)]
            return np.array(shared, dtype="float32")

        return predict

    return lengths, overlap


def test_models_can_be_plugged_in(spark, chunks):
    lengths, overlap = models()
    embedder = ModelEmbedder(lengths, dim=2, batch_size=2)
    scorer = scoring.ModelScorer(overlap)
    queries = text_queries(spark, "Parse a configuration file.", k=1)
    found = search_tables(embed_chunks(chunks, embedder), chunks, queries, embedder, scorer)
    rows = found.collect()
    assert [r.name for r in rows] == ["parse"] and rows[0].score == 4.0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The pair model runs above the shortlist, on ranked candidates only.
    assert plan.index("predict(") < plan.index("MapInArrow")


def test_model_of_another_dimension_fails(spark, chunks):
    embedder = ModelEmbedder(models()[0], dim=3)
    with pytest.raises(Exception, match="dimension mismatch"):
        embed_chunks(chunks, embedder).collect()


def test_large_k_emits_rows_near_k(spark, monkeypatch):
    """Selection by a bound of the k-th score: no list of all pairs."""
    pick = np.random.default_rng(7)
    n, k = 4_000, 300
    stored = pick.standard_normal((n, 8)).astype(np.float32)
    stored[100:160] = stored[99]  # ties
    data = [(1 + (i % 4 == 0), i, [float(x) for x in row]) for i, row in enumerate(stored)]
    vectors = spark.createDataFrame(data, "repo_id long, chunk_pos long, embedding array<float>").repartition(3).cache()
    asked = spark.createDataFrame(
        [(q, r, [float(x) for x in pick.standard_normal(8)], k if q else 10_000) for q in range(3) for r in (1, 2)],
        "query_id long, repo_id long, embedding array<float>, k long",
    ).cache()
    emitted = []
    number = topk.dense_positions

    def counted(rows, *args, **names):
        emitted.append({(r.query_id, r.repo_id): r["count"] for r in rows.groupBy("query_id", "repo_id").count().collect()})
        return number(rows, *args, **names)

    monkeypatch.setattr(topk, "dense_positions", counted)
    got = {}
    for r in topk.top_k(vectors, asked, pass_bytes=24 * 100).collect():
        got.setdefault((r.query_id, r.repo_id), []).append((r["rank"], r.chunk_pos, r.retrieval_score))
    for q in asked.collect():
        own = [(sum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(e, q.embedding)), p) for r, p, e in data if r == q.repo_id]
        best = sorted(own, key=lambda x: (-x[0], x[1]))[: q.k]
        found = sorted(got[q.query_id, q.repo_id])
        assert [r for r, _, _ in found] == list(range(1, len(best) + 1))
        assert [p for _, p, _ in found] == [p for _, p in best]
        # One share of each batch more than k, ties included, at most.
        if q.k < len(own):
            assert emitted[0][q.query_id, q.repo_id] < q.k + len(own) // 8 + 61


def test_long_lists_are_ranked_without_one_window(spark, monkeypatch):
    from lakesearch.operators import scoring

    chunks = [(1, i, f"n{i}", "word " * (i % 7) + f"w{i}") for i in range(200)]
    rows = [(q, 1, p, i + 1, n, t) for q in (1, 2) for i, (_, p, n, t) in enumerate(chunks)]
    candidates = spark.createDataFrame(
        rows, "query_id long, repo_id long, chunk_pos long, rank int, name string, source_text string"
    ).withColumn("docstring", F.lit(None).cast("string"))
    queries = spark.createDataFrame(
        [(1, 1, "word", 500), (2, 1, "word w7", 5)], "query_id long, repo_id long, text string, k long"
    )

    class Length:
        def score(self, pairs, queries):
            return pairs.withColumn("score", (F.length("candidate_text") % 5).cast("double"))

    def ranks():
        return {(r.query_id, r.chunk_pos): r.final_rank for r in scoring.rerank(candidates, queries, Length()).collect()}

    plain = ranks()
    monkeypatch.setattr(scoring, "RANKED", 100)
    sorted_in_one = []
    ranked = scoring._ranked
    monkeypatch.setattr(scoring, "_ranked", lambda c, *a: sorted_in_one.append(c.count()) or ranked(c, *a))
    assert ranks() == plain and len(plain) == 400
    assert sorted_in_one == [200]  # the short list only


def clustered(spark, n, dim=16, clusters=20):
    """Vectors around few directions, as embeddings are, in two repositories and one small one."""
    pick = np.random.default_rng(3)
    centres = pick.standard_normal((clusters, dim))
    stored = centres[pick.integers(0, clusters, n)] + 0.05 * pick.standard_normal((n, dim))
    stored /= np.linalg.norm(stored, axis=1, keepdims=True)
    stored[50:60] = stored[49]  # ties
    data = [(1 + (i % 3 == 0) if i >= 5 else 9, i, [float(x) for x in np.float32(row)]) for i, row in enumerate(stored)]
    vectors = spark.createDataFrame(data, "repo_id long, chunk_pos long, embedding array<float>").repartition(4).cache()
    asked = [(q, r, [float(x) for x in np.float32(stored[10 + 7 * q])], k) for q, k in enumerate([1, 5, 12, None]) for r in (1, 2, 9, 77)]
    return vectors, spark.createDataFrame(asked, "query_id long, repo_id long, embedding array<float>, k int")


@pytest.mark.parametrize("pass_bytes", [64 << 20, 6_000])
def test_pruned_search_equals_a_full_one_and_skips_parts(spark, pass_bytes):
    from lakesearch.operators import pruning

    vectors, queries = clustered(spark, 6_000)
    parted, parts = pruning.part_vectors(vectors, 16, per_part=60, pass_bytes=pass_bytes)
    found, visits = pruning.top_k_pruned(parted, parts, queries, 16, pass_bytes)
    rows = lambda df: sorted((r.query_id, r.repo_id, r["rank"], r.chunk_pos, r.retrieval_score) for r in df.collect())
    assert rows(found) == rows(topk.top_k(vectors, queries))
    assert parted.count() == 6_000 and parts.sizes.sum() + vectors.where("repo_id = 9").count() >= 6_000
    if pass_bytes > 1 << 20:
        met = visits.where("home < 9").groupBy("query_id", "home").count().collect()
        whole = {r: (parts.repos == r).sum() for r in (1, 2)}
        assert len(met) == 8 and all(row["count"] < 0.5 * whole[row.home] for row in met)


def test_pruning_of_odd_tables(spark):
    from lakesearch.operators import pruning

    vectors, queries = clustered(spark, 300)
    none, parts = pruning.part_vectors(vectors.where("false"), 16)
    assert pruning.top_k_pruned(none, parts, queries, 16)[0].count() == 0
    parted, parts = pruning.part_vectors(vectors, 16, per_part=10)
    assert pruning.top_k_pruned(parted, parts, queries.where("false"), 16)[0].count() == 0
    with pytest.raises(ValueError, match="at least 1"):
        pruning.top_k_pruned(parted, parts, queries.withColumn("k", F.lit(0)), 16)
    zero = spark.createDataFrame([(1, 1, [0.0] * 16, 3)], queries.schema)
    found = pruning.top_k_pruned(parted, parts, zero, 16)[0].orderBy("rank").collect()
    first = sorted(r.chunk_pos for r in vectors.where("repo_id = 1").collect())[:3]
    assert [r.chunk_pos for r in found] == first  # all scores are equal: order by position


def test_small_passes_of_a_large_k_write_few_sketches(spark, monkeypatch):
    """However small a pass, a query's sketch is not a list of all vectors."""
    data, queries = unit_rows(900), unit_rows(12, seed=4)
    written, cut = [], topk.cut_lineage

    def counted(rows):
        done = cut(rows)
        written.append(done.count() if "weight" in done.columns else 0)
        return done

    monkeypatch.setattr(topk, "cut_lineage", counted)
    got = ranking(topk.top_k(frame(spark, data), asked(spark, queries, k=200), pass_bytes=2000))
    assert got == {i: brute(data, q, 200) for i, q in enumerate(queries)}
    assert 0 < max(written) <= len(queries) * topk.SKETCH


def test_pruned_search_writes_no_row_per_query_and_part(spark, monkeypatch):
    """Where bounds skip nothing, the visits are not written one by one."""
    from lakesearch.operators import pruning

    data = unit_rows(1500)
    vectors, queries = frame(spark, data), asked(spark, data[:60], k=5)
    parted, parts = pruning.part_vectors(vectors, 16, per_part=10)
    written, cut = [], pruning.cut_lineage

    def counted(rows):
        done = cut(rows)
        written.append(done.count())
        return done

    monkeypatch.setattr(pruning, "cut_lineage", counted)
    found, visits = pruning.top_k_pruned(parted, parts, queries, 16)
    assert ranking(found) == {i: brute(data, q, 5) for i, q in enumerate(data[:60])}
    assert visits.count() > 60 * 0.8 * len(parts.repos) > 5 * max(written)


def test_a_block_of_queries_takes_little_beside_itself():
    """Neither a second copy of the queries nor a sort of all lists at once."""
    import tracemalloc

    import pyarrow as pa

    n, k = 60_000, 10
    queries = unit_rows(n, 64)
    stored = pa.RecordBatch.from_pydict(
        {
            "repo_id": np.zeros(300, np.int64),
            "chunk_pos": np.arange(300),
            "embedding": pa.array(list(unit_rows(300, 64, seed=6)), pa.list_(pa.float32())),
        }
    )
    ids, repos, ks = np.arange(n), np.zeros(n, np.int64), np.full(n, k)
    tracemalloc.start()
    try:
        done = list(topk._best_in_partition([stored], ids, repos, ks, np.full(n, -np.inf), queries))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(b.num_rows for b in done) == n * k
    assert peak < 5 * 24 * k * n


def test_a_query_asked_twice_counts_its_hits_as_before(spark):
    """Floors come from lists in which such a hit stands four times; the last visit must count alike."""
    from lakesearch.operators import pruning

    data = unit_rows(200)
    queries = asked(spark, data[:4], k=6)
    parted, parts = pruning.part_vectors(frame(spark, data), 16, per_part=10)
    found, _ = pruning.top_k_pruned(parted, parts, queries.unionByName(queries), 16)
    best = {i: brute(data, q, 2) for i, q in enumerate(data[:4])}
    assert ranking(found) == {i: [a] * 4 + [b] * 2 for i, (a, b) in best.items()}
    long = ranking(topk.top_k(frame(spark, data), queries.unionByName(queries).withColumn("k", F.lit(100)), pass_bytes=2000))
    assert {i: len(hits) for i, hits in long.items()} == dict.fromkeys(range(4), 200)
