"""One query per operator, over whole tables. `sql.py` has the same results in SQL."""

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import inputs as I
from lakesearch.functions import text as T
from lakesearch.functions import vectors as V
from lakesearch.operators import catalog, chunking, filters, masking, metrics, positions
from lakesearch.operators import pruning, scoring, segments, topk
from lakesearch.operators.embedding import (
    HashedEmbedder,
    ModelEmbedder,
    embed_chunks,
    embed_queries,
)
from lakesearch.plans import indexing, searching, workload
from lakesearch.session import shared_path, ship_package
from lakesearch.sources.store import IndexStore
from lakesearch.sources.tables import read_corpus

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
EMBEDDER = HashedEmbedder(64)


def query(function: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return function(spark, folder)

    REGISTERED[function.__name__] = run
    return run


def _rounded(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


# Vectors and top-k


@query
def q_topk_single(spark, folder):
    vectors = I.one_repo_vectors(spark, folder)
    entries = vectors.select(F.posexplode("embedding").alias("i", "x"))
    means = entries.groupBy("i").agg(F.avg("x").alias("m")).orderBy("i")
    centre = [row.m for row in means.collect()]  # one number per dimension
    best = topk.top_k_single(vectors, centre, 10)
    return best.select("chunk_pos", _rounded("retrieval_score"))


@query
def q_topk_batch(spark, folder):
    vectors = I.one_repo_vectors(spark, folder)
    hits = topk.top_k(vectors, I.vector_queries(vectors))
    return hits.select("query_id", "chunk_pos", "rank", _rounded("retrieval_score"))


@query
def q_topk_grouped(spark, folder):
    vectors = I.label_vectors(spark, folder)
    hits = topk.top_k(vectors, I.vector_queries(vectors, k=5))
    return hits.select("query_id", "repo_id", "chunk_pos", "rank", _rounded("retrieval_score"))


@query
def q_topk_passes(spark, folder):
    vectors = I.label_vectors(spark, folder)
    hits = topk.top_k(vectors, I.vector_queries(vectors, k=3), pass_bytes=100_000)
    return hits.select("query_id", "repo_id", "chunk_pos", "rank", _rounded("retrieval_score"))


@query
def q_topk_whole_ranking(spark, folder):
    vectors = I.label_vectors(spark, folder)
    hits = topk.top_k(vectors, I.vector_queries(vectors, k=1000), pass_bytes=10_000)
    return hits.select("query_id", "repo_id", "chunk_pos", "rank", _rounded("retrieval_score"))


@query
def q_topk_pruned(spark, folder):
    """The grouped search over parts with a bound, which skips those that cannot matter."""
    vectors = I.label_vectors(spark, folder)
    parted, parts = pruning.part_vectors(vectors, 64, per_part=50)
    hits, _ = pruning.top_k_pruned(parted, parts, I.vector_queries(vectors), 64)
    return hits.select("query_id", "repo_id", "chunk_pos", "rank", _rounded("retrieval_score"))


@query
def q_topk_shared_ids(spark, folder):
    """The same query ids asked in every repository."""
    vectors = I.label_vectors(spark, folder)
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("chunk_pos"))
    queries = vectors.select(
        place.cast("bigint").alias("query_id"), "repo_id", "embedding", F.lit(3).alias("k")
    )
    hits = topk.top_k(vectors, queries)
    return hits.select("query_id", "repo_id", "chunk_pos", "rank", _rounded("retrieval_score"))


@query
def q_lookup_positions(spark, folder):
    """Literal positions in one repository, where others use them too, and an empty list."""
    rows = I.label_vectors(spark, folder).withColumn("chunk_pos", F.col("chunk_pos") % 40)
    found = catalog.lookup_positions(rows, 3, [1, 5, 39, 77])
    none = catalog.lookup_positions(rows, 4, [])
    return found.unionByName(none).groupBy("repo_id", "chunk_pos").agg(F.count("*").alias("found"))


@query
def q_normalize(spark, folder):
    raw = I.one_repo_vectors(spark, folder).withColumn(
        "embedding",
        F.transform("embedding", lambda x: x.cast("double") * (F.col("chunk_pos") % 9)),
    )
    unit = raw.select("chunk_pos", F.posexplode(V.unit(F.col("embedding"))).alias("i", "x"))
    return unit.select("chunk_pos", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


@query
def q_float_cast(spark, folder):
    doubles = I.one_repo_vectors(spark, folder).withColumn(
        "embedding", F.transform("embedding", lambda x: x.cast("double") / 3)
    )
    cast = doubles.select(
        "chunk_pos", F.posexplode(V.as_float(F.col("embedding"))).alias("i", "x")
    )
    return cast.select("chunk_pos", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


@query
def q_dim_audit(spark, folder):
    short = I.label_vectors(spark, folder).withColumn(
        "embedding", F.slice("embedding", 1, F.when(F.col("repo_id") == 3, 63).otherwise(64))
    )
    return filters.dimension_mismatches(short, 64).select("repo_id", "chunk_pos", "found_dim")


@query
def q_vector_stats(spark, folder):
    return catalog.vector_stats(I.label_vectors(spark, folder))


def _new_store(spark: SparkSession, name: str) -> IndexStore:
    return IndexStore(spark, shared_path(spark, name)).create()


@query
def q_vector_round_trip(spark, folder):
    store = _new_store(spark, "vectors")
    store.save_vectors(I.label_vectors(spark, folder), 64)
    own = V.inner_product(F.col("embedding"), F.col("embedding"))
    return store.read("vectors").select(
        "repo_id", "chunk_pos", F.size("embedding").alias("dim"), F.round(own, 6).alias("own")
    )


@query
def q_rebuild(spark, folder):
    store = _new_store(spark, "rebuild")
    vectors = I.label_vectors(spark, folder)
    store.save_vectors(vectors, 64)
    doubled = F.transform("embedding", lambda x: x * F.lit(2.0).cast("float"))
    store.save_vectors(vectors.where("repo_id >= 5").withColumn("embedding", doubled), 64)
    length = F.round(V.norm(F.col("embedding")), 6).alias("length")
    return store.read("vectors").select("repo_id", "chunk_pos", length)


@query
def q_append_positions(spark, folder):
    store = _new_store(spark, "append")
    named = I.label_vectors(spark, folder).withColumnRenamed("chunk_pos", "vec_id")
    first = positions.dense_positions(named, ["repo_id"], [F.col("vec_id")])
    store.save_vectors(first, 64)
    store.add_vectors(named, 64, [F.col("vec_id")])
    entry = F.round(F.get("embedding", 0).cast("double"), 6).alias("x")
    return store.read("vectors").select("repo_id", "chunk_pos", entry)


@query
def q_inner_product(spark, folder):
    vectors = I.label_vectors(spark, folder)
    centre = vectors.withColumnRenamed("embedding", "other").select(
        F.col("chunk_pos").alias("next_pos"), "other"
    )
    pairs = vectors.join(centre, F.col("next_pos") == F.col("chunk_pos") + 1)
    score = F.round(V.inner_product(F.col("embedding"), F.col("other")), 6)
    return pairs.select("chunk_pos", "next_pos", score.alias("score"))


# Positions and order


@query
def q_positions(spark, folder):
    chunks = I.document_chunks(spark, folder).withColumn("repo", F.col("name"))
    keys = chunks.select("repo", "file_path", "start_line", "end_line")
    order = [T.path_parts(F.col("file_path")), F.col("start_line"), -F.col("end_line")]
    return positions.dense_positions(keys, ["repo"], order).drop("start_line", "end_line")


@query
def q_path_order(spark, folder):
    pages = I.table(spark, folder, "pages").select("page_id", "url")
    order = [T.path_parts(F.col("url")), F.col("page_id")]
    return positions.dense_positions(pages, [], order, name="place")


# Lookups, joins and audits


@query
def q_hits_join_docs(spark, folder):
    vectors = I.one_repo_vectors(spark, folder)
    hits, bound = topk.top_k_bounded(vectors, I.vector_queries(vectors))
    found = catalog.attach_chunks(hits, I.document_chunks(spark, folder), bound)
    return found.select(
        "query_id", "rank", "file_path", "name", "node_type", _rounded("retrieval_score"),
        F.md5("source_text").alias("snippet_md5"),
    )


@query
def q_hits_orphans(spark, folder):
    vectors = I.one_repo_vectors(spark, folder)
    hits = topk.top_k(vectors, I.vector_queries(vectors))
    known = I.table(spark, folder, "labels").select(
        F.lit(0).cast("bigint").alias("repo_id"), F.col("doc_id").alias("chunk_pos")
    )
    return catalog.orphan_hits(hits, known).select("query_id", "chunk_pos", "rank")


@query
def q_semi_lookup(spark, folder):
    ids = I.table(spark, folder, "labels").where("quality = 1").select(
        F.lit(0).cast("bigint").alias("repo_id"), F.col("doc_id").alias("chunk_pos")
    )
    found = catalog.lookup_table(I.document_chunks(spark, folder), ids)
    return found.select("chunk_pos", "file_path", F.length("source_text").alias("chars"))


@query
def q_cascade_delete(spark, folder):
    vectors = I.label_vectors(spark, folder)
    sizes = catalog.vector_stats(vectors)
    mean = sizes.agg(F.avg("vectors").alias("m")).first().m
    kept = catalog.delete_repos(vectors, sizes.where(F.col("vectors") < mean))
    return kept.select("repo_id", "chunk_pos")


@query
def q_empty_repos(spark, folder):
    repos = I.table(spark, folder, "documents").select(
        F.col("doc_id").alias("repo_id"), F.col("source").alias("path_or_url")
    )
    chunks = I.table(spark, folder, "labels").select(F.col("doc_id").alias("repo_id"))
    return catalog.empty_repos(repos, chunks)


@query
def q_unknown_repos(spark, folder):
    queries = I.table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("conv_id").alias("repo_id")
    )
    repos = I.table(spark, folder, "labels").select(F.col("doc_id").alias("repo_id"))
    return catalog.unknown_repos(queries, repos)


@query
def q_repo_chunks(spark, folder):
    turns = I.table(spark, folder, "conversations")
    repos = turns.groupBy(F.col("conv_id").alias("repo_id")).agg(
        F.concat(F.lit("conv/"), F.max("turn").cast("string")).alias("path_or_url")
    )
    chunks = turns.select(F.col("conv_id").alias("repo_id"), F.col("turn").alias("chunk_pos"), "role")
    return catalog.repo_chunks(repos, chunks)


@query
def q_null_audit(spark, folder):
    labels = I.table(spark, folder, "labels").withColumnRenamed("doc_id", "chunk_pos")
    rows = I.document_chunks(spark, folder).join(labels, "chunk_pos", "left")
    holes = rows.withColumn("name", F.when(F.col("quality").isNotNull(), F.col("name"))).withColumn(
        "end_line", F.when(F.col("toxic") == 0, F.col("end_line"))
    )
    return filters.not_null_violations(holes, "chunks")


@query
def q_duplicate_positions(spark, folder):
    halved = I.label_vectors(spark, folder).withColumn(
        "chunk_pos", F.floor(F.col("chunk_pos") / 8)
    )
    return catalog.duplicate_positions(halved)


@query
def q_distinct_names(spark, folder):
    turns = I.table(spark, folder, "conversations")
    return catalog.distinct_names(
        turns.select(F.col("turn").alias("repo_id"), F.col("role").alias("name"))
    )


@query
def q_new_repos(spark, folder):
    store = _new_store(spark, "repos")
    urls = I.table(spark, folder, "pages").select(F.col("url").alias("path_or_url")).distinct()
    store.append("repos", store.new_repos(urls))
    again = store.new_repos(urls)
    both = store.read("repos").unionByName(again)
    return both.select("repo_id", "path_or_url")


# Paths, text and filters


@query
def q_url_class(spark, folder):
    pages = I.table(spark, folder, "pages")
    bare = F.regexp_replace("url", "^https?://", "")
    return pages.select(
        "page_id",
        T.is_remote(F.col("url")).alias("url_remote"),
        T.is_remote(bare).alias("bare_remote"),
        T.is_remote(F.concat(F.lit("git@"), bare)).alias("ssh_remote"),
        T.is_remote(F.upper("url")).alias("upper_remote"),
    )


@query
def q_ext_filter(spark, folder):
    paths = I.odd_paths(spark, folder)
    return paths.where(filters.has_extension(F.col("path"))).select(
        "p_partkey", "path", T.extension(F.col("path")).alias("ext")
    )


@query
def q_excluded_dirs(spark, folder):
    paths = I.odd_paths(spark, folder)
    return paths.where(~filters.under_excluded_directory(F.col("path")))


@query
def q_language_map(spark, folder):
    path = F.col("path")
    return I.odd_paths(spark, folder).select(
        "p_partkey", T.base_name(path).alias("base_name"), T.language(path).alias("language")
    )


@query
def q_source_files(spark, folder):
    files = I.code_files(spark, folder)
    odd = I.odd_paths(spark, folder).select(
        F.lit(0).cast("bigint").alias("repo_id"),
        "path",
        F.when(F.col("p_partkey") % 4 == 0, F.unhex(F.lit("61FF")))
        .otherwise(F.encode("path", "utf-8"))
        .alias("content"),
    )
    return filters.source_files(files.unionByName(odd)).select("repo_id", "path")


@query
def q_text_validity(spark, folder):
    documents = I.table(spark, folder, "documents")
    bad = F.when(F.col("lang") == "de", F.unhex(F.lit("EDA080"))).otherwise(F.unhex(F.lit("")))
    content = F.concat(F.encode("text", "utf-8"), bad)
    return documents.where(filters.is_text(content)).select("doc_id", "lang")


@query
def q_corpus_table(spark, folder):
    corpus = read_corpus(spark, f"{folder}/documents.parquet", "doc_id", "source", "text")
    return corpus.select("repo_id", "path", F.length("content").alias("chars"))


@query
def q_newline_norm(spark, folder):
    documents = I.table(spark, folder, "documents")
    mixed = F.replace(
        F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit(". "), F.lit(".\r")
    )
    clean = T.normalise_newlines(mixed)
    return documents.select(
        "doc_id", F.md5(clean).alias("text_md5"), T.line_count(clean).alias("lines")
    )


@query
def q_line_count(spark, folder):
    documents = I.table(spark, folder, "documents")
    return documents.select("doc_id", T.line_count(F.col("text")).alias("lines"))


@query
def q_retrieval_text(spark, folder):
    documents = I.table(spark, folder, "documents")
    doc = F.when(F.col("lang") == "en", "").when(F.col("lang") != "fr", F.col("lang"))
    text = T.retrieval_text(F.col("source"), doc, F.col("text"))
    return documents.select("doc_id", F.md5(text).alias("text_md5"), F.length(text).alias("chars"))


@query
def q_utc_minute(spark, folder):
    events = I.table(spark, folder, "events")
    return events.select("event_id", T.utc_minute(F.col("ts")).alias("minute"))


# Segments and chunks


@query
def q_doc_segments(spark, folder):
    documents = I.table(spark, folder, "documents").select(
        F.col("doc_id").alias("repo_id"), F.col("source").alias("file_path"), "text"
    )
    return segments.document_lines(documents).drop("docstring")


def _pages(spark, folder):
    return I.table(spark, folder, "pages").select(
        F.col("page_id").alias("repo_id"), F.col("url").alias("file_path"),
        F.col("html").alias("text"),
    )


@query
def q_page_elements(spark, folder):
    return segments.page_elements(_pages(spark, folder)).drop("docstring", "file_path")


@query
def q_page_coverage(spark, folder):
    """Visible characters, blanks apart, of each page's pieces: none of the page is lost or repeated."""
    found = segments.page_elements(_pages(spark, folder)).where("node_type = 'element'")
    visible = F.regexp_replace(F.regexp_replace("source_text", segments.INLINE, ""), r"\s+", "")
    return found.groupBy("repo_id").agg(
        F.sum(F.length(visible)).alias("chars"),
        F.min("start_line").alias("first_line"),
        F.max("end_line").alias("last_line"),
    )


@query
def q_turn_chunks(spark, folder):
    turns = I.table(spark, folder, "conversations").select(
        F.lit(0).cast("bigint").alias("repo_id"),
        F.col("conv_id").cast("string").alias("file_path"), "turn", "role", "text",
    )
    return segments.dialogue_turns(turns).drop("docstring")


def _code(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.decoded(I.code_files(spark, folder))


def _chunk_columns(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "repo_id", "file_path", "node_type", "name", "start_line", "end_line", "source_text",
        "docstring",
    )


def _masked_code(spark, folder) -> DataFrame:
    files = _code(spark, folder)
    rules = {
        "python": masking.mask_python,
        "go": masking.mask_go,
        "javascript": masking.mask_script,
        "typescript": masking.mask_script,
    }
    language = T.language(F.col("path"))
    masked = F.lit(None).cast("string")
    for rule in dict.fromkeys(rules.values()):
        own = language.isin([name for name in rules if rules[name] is rule])
        masked = F.when(own, rule(F.when(own, F.col("text")))).otherwise(masked)
    return files.where(language.isNotNull()).select("path", masked.alias("masked"))


@query
def q_mask_keeps_length(spark, folder):
    masked = F.col("masked")
    return _masked_code(spark, folder).select(
        "path", F.length(masked).alias("masked_chars"), T.line_count(masked).alias("masked_lines")
    )


@query
def q_mask_text(spark, folder):
    """The masked text itself, with signs that can be printed."""
    return _masked_code(spark, folder).select(
        "path", F.translate("masked", masking.OPEN + masking.FILL, "^~").alias("masked")
    )


@query
def q_py_chunks(spark, folder):
    files = _code(spark, folder).where(T.language(F.col("path")) == "python")
    return _chunk_columns(chunking.chunk_files(files))


@query
def q_brace_chunks(spark, folder):
    files = _code(spark, folder).where(T.language(F.col("path")).isin("go", "javascript", "typescript"))
    return _chunk_columns(chunking.chunk_files(files))


@query
def q_file_fallback(spark, folder):
    chunks = chunking.chunk_files(_code(spark, folder))
    return _chunk_columns(chunks.where("node_type = 'file'"))


@query
def q_method_labels(spark, folder):
    chunks = chunking.chunk_files(_code(spark, folder))
    return chunks.groupBy("repo_id", "node_type", "name").agg(F.count("*").alias("chunks"))


@query
def q_code_positions(spark, folder):
    placed = chunking.chunk_files_with_positions(_code(spark, folder))
    return placed.select(
        "repo_id", "chunk_pos", "file_path", "node_type", "name", "start_line", "end_line"
    )


# Embedding, scoring and search


@query
def q_hash_embed(spark, folder):
    chunks = I.document_chunks(spark, folder)
    embedded = embed_chunks(chunks, EMBEDDER)
    values = F.transform("embedding", lambda x: F.round(x.cast("double"), 6))
    return embedded.select("chunk_pos", F.posexplode(values).alias("bucket", "x"))


@query
def q_query_embed(spark, folder):
    embedded = embed_queries(I.benchmark_queries(spark, folder), EMBEDDER)
    values = F.transform("embedding", lambda x: F.round(x.cast("double"), 6))
    return embedded.select("query_id", F.posexplode(values).alias("bucket", "x"))


@query
def q_hash_search(spark, folder):
    vectors = embed_chunks(I.document_chunks(spark, folder), EMBEDDER)
    queries = embed_queries(I.benchmark_queries(spark, folder), EMBEDDER)
    hits = topk.top_k(vectors, queries, minimum=scoring.SHORTLIST)
    return hits.select("query_id", "chunk_pos", "rank", _rounded("retrieval_score"))


def _document_search(spark: SparkSession, folder: str, cut: bool = True) -> DataFrame:
    chunks = I.document_chunks(spark, folder)
    scorer = scoring.LexicalScorer(scoring.term_statistics(chunks), scoring.repo_sizes(chunks))
    vectors = embed_chunks(chunks, EMBEDDER)
    queries = I.benchmark_queries(spark, folder)
    return searching.search_tables(vectors, chunks, queries, EMBEDDER, scorer, cut)


@query
def q_term_statistics(spark, folder):
    return scoring.term_statistics(I.document_chunks(spark, folder))


@query
def q_pair_score(spark, folder):
    found = _document_search(spark, folder, cut=False)
    return found.select("query_id", "file_path", _rounded("score"), _rounded("retrieval_score"))


@query
def q_rerank(spark, folder):
    found = _document_search(spark, folder, cut=False)
    return found.select("query_id", "rank", "file_path", _rounded("score"))


def _models():
    """A text model and a pair model that SQL can repeat; they travel to the workers by value."""

    def sizes():
        def predict(texts):
            counts = [(len(t), t.count("a"), t.count("e"), 1) for t in texts]
            return np.array(counts, dtype="float32")

        return predict

    def closeness():
        def predict(asked, texts):
            gaps = [abs(q.count("e") - t.count("e")) for q, t in zip(asked, texts)]
            return np.array([-g for g in gaps], dtype="float32")

        return predict

    return sizes, closeness


@query
def q_model_embed(spark, folder):
    """All documents through a plugged-in text model."""
    embedded = embed_chunks(I.document_chunks(spark, folder), ModelEmbedder(_models()[0], dim=4))
    values = F.transform("embedding", lambda x: F.round(x.cast("double"), 6))
    return embedded.select("chunk_pos", F.posexplode(values).alias("bucket", "x"))


@query
def q_model_score(spark, folder):
    """Candidates of all benchmark texts, scored and ranked by a plugged-in pair model."""
    chunks = I.document_chunks(spark, folder)
    scorer = scoring.ModelScorer(_models()[1])
    queries = I.benchmark_queries(spark, folder)
    vectors = embed_chunks(chunks, EMBEDDER)
    found = searching.search_tables(vectors, chunks, queries, EMBEDDER, scorer, cut=False)
    return found.select("query_id", "rank", "file_path", "score")


@query
def q_stored_vectors(spark, folder):
    """One repository of a stored index, with the dimension that the store reports."""
    store = _new_store(spark, "stored")
    store.save_vectors(I.label_vectors(spark, folder), 64)
    own = V.inner_product(F.col("embedding"), F.col("embedding"))
    return store.read("vectors", [3]).select(
        "repo_id", "chunk_pos", F.lit(store.dim(3)).alias("dim"), F.round(own, 6).alias("own")
    )


@query
def q_display_rows(spark, folder):
    found = _document_search(spark, folder)
    return found.select("query_id", "rank", *T.display_columns())


@query
def q_search_e2e(spark, folder):
    store = _new_store(spark, "search")
    files = I.document_files(spark, folder)
    indexing.index_files(store, files, _language_repos(files), EMBEDDER)
    queries = I.table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"),
        (F.col("item_id") % 4 + 1).alias("repo_id"),
        "text",
        F.lit(5).alias("k"),
    )
    found = searching.search_index(store, queries, EMBEDDER)
    return found.select(
        "query_id", "rank", "file_path", "name", "node_type", "start_line", "end_line",
        _rounded("score"), F.md5("snippet").alias("snippet_md5"),
    )


def _language_repos(files: DataFrame) -> DataFrame:
    return files.select("repo_id").distinct().select(
        "repo_id",
        F.concat(F.lit("docs/"), F.col("repo_id").cast("string")).alias("path_or_url"),
        F.current_timestamp().alias("indexed_at"),
    )


def _contents(index) -> DataFrame:
    """What each repository of a version holds, in every table."""
    chunks = index.read("chunks").groupBy("repo_id").agg(
        F.count("*").alias("chunks"), F.sum(F.length("source_text")).alias("chars")
    )
    vectors = index.read("vectors").groupBy("repo_id").agg(
        F.count("*").alias("vectors"), F.sum("chunk_pos").alias("positions")
    )
    terms = index.read("terms").groupBy("repo_id").agg(
        F.count("*").alias("terms"), F.sum("chunks_with_term").alias("uses")
    )
    repos = index.read("repos").select("repo_id", "path_or_url")
    return repos.join(chunks, "repo_id", "left").join(vectors, "repo_id", "left").join(terms, "repo_id", "left")


@query
def q_reindex(spark, folder):
    """Two of four repositories indexed again with other texts: the version before, which a reader may
    still hold, and the one after."""
    store = _new_store(spark, "reindex")
    files = I.document_files(spark, folder)
    indexing.index_files(store, files, _language_repos(files), EMBEDDER)
    before = store.snapshot()
    changed = files.where("repo_id in (1, 3)").withColumn(
        "content", F.encode(F.concat(F.lit("again "), F.decode("content", "utf-8")), "utf-8")
    )
    indexing.index_files(store, changed, _language_repos(changed), EMBEDDER)
    both = _contents(before).withColumn("version", F.lit("before"))
    return both.unionByName(_contents(store.snapshot()).withColumn("version", F.lit("after")))


@query
def q_delete_repos(spark, folder):
    """Repositories with fewer vectors than the mean go, with all that belongs to them, in one commit."""
    store = _new_store(spark, "delete")
    vectors = I.label_vectors(spark, folder)
    counts = vectors.groupBy("repo_id").agg(F.count("*").alias("n"))
    marked = counts.select(
        "repo_id", F.concat(F.lit("label/"), "repo_id").alias("path_or_url"), F.current_timestamp().alias("indexed_at")
    )
    with store.writing() as write:
        write.replace("vectors", vectors, ["chunk_pos"])
        write.replace("repos", marked)
    store.delete(counts.join(counts.agg(F.avg("n").alias("mean")), F.col("n") < F.col("mean")))
    index = store.snapshot()
    return index.read("repos").join(index.read("vectors"), "repo_id").select("repo_id", "path_or_url", "chunk_pos")


@query
def q_index_summary(spark, folder):
    store = _new_store(spark, "index")
    files = I.code_files(spark, folder)
    repos = files.groupBy("repo_id").agg(F.min("path").alias("path_or_url")).withColumn(
        "indexed_at", F.current_timestamp()
    )
    return indexing.index_files(store, files, repos, EMBEDDER)


@query
def q_workload(spark, folder):
    chunks = I.document_chunks(spark, folder)
    scorer = scoring.LexicalScorer(scoring.term_statistics(chunks), scoring.repo_sizes(chunks))
    found = workload.run_workload(embed_chunks(chunks, EMBEDDER), chunks, EMBEDDER, scorer, 30, 0)
    return found.select("query_id", "rank", "file_path", _rounded("score"))


# Measurements


@query
def q_floor_percentile(spark, folder):
    events = I.table(spark, folder, "events")
    return metrics.floor_percentile(events, ["event_type"], "value", 0.29, "p29")


@query
def q_latency_summary(spark, folder):
    events = I.table(spark, folder, "events")
    summary = metrics.latency_summary(events, ["event_type"], "value")
    return summary.withColumn("mean", F.round("mean", 6))


@query
def q_latency_overall(spark, folder):
    lines = I.table(spark, folder, "lineitem")
    summary = metrics.summary_or_zero(metrics.latency_summary(lines, [], "l_extendedprice"))
    return summary.withColumn("mean", F.round("mean", 4))


@query
def q_cyclic_workload(spark, folder):
    base = I.table(spark, folder, "benchmark").withColumnRenamed("item_id", "item")
    return metrics.cyclic_workload(base, I.table(spark, folder, "documents").count())
