"""Exact inner-product top-k of many queries against many vectors."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lakesearch.functions import vectors as V
from lakesearch.operators.positions import dense_positions, running_offset
from lakesearch.session import cut_lineage

DEFAULT_K = 10
# The vectors of the queries that a task holds, and its running top-k state, stay about this
# size. Query tables of this size are sent to every worker; larger ones are shuffled in blocks.
PASS_BYTES = 64 * 1024 * 1024
# Score cells computed at a time, and pairs rescored at a time.
TILE_CELLS = 2_000_000
RESCORE_PAIRS = 10_000
# Queries whose candidates are merged at a time, and rows of a batch that a task gives back.
MERGED_QUERIES = 16_384
EMITTED = 50_000
# Blocks and splits that are shuffled hold this much at least: smaller ones save no memory beside a
# tile, and every vector is copied for each block.
LEAST_CELL = 4 * 1024 * 1024
# Order statistics of a batch's scores that bound the k-th score of a query with a large k.
SKETCH = 64

HITS = "query_id bigint, repo_id bigint, chunk_pos bigint, retrieval_score double"
PARTIAL_HITS = HITS + ", wanted bigint"
SKETCHES = "query_id bigint, repo_id bigint, score double, weight bigint"


def rank_hits(hits: DataFrame, k: int, name: str = "rank") -> DataFrame:
    """Rank by score, ties by position, and keep the first `k` of each query of a repository.

    The literal bound lets Spark keep only k rows per query before the shuffle.
    """
    order = Window.partitionBy("query_id", "repo_id").orderBy(
        F.desc("retrieval_score"), "chunk_pos"
    )
    return hits.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def top_k(
    vectors: DataFrame, queries: DataFrame, minimum: int = 1, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    return top_k_bounded(vectors, queries, minimum, pass_bytes)[0]


def top_k_bounded(
    vectors: DataFrame, queries: DataFrame, minimum: int = 1, pass_bytes: int = PASS_BYTES
) -> tuple[DataFrame, int]:
    """The best greatest(k, minimum) vectors of each query's repository, ranked.

    `vectors` (repo_id, chunk_pos, embedding) is read once. A task keeps k rows per query and only
    those go on; the vectors themselves are shuffled only where the queries fill several blocks.
    The queries are written once, so that a model sees each of them once.
    `queries` has (query_id, repo_id, embedding, k); a NULL k means DEFAULT_K.
    A query is known by (query_id, repo_id), so one id may ask several repositories. Vectors of
    another dimension or with values that are not finite fail the job, for any k.
    Also gives an upper bound of the number of hits.
    """
    asked = F.coalesce(F.col("k").cast("bigint"), F.lit(DEFAULT_K))
    wanted = queries.where(F.col("repo_id").isNotNull()).select(
        F.col("query_id").cast("bigint"),
        F.col("repo_id").cast("bigint"),
        V.as_float(F.col("embedding")).alias("embedding"),
        asked.alias("asked"),
        F.greatest(asked, F.lit(minimum)).alias("wanted"),
    )
    wanted = cut_lineage(wanted)
    stats = wanted.agg(
        F.count("*").alias("n"),
        F.max("wanted").alias("k"),
        F.min("asked").alias("asked"),
        F.max(F.size("embedding")).alias("dim"),
    ).first()
    if not stats.n:
        empty = vectors.sparkSession.createDataFrame([], HITS)
        return empty.withColumn("rank", F.lit(0)), 0
    if stats.asked < 1:
        raise ValueError("k must be at least 1")
    wanted = wanted.drop("asked")
    most = pass_bytes // 24
    if stats.k <= most:
        return _short_lists(vectors, wanted, stats, pass_bytes), stats.n * stats.k
    # A k whose rows alone fill a pass asks for a sorted table, not for a short list.
    wide = _long_lists(vectors, wanted.where(F.col("wanted") > most), stats.dim, pass_bytes)
    narrow = wanted.where(F.col("wanted") <= most)
    return top_k(vectors, _as_queries(narrow), 1, pass_bytes).unionByName(wide), stats.n * stats.k


def _as_queries(wanted: DataFrame) -> DataFrame:
    return wanted.withColumnRenamed("wanted", "k")


def _short_lists(vectors: DataFrame, wanted: DataFrame, stats, pass_bytes: int) -> DataFrame:
    held = 24 * stats.k + 4 * max(stats.dim, 0)
    hits = _over_vectors(
        vectors, wanted, stats.n, stats.dim, held, pass_bytes, _best_in_partition, PARTIAL_HITS
    )
    ranked = rank_hits(hits, stats.k)
    return ranked.where(F.col("rank") <= F.col("wanted")).drop("wanted")


def _long_lists(vectors: DataFrame, wanted: DataFrame, dim: int, pass_bytes: int) -> DataFrame:
    """Hits of queries whose k is large, by selection: a bound of each k-th score first, then only the
    rows that reach it.

    Of the k best scores of a query in every batch, `SKETCH` evenly spaced order statistics stand for as
    many rows each. In descending order, the one at which they stand for k rows is a score that k rows
    reach at least; no more than k and one batch's share per batch do. Ranks are those of range
    partitions, so no list of hits meets in one task.
    """
    n = wanted.count()
    held = 4 * max(dim, 1) + 8 * SKETCH

    def scan(asked: DataFrame, work, schema: str) -> DataFrame:
        return _over_vectors(vectors, asked, n, dim, held, pass_bytes, work, schema)

    sketch = cut_lineage(scan(wanted, _sketch_partition, SKETCHES))
    query = ["query_id", "repo_id"]
    below = running_offset(sketch, query, [-F.col("score")], F.col("weight"), name="before")
    limits = wanted.select(*query, "wanted")
    reached = below.join(limits, query).where(F.col("before") + F.col("weight") >= F.col("wanted"))
    floors = reached.groupBy(*query).agg(F.max("score").alias("floor"))
    # Fewer rows than k: all of them are hits.
    floor = F.coalesce("floor", F.lit(float("-inf")))
    bounded = wanted.join(floors, query, "left").select(*wanted.columns, floor.alias("floor"))
    found = scan(cut_lineage(bounded), _above_partition, HITS)
    order = [-F.col("retrieval_score"), F.col("chunk_pos")]
    # The limits are narrow, the hits many: up to the size of a block they come to the hits.
    sent = F.broadcast(limits) if 24 * n <= PASS_BYTES else limits
    placed = dense_positions(found, query, order, name="place").join(sent, query)
    return placed.where(F.col("place") < F.col("wanted")).select(
        *found.columns, (F.col("place") + 1).cast("int").alias("rank")
    )


def _over_vectors(
    vectors: DataFrame, wanted: DataFrame, n: int, dim: int, held: int, pass_bytes: int, work, schema: str
) -> DataFrame:
    """`work` on all vectors with the queries of their repository: (batches of vectors, query ids,
    repositories, the columns `wanted` and `floor`, query vectors) to batches.

    A query takes `held` bytes of a task. `floor` may be missing, and vectors may have a `part`.
    """
    if "floor" not in wanted.columns:
        wanted = wanted.withColumn("floor", F.lit(float("-inf")))
    if n <= max(1, pass_bytes // held):
        return _one_block(vectors, wanted, work, schema)
    return _in_blocks(vectors, wanted, dim, held, pass_bytes, work, schema)


def _stored(vectors: DataFrame) -> DataFrame:
    return vectors.select(
        F.col("repo_id").cast("bigint"),
        F.col("chunk_pos").cast("bigint"),
        V.as_float(F.col("embedding")).alias("embedding"),
        *[c for c in vectors.columns if c == "part"],
    )


def _in_blocks(
    vectors: DataFrame, wanted: DataFrame, dim: int, held: int, pass_bytes: int, work, schema: str
) -> DataFrame:
    """The work of each block of queries in each split of its repository's vectors.

    A repository's queries are dealt over blocks, its vectors over splits, of about `pass_bytes` or
    `LEAST_CELL`; each split meets each block in a group of its own. So neither a repository that
    most queries ask nor one that holds most vectors fills a task, and no query passes the driver.
    """
    cell_bytes = max(pass_bytes, LEAST_CELL)
    rows, most = max(1, cell_bytes // held), max(1, cell_bytes // (4 * max(dim, 1)))
    asked = wanted.groupBy("repo_id").agg(F.ceil(F.count("*") / rows).alias("blocks"))
    stored = vectors.groupBy(F.col("repo_id").cast("bigint").alias("repo_id")).agg(
        F.ceil(F.count("*") / most).alias("splits")
    )
    plan = cut_lineage(asked.join(stored, "repo_id"))

    def each(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    cell = ["repo_id", "block", "split"]
    left = (
        _stored(vectors)
        .join(plan, "repo_id")
        .withColumn("split", F.pmod(F.xxhash64("chunk_pos"), "splits"))
        .withColumn("block", each("blocks"))
        .drop("blocks", "splits")
    )
    right = (
        wanted.join(plan, "repo_id")
        .withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks"))
        .withColumn("split", each("splits"))
        .select(*cell, "query_id", "wanted", "floor", "embedding")
    )
    # Both sides as rows of one table, so that a group's results are handed on batch by batch.
    both = left.unionByName(right.withColumn("asks", F.lit(True)), allowMissingColumns=True)

    def each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored, asked = [], []
        for batch in batches:
            asks = batch["asks"].is_valid()
            asked.append(batch.filter(asks))
            stored.append(batch.filter(pc.invert(asks)))
        queries = pa.Table.from_batches(asked)
        if queries.num_rows and any(b.num_rows for b in stored):
            yield from work(
                stored,
                queries["query_id"].to_numpy(),
                queries["repo_id"].to_numpy(),
                queries["wanted"].to_numpy(),
                queries["floor"].to_numpy(),
                _matrix(queries["embedding"], dim),
            )

    return both.groupBy(*cell).applyInArrow(each_cell, schema)


def top_k_single(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """One query vector: a scan with a score column, then a bounded top-k per partition."""
    if k < 1:
        raise ValueError("k must be at least 1")
    literal = F.array(*[F.lit(float(x)) for x in query])
    guarded = V.checked_dim(F.col("embedding"), len(query))
    return (
        vectors.withColumn("retrieval_score", V.inner_product(guarded, literal))
        .orderBy(F.desc("retrieval_score"), "chunk_pos")
        .limit(k)
    )


def _one_block(vectors: DataFrame, block: DataFrame, work, schema: str) -> DataFrame:
    """The work of so few queries that every task can hold them all; nothing is shuffled."""
    spark = vectors.sparkSession
    table = block.toArrow()
    matrix = _matrix(table.column("embedding"), None)
    repos = table.column("repo_id").to_numpy()
    order = np.argsort(repos, kind="stable")
    repos = repos[order]
    plan = spark.sparkContext.broadcast(
        (
            table.column("query_id").to_numpy()[order],
            repos,
            table.column("wanted").to_numpy()[order],
            table.column("floor").to_numpy()[order],
            matrix[order],
        )
    )
    asked = [int(r) for r in np.unique(repos)]
    # Few repositories: a literal filter that prunes partitions and row groups.
    read = vectors
    if len(asked) <= 1000:
        read = read.where(F.col("repo_id").isin(asked))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches, *plan.value)

    return _stored(read).mapInArrow(whole, schema)


def _matrix(column, dim: int | None) -> np.ndarray:
    """A list column as a (rows, dim) array; every row must have the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("embedding is NULL")
    lengths = np.diff(column.offsets.to_numpy())
    expected = dim if dim is not None else (int(lengths[0]) if len(lengths) else 0)
    if (lengths != expected).any():
        found = int(lengths[lengths != expected][0])
        raise ValueError(f"vector dimension mismatch: expected {expected}, got {found}")
    matrix = np.asarray(column.flatten(), dtype=np.float32).reshape(len(column), expected)
    if not np.isfinite(matrix).all():
        raise ValueError("embedding has a value that is not finite")
    return matrix


def _slack(queries) -> np.ndarray:
    """Bound on the difference between the float32 product and the exact score of a unit vector."""
    length = np.sqrt(np.einsum("ij,ij->i", queries, queries, dtype=np.float64))
    return 2 * (queries.shape[1] + 2) * np.finfo(np.float32).eps * length


def _by_repo(batches, query_repos, dim):
    """Per batch and repository that is asked: the range of its queries, which come in the order of their
    repositories, the rows and the vectors of the batch, and the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        repo = batch.column("repo_id").to_numpy(zero_copy_only=False)
        vectors = _matrix(batch.column("embedding"), dim)
        order = np.argsort(repo, kind="stable")
        found, starts = np.unique(repo[order], return_index=True)
        lows, highs = np.searchsorted(query_repos, found), np.searchsorted(query_repos, found, "right")
        for lo, hi, rows in zip(lows.tolist(), highs.tolist(), np.split(order, starts[1:])):
            if lo < hi:
                yield lo, hi, rows, vectors, batch


def _tiles(batches, query_repos, queries):
    """Per tile of a batch's vectors of one repository and some of its queries: the range of the queries,
    the vectors' positions and rows, their float32 scores, and how far the exact scores may be from
    these. A tile has all vectors of the batch."""
    slack = _slack(queries)
    for lo, hi, rows, vectors, batch in _by_repo(batches, query_repos, queries.shape[1]):
        pos = batch.column("chunk_pos").to_numpy(zero_copy_only=False)[rows]
        own = vectors[rows]
        size = max(float(np.linalg.norm(own, axis=1).max(initial=0.0)), 1e-30)
        step = max(1, TILE_CELLS // len(rows))
        for low in range(lo, hi, step):
            high = min(low + step, hi)
            yield low, high, pos, own, own @ queries[low:high].T, slack[low:high] * size


def _together(batches) -> list[pa.RecordBatch]:
    """Batches as one, where they are held anyway."""
    if not isinstance(batches, list):
        return batches
    return pa.Table.from_batches(batches).combine_chunks().to_batches()


def _sketch_partition(batches, query_ids, query_repos, wanted, _, queries) -> Iterator[pa.RecordBatch]:
    """Scores that so many rows of a tile reach at least, evenly spaced over its k best rows."""
    for lo, hi, _, _, scores, margin in _tiles(_together(batches), query_repos, queries):
        n = min(len(scores), int(wanted[lo:hi].max()))
        step = -(-n // SKETCH)
        ends = np.append(np.arange(step, n, step), n)  # in descending order, counted from 1
        lowest = np.partition(-scores, ends - 1, axis=0)[ends - 1]
        yield pa.RecordBatch.from_pydict(
            {
                "query_id": np.tile(query_ids[lo:hi], len(ends)),
                "repo_id": np.tile(query_repos[lo:hi], len(ends)),
                "score": (-lowest.astype(np.float64) - margin).ravel(),
                "weight": np.repeat(np.diff(ends, prepend=0), hi - lo),
            }
        )


def _above_partition(batches, query_ids, query_repos, _, floors, queries) -> Iterator[pa.RecordBatch]:
    """Every pair whose exact score reaches the query's floor."""
    for lo, hi, pos, vectors, scores, margin in _tiles(_together(batches), query_repos, queries):
        near = scores >= floors[lo:hi] - margin
        # Some queries at a time, by the rows they give.
        share = np.cumsum(near.sum(axis=0)) // EMITTED
        for some in np.split(np.arange(hi - lo), np.flatnonzero(np.diff(share)) + 1):
            v, q = np.nonzero(near[:, some])
            q = some[q] + lo
            score = _exact_scores(vectors, v, queries, q)
            keep = score >= floors[q]
            v, q, score = v[keep], q[keep], score[keep]
            yield pa.RecordBatch.from_pydict(
                {"query_id": query_ids[q], "repo_id": query_repos[q], "chunk_pos": pos[v], "retrieval_score": score}
            )


class _Lists:
    """The best rows so far of each query, by ranges of queries that are merged on their own."""

    def __init__(self, ks, floors):
        self.ks = ks
        self.floor = np.array(floors, dtype=np.float64)
        self.kept: dict[int, tuple] = {}
        self.pending: list[tuple] = []
        self.waiting = 0

    def add(self, low: int, q, pos, score) -> None:
        """Candidates of the range of queries that begins at `low`."""
        self.pending.append((q, pos, score))
        self.waiting += len(q)
        # Merging when as much has come in as is kept spreads its cost.
        if self.waiting >= len(self.kept[low][0] if low in self.kept else ()):
            self.merge(low)

    def merge(self, low: int) -> None:
        """To be called before another range gets candidates."""
        if not self.pending:
            return
        held = [self.kept[low]] if low in self.kept else []
        q, p, s = (np.concatenate(parts) for parts in zip(*held, *self.pending))
        ranked = np.lexsort((p, -s, q))
        q, p, s = q[ranked], p[ranked], s[ranked]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.ks[q] - 1
        self.floor[q[last]] = s[last]
        keep = place < self.ks[q]
        self.kept[low] = q[keep], p[keep], s[keep]
        self.pending, self.waiting = [], 0


def _best_in_partition(
    batches, query_ids, query_repos, ks, floors, queries, bounds=None
) -> Iterator[pa.RecordBatch]:
    """The best k rows of each query among all batches; none below its floor is needed.

    Vectors may be in parts: `bounds` gives the scores that no vector of a part exceeds against some
    queries, and only queries whose floor is not above them look at the part.
    """
    slack, lists = _slack(queries), _Lists(ks, floors)
    for lo, hi, rows, vectors, batch in _by_repo(batches, query_repos, queries.shape[1]):
        pos = batch.column("chunk_pos").to_numpy(zero_copy_only=False)
        groups = [(None, rows)]
        if bounds:
            part = batch.column("part").to_numpy()[rows]
            order = np.argsort(part, kind="stable")
            numbers, starts = np.unique(part[order], return_index=True)
            groups = list(zip(numbers.tolist(), np.split(rows[order], starts[1:])))
        for low in range(lo, hi, MERGED_QUERIES):
            high = min(low + MERGED_QUERIES, hi)
            for number, members in groups:
                some = slice(low, high)
                if bounds:
                    reached = bounds(number, queries[low:high]) >= lists.floor[low:high]
                    if not reached.any():
                        continue
                    if not reached.all():
                        some = low + np.flatnonzero(reached)
                asked, names = queries[some], np.arange(len(queries))[some]
                step = max(1, TILE_CELLS // len(names))
                for start in range(0, len(members), step):
                    tile = members[start : start + step]
                    q, v = _candidates(vectors[tile], asked, ks[some], lists.floor[some], slack[some])
                    if len(q):
                        q, v = names[q], tile[v]
                        lists.add(low, q, pos[v], _exact_scores(vectors, v, queries, q))
            lists.merge(low)
    ready: list[tuple] = []
    for low in list(lists.kept):
        ready.append(lists.kept.pop(low))
        if not lists.kept or sum(len(r[0]) for r in ready) >= EMITTED:
            q, p, s = (np.concatenate(parts) for parts in zip(*ready))
            ready = []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(query_ids[q], pa.int64()),
                    pa.array(query_repos[q], pa.int64()),
                    pa.array(p, pa.int64()),
                    pa.array(s, pa.float64()),
                    pa.array(ks[q], pa.int64()),
                ],
                names=["query_id", "repo_id", "chunk_pos", "retrieval_score", "wanted"],
            )


def _candidates(vectors, queries, ks, floor, slack):
    """(query, vector) index pairs that can still be among the best k of the tile."""
    scores = vectors @ queries.T
    size = np.linalg.norm(vectors, axis=1).max(initial=0.0)
    margin = slack * max(float(size), 1e-30)
    limit = floor - margin
    n = len(vectors)
    for k in np.unique(ks):
        if k < n:
            same = np.flatnonzero(ks == k)
            kth = np.partition(scores[:, same], n - k, axis=0)[n - k]
            limit[same] = np.maximum(limit[same], kth - margin[same])
    v, q = np.nonzero(scores >= limit)
    return q, v


def _exact_scores(vectors, v, queries, q) -> np.ndarray:
    """Double-precision inner products, summed in array order as the column form does."""
    out = np.empty(len(q))
    for start in range(0, len(q), RESCORE_PAIRS):
        part = slice(start, start + RESCORE_PAIRS)
        products = vectors[v[part]].astype(np.float64)
        products *= queries[q[part]]
        out[part] = np.cumsum(products, axis=1)[:, -1]
    return out
