"""Substring deduplication: repeated windows of words, found by super-k-mer partitioning.

Method. A window is `WINDOW` consecutive words; its minimiser is the smallest hash of its runs of
`SEED_WORDS` words. Consecutive windows that share a minimiser (the leftmost place of it) are one
super-k-mer and travel as one packed string of words to the minimiser's bucket. Equal windows have equal
minimisers, so each bucket counts its windows exactly, on the words themselves.

1. Every document gives its super-k-mers as narrow rows (row key, start, windows, minimiser).
   A minimiser that only one super-k-mer has cannot hold a repeated window, so it ends here.
2. The others are cut out of their texts as packed strings. Equal strings are combined before the
   shuffle, so copies of a passage, however many, arrive once with a count; all windows of a string
   that occurs twice are repeated.
3. The windows of each bucket are sorted and counted. A bucket with more than `SPLIT` different
   strings is dealt out window by window instead, so it never meets in one task.
4. The repeated windows go back to their row, which drops the words that they cover.

Hot keys. A minimiser, a window or a string that holds more than one in `HOT` of a table's rows is known
from the counts before a join; there are fewer than `HOT` such keys, which are sent to all tasks, and
their rows are joined where they are. Only the others are shuffled.

A row is known by two 64-bit hashes of (id, text): repeated rows then share a key, and as their contents
are equal, so are their windows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesearch.llm.common import discard, write_out
from lakesearch.session import cut_lineage

WINDOW = 35
SEED_WORDS = 5
SPLIT = 5_000
HOT = 1_000
#: Bytes of words, with their hashes, that a task keeps.
KEPT_BYTES = 40 << 20
_ENTRY = 150  # bytes of a dictionary entry and its objects, about
_KEY = ["k1", "k2"]


class _WordHashes(dict):
    held = 0

    def __missing__(self, word: bytes) -> int:
        if self.held > KEPT_BYTES:
            self.clear()
            self.held = 0
        self.held += len(word) + _ENTRY
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def split_words(text: str | None) -> list[bytes]:
    """Words of a text, as UTF-8: what stands between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def super_kmers(
    words: list[bytes], hashes: dict, window: int = WINDOW
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, and minimiser of each super-k-mer of a text."""
    n = len(words) - window + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none
    h = np.array([hashes[w] for w in words], np.uint64)
    mixed = h[: len(h) - SEED_WORDS + 1].copy()
    for k in range(1, SEED_WORDS):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed += h[k : len(h) - SEED_WORDS + 1 + k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    # Minimum over `reach` neighbours, by doubling.
    reach, have = window - SEED_WORDS + 1, 1
    low = mixed
    while have < reach:
        step = min(have, reach - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    # A window that starts with its minimum hands over to the next place of it. Windows of one
    # super-k-mer thus hold the same place of the minimiser, and none equals another.
    new = np.flatnonzero((low[1:] != low[:-1]) | (mixed[: n - 1] == low[:-1])) + 1
    starts = np.concatenate(([0], new))
    ends = np.append(starts[1:], n)
    return starts, ends - starts, low[starts].view(np.int64)


def _keys(docs: DataFrame) -> tuple[Column, Column]:
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64("doc_id", text), F.xxhash64(text, "doc_id", F.lit(1))


def _keyed(docs: DataFrame) -> DataFrame:
    k1, k2 = _keys(docs)
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), k1.alias("k1"), k2.alias("k2"))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = _WordHashes()
    for batch in batches:
        out, held = [], 0
        for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"]):
            starts, counts, values = super_kmers(split_words(text), hashes)
            if len(starts):
                out.append((np.full(len(starts), k1), np.full(len(starts), k2), starts, counts, values))
                held += len(starts)
            if held > 200_000:
                yield _columns(out)
                out, held = [], 0
        if out:
            yield _columns(out)


def _columns(parts: list[tuple]) -> pd.DataFrame:
    k1, k2, starts, counts, values = (np.concatenate(x) for x in zip(*parts))
    return pd.DataFrame({"k1": k1, "k2": k2, "start": starts.astype(np.int32), "n": counts.astype(np.int32), "v": values})


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out, held = [], 0
        for k1, k2, text, runs in zip(batch["k1"], batch["k2"], batch["text"], batch["runs"]):
            words = split_words(text)
            for run in runs:
                start, n = run["start"], run["n"]
                packed = b" ".join(words[start : start + n + WINDOW - 1])
                out.append((k1, k2, start, n, run["v"], hashlib.md5(packed).digest(), packed))
                held += len(packed)
            if held > 4_000_000:
                yield pd.DataFrame(out, columns=_PACKED)
                out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=_PACKED)


_PACKED = ["k1", "k2", "start", "n", "v", "digest", "packed"]


def window_strings(packed: bytes) -> list[bytes]:
    """The windows of a packed string, as byte strings."""
    blanks = [-1, *(i for i, c in enumerate(packed) if c == 32), len(packed)]
    return [packed[a + 1 : b] for a, b in zip(blanks, blanks[WINDOW:])]


def _count_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeated windows of each string, for buckets that come sorted by minimiser."""
    bucket: list[tuple] = []
    value = None
    for batch in batches:
        out: list[tuple] = []
        for v, digest, packed, copies in zip(
            batch["v"], batch["digest"], batch["packed"], batch["copies"]
        ):
            if v != value:
                out.extend(_repeated(value, bucket))
                value, bucket = v, []
            bucket.append((digest, packed, copies))
        yield pd.DataFrame(out, columns=["v", "digest", "windows"])
    yield pd.DataFrame(_repeated(value, bucket), columns=["v", "digest", "windows"])


def _repeated(value, bucket: list[tuple]) -> list[tuple]:
    if len(bucket) == 1:
        digest, packed, copies = bucket[0]
        if copies < 2:
            return []
        return [(value, digest, list(range(packed.count(b" ") + 2 - WINDOW)))]
    rows = sorted(
        (w, k, i) for k, (_, packed, _) in enumerate(bucket) for i, w in enumerate(window_strings(packed))
    )
    found: dict[int, list[int]] = {}
    at = 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and rows[end][0] == rows[at][0]:
            end += 1
        if end - at > 1 or bucket[rows[at][1]][2] > 1:
            for _, k, i in rows[at:end]:
                found.setdefault(k, []).append(i)
        at = end
    return [(value, bucket[k][0], sorted(windows)) for k, windows in found.items()]


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for v, digest, packed, copies in zip(
            batch["v"], batch["digest"], batch["packed"], batch["copies"]
        ):
            found = window_strings(packed)
            yield pd.DataFrame(
                {"v": v, "digest": [digest] * len(found), "i": range(len(found)), "w": found, "copies": copies}
            )


def _kept_words(words: list[bytes], spans) -> list[bytes]:
    """The words that no repeated window covers."""
    edge = np.zeros(len(words) + 1, np.int64)
    for span in spans:
        at = span["start"] + np.asarray(span["windows"])
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out, held = [], 0
        for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"]):
            words = split_words(text)
            kept = words if spans is None else _kept_words(words, spans)
            joined = b" ".join(kept).decode("utf-8", "surrogatepass")
            out.append((doc_id, len(words), len(words) - len(kept), joined))
            held += len(text)
            if held > 4_000_000:
                yield _kept_frame(out)
                out, held = [], 0
        if out:
            yield _kept_frame(out)


def _kept_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_KEPT)
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


_KEPT = ["doc_id", "n_words", "n_removed", "kept_text"]


def hot_keys(counts: DataFrame, n: str, total: int) -> DataFrame:
    """The rows of `counts` whose `n` is more than one in `HOT` of `total`, the sum of all `n`: fewer
    than `HOT` rows, which can be sent to every task."""
    return F.broadcast(counts.where(F.col(n) > F.lit(total // HOT)))


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """The inner join of `rows` with `keys`, one row per key; rows of the keys in `hot` are not shuffled.
    `rows` and `keys` are read twice."""
    named = hot.select(*on)
    met = rows.join(F.broadcast(keys.join(named, on, "left_semi")), on)
    return met.unionByName(rows.join(named, on, "left_anti").join(keys.join(named, on, "left_anti"), on))


def repeated_spans(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """(k1, k2, spans) of the rows that have repeated windows; a span is (start, windows)."""
    spark: SparkSession = docs.sparkSession
    kept: dict[str, str] = {}

    def step(rows: DataFrame, name: str, *done: str) -> DataFrame:
        written, kept[name] = write_out(rows, name)
        discard(spark, *[kept.pop(d) for d in done])
        return written

    try:
        runs = step(
            _keyed(docs)
            .select("k1", "k2", "text")
            .mapInPandas(_runs, "k1 long, k2 long, start int, n int, v long"),
            "runs",
        )
        shared = step(runs.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "shared")
        found = join_counted(runs, shared.select("v"), ["v"], hot_keys(shared, "c", runs.count()))
        wanted = step(
            found.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "n", "v")).alias("runs")),
            "wanted",
            "runs",
            "shared",
        )
        texts = _keyed(docs).select("k1", "k2", "text")
        strings = step(
            texts.join(wanted, _KEY).mapInPandas(
                _packed,
                "k1 long, k2 long, start int, n int, v long, digest binary, packed binary",
            ),
            "strings",
            "wanted",
        )
        distinct = step(
            strings.groupBy("v", "digest", "packed").agg(F.count("*").alias("copies")), "distinct"
        )
        sizes = distinct.groupBy("v").agg(F.count("*").alias("c"))
        large = sizes.where(F.col("c") > split)
        usual = (
            distinct.join(large, "v", "left_anti")
            .repartition("v")
            .sortWithinPartitions("v")
            .mapInPandas(_count_buckets, "v long, digest binary, windows array<int>")
        )
        held = distinct.count()
        dealt = step(
            join_counted(distinct, large.select("v"), ["v"], hot_keys(large, "c", held)).mapInPandas(
                _windows, "v long, digest binary, i int, w binary, copies long"
            ),
            "dealt",
        )
        often = step(
            dealt.groupBy("v", "w")
            .agg(F.sum("copies").alias("c"), F.count("*").alias("n"))
            .where("c > 1"),
            "often",
        )
        split_up = (
            join_counted(dealt, often.select("v", "w"), ["v", "w"], hot_keys(often, "n", dealt.count()))
            .groupBy("v", "digest")
            .agg(F.collect_set("i").alias("windows"))
        )
        repeated = step(usual.unionByName(split_up), "repeated", "dealt", "often")
        copied = hot_keys(distinct.select("v", "digest", "copies"), "copies", strings.count())
        places = strings.select("k1", "k2", "start", "v", "digest")
        return cut_lineage(
            join_counted(places, repeated, ["v", "digest"], copied)
            .groupBy(*_KEY)
            .agg(F.collect_set(F.struct("start", "windows")).alias("spans"))
        )
    finally:
        discard(spark, *kept.values())


def drop_repeats(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_removed, kept_text.

    Every word that is covered by a window whose words also start anywhere else is removed, in the
    first place of a passage too; windows are judged on the input. kept_text has the other words,
    joined by one blank. Null and empty texts have no words; a text of fewer than 35 words has no
    window; a repeated row repeats all its windows. An empty table gives an empty result.
    """
    return (
        _keyed(docs)
        .join(repeated_spans(docs, split), _KEY, "left")
        .select("doc_id", "text", "spans")
        .mapInPandas(_kept, "doc_id long, n_words long, n_removed long, kept_text string")
    )


def cut_repeats(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """The rows of `docs` with the repeated passages cut out of their texts.

    A text that loses nothing stays as it is, white space and null included; of another the kept
    words stay, joined by one blank, and n_chars, where there is such a column, follows. A text that
    loses all its words becomes empty; its row stays.
    """
    spans = repeated_spans(docs, split)
    columns, k1, k2 = docs.columns, *(c for c in _keys(docs))
    keyed = docs.select("*", k1.alias("__k1"), k2.alias("__k2"))
    spans = spans.toDF("__k1", "__k2", "__spans")

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in batches:
            yield pd.Series(
                [
                    None if s is None else b" ".join(_kept_words(split_words(t), s)).decode()
                    for t, s in zip(texts, found)
                ],
                dtype="object",
            )

    joined = keyed.join(spans, ["__k1", "__k2"], "left").withColumn(
        "__cut", cut("text", "__spans")
    )
    text = F.coalesce("__cut", "text")
    changed = {"text": text}
    if "n_chars" in columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed["n_chars"] = F.when(
            F.col("__cut").isNotNull(), F.length("__cut").cast(kind)
        ).otherwise(F.col("n_chars"))
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in columns])
