"""Importance resampling towards a target distribution, over hashed words and word pairs.

Method. Texts are taken in blocks. The distinct words of a block, each between two blanks, are the
dictionary of an Aho-Corasick automaton; a word's payload points to its CRC and its length in bytes. One scan
of the block emits the payloads of all words in order. The bucket of a word follows from its CRC, and
that of a pair from the payloads of two words in a row: the CRC of a concatenation is the first part's
CRC, moved on by the length of the second, exclusive-or the second's. So no pair is ever built as text.

The table is scanned once; the buckets of every document, two bytes for each feature, are written to the
shared folder. Counting them, and scoring each document against the gain of every bucket, read that
file. Between the two only a table of `BUCKETS` rows passes the driver.
"""

import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesearch.llm.common import discard, write_out
from lakesearch.operators.positions import dense_positions

BUCKETS = 10_000
LEAST_WORDS = 20
#: Share of the documents with enough words that are drawn, in percent.
SHARE = 25
SEED = 7
#: Bytes of text that are scanned together: small automata stay in the processor's caches.
TOGETHER = 1_000_000
_POLYNOMIAL = 0xEDB88320
#: ASCII letters and digits and every byte of other characters make words; A-Z are lower-cased.
_FOLDED = bytes(
    b | 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256)
)
#: Stands between texts; folding leaves no control character in a text.
_BREAK = b"\x01"


# CRCs


def _zero_byte() -> np.ndarray:
    """What one more zero byte makes of every value of a CRC's lowest byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


@lru_cache(maxsize=1)
def _doublings() -> list[np.ndarray]:
    """For each k, four tables (one per byte of a CRC) that move it on by 2**k bytes."""
    values = np.arange(256, dtype=np.uint32)
    one = np.stack([values << np.uint32(8 * b) for b in range(4)])
    low = _zero_byte()
    moves = [low[one & 255] ^ (one >> np.uint32(8))]
    for _ in range(31):
        moves.append(_moved(moves[-1], moves[-1]))
    return moves


def _moved(crcs: np.ndarray, tables: np.ndarray) -> np.ndarray:
    out = tables[0][crcs & 255]
    for b in range(1, 4):
        out = out ^ tables[b][(crcs >> np.uint32(8 * b)) & 255]
    return out


def concatenated(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of concatenations, from those of both parts and the second part's length in bytes."""
    moved = first.copy()
    left, k = lengths.astype(np.int64), 0
    while left.any():
        odd = np.flatnonzero(left & 1)
        moved[odd] = _moved(moved[odd], _doublings()[k])
        left, k = left >> 1, k + 1
    return moved ^ second


# Scans


def _blocks(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append((text or b"").translate(_FOLDED))
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every word and every pair of words in a row of folded texts."""
    whole = b" " + (b" " + _BREAK + b" ").join(texts) + b" "
    words = [_BREAK, *(set(whole.split()) - {_BREAK})]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for payload, word in enumerate(words):
        automaton.add_word(f" {word.decode('latin-1')} ", payload)
    automaton.make_automaton()
    scan = automaton.iter(whole.decode("latin-1"))
    found = np.fromiter((payload for _, payload in scan), np.int64)
    crcs = np.array([zlib.crc32(w) for w in words], np.uint32)
    spaced = np.array([zlib.crc32(w + b" ") for w in words], np.uint32)
    lengths = np.array([len(w) for w in words], np.int64)
    is_word = found > 0
    text = np.cumsum(~is_word)
    pair = np.flatnonzero(is_word[:-1] & is_word[1:])
    a, b = found[pair], found[pair + 1]
    pairs = concatenated(spaced[a], crcs[b], lengths[b])
    at = np.concatenate([text[is_word], text[pair]])
    return at, np.concatenate([crcs[found[is_word]], pairs]) % np.uint32(buckets)


def _dtype(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def bucketed(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of `texts` (id, text) with the buckets of their features, as little-endian numbers,
    instead of the text."""
    dtype = _dtype(buckets)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for block in _blocks(batch["text"].cast(pa.binary()).to_pylist()):
                at, found = features(block, buckets)
                order = np.argsort(at, kind="stable")
                ends = np.cumsum(np.bincount(at, minlength=len(block))) * dtype.itemsize
                packed = found[order].astype(dtype).tobytes()
                offsets = np.concatenate([[0], ends]).astype(np.int64)
                lists = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(block), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]
                )
                ids = batch["id"].slice(done, len(block))
                yield pa.RecordBatch.from_arrays([ids, lists.cast(pa.binary())], names=["id", "buckets"])
                done += len(block)

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(scan, f"id {kind}, buckets binary")


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of the `scanned` rows fall into each bucket that has any."""
    dtype = _dtype(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for one in batch["buckets"]:
                total += np.bincount(np.frombuffer(one.as_buffer(), dtype), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used), "n": pa.array(total[used])})

    counted = scanned.select("buckets").mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(scanned: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandfold log ratio of each bucket's smoothed share in the target and in the documents, both
    as `bucketed` rows."""
    spark = scanned.sparkSession
    both = (
        spark.range(buckets)
        .withColumnRenamed("id", "bucket")
        .join(bucket_counts(scanned, buckets).withColumnRenamed("n", "s"), "bucket", "left")
        .join(bucket_counts(target, buckets).withColumnRenamed("n", "t"), "bucket", "left")
        .fillna(0, ["s", "t"])
    )
    counts = both.toPandas()  # `buckets` rows
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    all_s, all_t = float(counts["s"].sum()) + buckets, float(counts["t"].sum()) + buckets
    ratio = (t + 1) * F.lit(all_s) / ((s + 1) * F.lit(all_t))
    scored = spark.createDataFrame(counts).select(
        "bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")
    )
    return scored.toPandas().sort_values("bucket")["gain"].to_numpy(np.int64)


def weights(scanned: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_features, weight: the floored mean gain of a document's features, 0 without any."""
    dtype = _dtype(len(gain))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, means = [], []
            for one in batch["buckets"]:
                found = np.frombuffer(one.as_buffer(), dtype)
                counts.append(len(found))
                means.append(int(gain[found].sum()) // max(1, len(found)))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(counts, pa.int64()), pa.array(means, pa.int64())],
                names=["id", "n_features", "weight"],
            )

    kind = scanned.schema["id"].dataType.simpleString()
    return scanned.mapInArrow(weigh, f"id {kind}, n_features long, weight long")


# The draw


def resample(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = BUCKETS,
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_features, weight, score, rank.

    score is the weight plus Gumbel noise from a hash of the id, so the highest scores are a draw without
    replacement in proportion to exp(weight / 1000). `share` percent of the documents with
    `least_words` words get a rank, 1 for the highest; ties go to the smaller id, a null id before all
    others (its noise is that of the empty text). A null or empty text has no features and weight 0.
    Repeated rows are drawn one by one. `target` has a column text; an empty one, like empty `docs`, counts
    nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    scanned, path = write_out(bucketed(docs.select(F.col("doc_id").alias("id"), "text"), buckets), "buckets")
    try:
        aimed = bucketed(target.select(F.lit(0).alias("id"), "text"), buckets)
        weighed = weights(scanned, gains(scanned, aimed, buckets)).withColumnRenamed("id", "doc_id")
        named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
        noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
        scored, _ = write_out(weighed.withColumn("score", F.col("weight") + noise), "importance")
    finally:
        discard(spark, path)
    # n words have n - 1 pairs.
    enough = F.col("n_features") >= 2 * least_words - 1
    drawn = scored.where(enough).count() * share // 100
    order = [
        F.when(enough, 0).otherwise(1),
        -F.col("score"),
        F.col("doc_id"),
        F.xxhash64(F.monotonically_increasing_id()),  # deals rows given many times
    ]
    placed = dense_positions(scored, [], order, "place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
