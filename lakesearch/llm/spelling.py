"""Spelling variants: words at one edit from each other, found by pivotal grams.

Method. The bigrams of a word are ordered from rare to frequent over all words. One edit destroys at most
two bigrams, so the three rarest hold two that do not overlap; dynamic programming over their places
chooses such a pair of least total frequency, the word's pivots. An edit leaves one of two disjoint bigrams
whole. So of two near words, the one whose third rarest gram is the rarer (or either, if equal) has a
pivot among the other's gram prefix, the grams up to its own third rarest.

Position limits. The edit lies on one side of a pivot that it leaves whole. With the edit behind it, pivot
and letters before it stand unchanged at the same place; with the edit before it, pivot and letters after
it do, at the same place from the end. The rest of the word is cut into pieces of `PIECE` letters, longer ones
in very long words; the edit lies in one of them, and what is on both sides of that piece stands unchanged. A join key is a hash of the
pivot's side and place, the shorter word's length, the piece, and the unchanged letters. So groups of the
join are words that share all but a few letters, not all words of a gram. Candidates are verified by their
edit distance.
"""

import bisect
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesearch.llm.common import discard, write_out

#: The letters of words, as a class of a regular expression.
LETTERS = "A-Za-z\u00C0-\u00FF"
LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A near word is a word's form if it occurs so many times as often.
RATIO = 10
#: Of all pairs of a document and a run of letters, one in so many loses a letter.
NOISE = 31
#: One edit destroys two bigrams at most; one more than that.
PREFIX = 3
#: An edit makes two bigrams at most, which may come before a pivot that it leaves whole.
PROBED = PREFIX + 2
#: Letters of a piece in which an edit may lie, at least, and pieces of a side, at most: smaller pieces make
#: more keys and fewer candidates.
PIECE, PIECES = 2, 16
#: Different words that a task counts before it hands their counts on.
COUNTED = 400_000
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, noise: int = NOISE) -> DataFrame:
    """word, n: runs of letters in `docs` (doc_id, text), A-Z lower-cased, with the fixed noise applied."""
    runs = re.compile(f"[{LETTERS}]{{{least_letters},}}").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                start = zlib.crc32(f"{doc}:".encode())
                here = Counter(runs((text or "").translate(_LOWER)))
                for run, n in here.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % noise == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_letters:
                            continue
                    counts[run] += n
                if len(counts) >= COUNTED:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    counted = named.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    arrays = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["word", "n"])


# Grams


def bigram_rarity(words: DataFrame) -> dict[str, int]:
    """Places of every bigram in `words`, each word counted once. Pairs of letters: the alphabet, not the
    table, bounds their number."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at")
    grams = words.select("word", at).select(F.expr("substring(word, at, 2)").alias("gram"))
    counted = grams.groupBy("gram").agg(F.count("*").alias("n"))
    return {row["gram"]: row["n"] for row in counted.toLocalIterator()}


def ordered_grams(word: str, order: dict[str, int]) -> list[tuple[int, int]]:
    """(rank, place) of the word's `PROBED` rarest bigrams, rarest first."""
    ranks = [order[word[i : i + 2]] for i in range(len(word) - 1)]
    return sorted(zip(ranks, range(len(ranks))))[:PROBED]


def pivots(grams: list[tuple[int, int]], rarity: list[int]) -> list[tuple[int, int]]:
    """Two disjoint grams of least total rarity among the `PREFIX` rarest.

    By dynamic programming over places: single[i] is the best one of the first i grams; a pair that ends
    in gram i joins it to the best single among the grams that end before it begins.
    """
    placed = sorted(grams[:PREFIX], key=lambda g: g[1])
    places = [place for _, place in placed]
    single: list[tuple[int, int]] = [(0, -1)]
    best, pair = None, []
    for i, (rank, place) in enumerate(placed):
        before = bisect.bisect_right(places, place - 2)
        cost = rarity[rank]
        if before:
            total, partner = single[before]
            if best is None or total + cost < best:
                best, pair = total + cost, [placed[partner], (rank, place)]
        single.append((cost, i) if i == 0 or cost < single[i][0] else single[i])
    return pair


def side_keys(word: str, at: int, least_letters: int) -> list[int]:
    """Keys of the bigram at `at`, for the edit behind it and before it, in every piece of that side.

    Two near words whose edit spares the bigram have a key in common. Lengths differ by one at most,
    so the shorter one's is the word's own or one less; pieces are counted from the bigram, in it.
    """
    size = len(word)
    keys = []
    for side, same in (("<", at + 2), (">", size - at)):
        for shorter in range(max(least_letters, size - 1, same), size + 1):
            rest = shorter - same
            piece = max(PIECE, -(-rest // PIECES))
            for near in range(0, max(rest, 1), piece):
                far = max(0, rest - near - piece)
                if side == "<":
                    kept = f"{word[: same + near]},{word[size - far :]}"
                else:
                    kept = f"{word[:far]},{word[size - same - near :]}"
                keys.append(f"{side}{same},{shorter},{near},{kept}")
    return [xxhash.xxh64_intdigest(k) - (1 << 63) for k in keys]


def keyed(words: DataFrame, rarity: dict[str, int], of_pivots: bool, least_letters: int) -> DataFrame:
    """key, word, n, last: one row per key of the word's pivots, or of its prefix; last is the rank of
    its third rarest gram.

    The prefix has the grams not less rare than that, but no more than the first `PROBED` by rarity
    and place: at most two grams come before a pivot in its own word, and an edit adds two.
    """
    ranked = sorted(rarity, key=lambda g: (rarity[g], g))
    order = {gram: rank for rank, gram in enumerate(ranked)}
    costs = [rarity[g] for g in ranked]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, lasts = [], [], []
            for row, word in enumerate(batch["word"].to_pylist()):
                grams = ordered_grams(word, order)
                last = grams[PREFIX - 1][0]
                chosen = pivots(grams, costs) if of_pivots else [g for g in grams if g[0] <= last]
                own = [k for _, at in chosen for k in side_keys(word, at, least_letters)]
                keys += own
                rows += [row] * len(own)
                lasts += [last] * len(own)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    batch["word"].take(taken),
                    batch["n"].take(taken),
                    pa.array(lasts, pa.int32()),
                ],
                names=["key", "word", "n", "last"],
            )

    return words.mapInArrow(emit, "key long, word string, n long, last int")


# Pairs and forms


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """word, near, near_n: ordered pairs of `words` (word, n; distinct, of `least_letters` letters and
    more) that differ by exactly one inserted, deleted or replaced code point. A pair may come several
    times: equal last grams let it be found from both of its words, and it may share several keys."""
    rarity = bigram_rarity(words)
    left = keyed(words, rarity, True, least_letters).toDF("key", "a", "an", "al")
    right = keyed(words, rarity, False, least_letters).toDF("key", "b", "bn", "bl")
    met = left.join(right, "key").where(
        "al <= bl and abs(length(a) - length(b)) <= 1 and levenshtein(a, b, 1) = 1"
    )
    ways = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("near_n")),
    )
    return met.select(F.explode(ways).alias("pair")).select("pair.*")


def variants(
    docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO
) -> DataFrame:
    """One row per word of `docs` (doc_id, text): word, form, root, n, n_near, form_n.

    Words are the runs of `least_letters` letters and more that occur `least_count` times or more, after
    the fixed noise. form is the near word of largest n (the smallest in code-point order of several) if
    it occurs `ratio` times as often as the word, else null; root follows forms to the last, and is
    the word itself where there is none. A null text has no words, a null id counts as empty text;
    repeated rows count again; other columns are ignored; an empty table gives an empty result.
    """
    if least_letters < PREFIX + 3:
        raise ValueError("pivotal grams need words of six letters and more")
    spark, written = docs.sparkSession, []

    def step(rows: DataFrame, name: str) -> DataFrame:
        kept, path = write_out(rows, f"spelling-{name}")
        written.append(path)
        return kept

    try:
        counted = word_counts(docs, least_letters)
        words = step(counted.where(F.col("n") >= least_count), "words")
        # Written, so that the shuffled keys go before the pairs are shuffled.
        found = step(near_words(words, least_letters), "pairs").distinct()
        best = found.groupBy("word").agg(
            F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best")
        )
        near_n = -F.col("best.n")
        enough = near_n >= ratio * F.col("n")
        formed = words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"),
            F.when(enough, near_n).alias("form_n"),
        )
        table = step(formed, "forms")
        rooted = table.join(roots(table, ratio), "word", "left")
        columns = ["word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"]
        return write_out(rooted.select(*columns), "spelling")[0]
    finally:
        discard(spark, *written)


def roots(table: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, root of every word of `table` (word, form, form_n) that has a form.

    Each hop multiplies the count by `ratio` at least, which bounds the chains; pointers double their
    reach in each of the joins.
    """
    reached = table.where("form is not null").select("word", F.col("form").alias("root"))
    most = table.agg(F.max("form_n")).first()[0]
    hops = math.ceil(math.log(most, ratio)) if most else 0
    for _ in range(max(0, hops - 1).bit_length()):
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return reached
