"""Language identification by words first, and shorter and shorter character n-grams for unseen words.

Model. A word that the training texts hold scores its log frequency in every language. Of any other
word the longest n-grams (six characters down to one, word ends included) of which at least one is known
are scored instead, on average, so that an unseen word weighs as much as a seen one. A text's
language is the one with the largest sum; the score is its posterior probability.

Fitting. Spark counts words per language over a bounded sample of labelled rows: of every language about
`SAMPLE` different texts, drawn by their hashes, all of a smaller language; a text given many times
counts once. N-grams are counted over the counted words. Every language has a share of its own in the
model, of words and of n-grams of each length: `WORDS` and `GRAMS` divided by the number of languages, but
`LEAST_WORDS` and `LEAST_GRAMS` at least. What falls out backs off like any unseen word.

Size. The model holds counts of words and n-grams in the languages that have them, not a table of all by
all: with four languages at most 60,000 words and 60,000 n-grams, with 1,000 at most 1,000,000 words and
1,200,000 n-grams, about 500 MB in a worker. Vectors over all languages are made for the words met,
and kept up to `KEPT_BYTES`.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesearch.session import cut_lineage

SAMPLE = 4_000
WORDS, LEAST_WORDS = 60_000, 1_000
#: Of all lengths together; at least, of each length.
GRAMS, LEAST_GRAMS = 60_000, 200
LONGEST = 6
UNKNOWN = "und"
#: Languages whose sizes are sent to every task; beyond, they are joined like any table.
SENT = 100_000
#: Added to every count.
SMOOTHING = 0.5
KEPT_BYTES = 64 << 20
_ENTRY = 150  # bytes of a dictionary entry and its word, about
#: Words of a text whose vectors are added up at a time.
TOGETHER = 100_000
_WORD = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """Lower-case words of a text; a word is a run of letters."""
    return _WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    """The word's n-grams, its ends marked by blanks; single letters go without the marks."""
    marked = word if n == 1 else f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Table:
    """Counts of words, or of n-grams of one length, by language.

    The log frequency of a key in a language is that of a key it does not have, plus
    log((count + SMOOTHING) / SMOOTHING) where it has it.
    """

    def __init__(self, counts: pd.DataFrame, key: str, languages: list[str]):
        column = {name: i for i, name in enumerate(languages)}
        totals = np.zeros(len(languages))
        at = counts["lang"].map(column).to_numpy(np.int64)
        np.add.at(totals, at, counts["c"].to_numpy(np.float64))
        gain = np.log((counts["c"].to_numpy(np.float64) + SMOOTHING) / SMOOTHING)
        self.seen: dict[str, list[tuple[int, float]]] = {}
        for name, where, more in zip(counts[key], at.tolist(), gain.tolist()):
            self.seen.setdefault(name, []).append((where, more))
        self.base = np.log(SMOOTHING) - np.log(totals + SMOOTHING * max(1, len(self.seen)))

    def __contains__(self, key: str) -> bool:
        return key in self.seen

    def mean(self, keys: list[str]) -> np.ndarray:
        """The log frequencies of known keys, on average."""
        sums = [0.0] * len(self.base)
        for key in keys:
            for where, more in self.seen[key]:
                sums[where] += more
        return self.base + np.array(sums) / len(keys)

    def __getitem__(self, key: str) -> np.ndarray:
        return self.mean([key])


class Model:
    """Log frequencies per language, of words and of n-grams."""

    def __init__(self, languages: list[str], words: pd.DataFrame, parts: pd.DataFrame):
        self.languages = languages
        self.words = Table(words, "word", languages)
        self.parts = {
            n: Table(parts[parts["n"] == n], "gram", languages) for n in range(1, LONGEST + 1)
        }
        self.forget()

    def forget(self) -> None:
        """Drop the vectors of the words met so far."""
        self.places = _Places(self.word_scores)

    def word_scores(self, word: str) -> np.ndarray:
        return self.words[word] if word in self.words else self._backed_off(word)

    def _backed_off(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            table = self.parts[n]
            found = [g for g in grams(word, n) if g in table.seen]
            if found:
                return table.mean(found)
        return np.zeros(len(self.languages))

    def identify(self, text: str | None) -> tuple[str, float]:
        words = letters(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        if self.places.held > KEPT_BYTES:
            self.forget()
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        sums = np.zeros(len(self.languages))
        for start in range(0, len(at), TOGETHER):
            sums += self.places.rows[at[start : start + TOGETHER]].sum(axis=0)
        best = int(np.argmax(sums))
        return self.languages[best], float(1 / np.exp(sums - sums[best]).sum())


class _Places(dict):
    """Where the vectors of words stand in one growing table."""

    def __init__(self, scores):
        self.scores = scores
        self.rows = np.empty((0, 0))
        self.held = 0

    def __missing__(self, word: str) -> int:
        vector = self.scores(word)
        at = self[word] = len(self)
        if at >= len(self.rows):
            wider = np.empty((max(1_000, 2 * at), len(vector)))
            wider[:at] = self.rows[:at].reshape(at, len(vector))
            self.rows = wider
        self.rows[at] = vector
        self.held += len(word) + 2 * vector.nbytes + _ENTRY
        return at

    def __reduce__(self):
        return _Places, (self.scores,)  # a model travels without what it has met


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on `rows` (text, lang); rows with a null text or language teach nothing, and a language
    without a word in its sample is not learnt."""
    known = rows.where("lang is not null and text is not null").select("lang", "text")
    hashed = known.withColumn("h", F.xxhash64("text"))
    sizes = cut_lineage(
        hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("texts"))
    )
    # A row per language; texts that are not drawn are not shuffled.
    if sizes.count() <= SENT:
        sizes = F.broadcast(sizes)
    draw = F.pmod(F.xxhash64("h"), F.lit(1 << 40)) / float(1 << 40)
    chosen = (
        hashed.join(sizes, "lang")
        .where(draw < F.lit(float(sample)) / F.col("texts"))
        .dropDuplicates(["lang", "h"])
    )
    words = cut_lineage(
        chosen.select("text", "lang")
        .mapInPandas(_count_words, "lang string, word string, c long")
        .groupBy("lang", "word")
        .agg(F.sum("c").alias("c"))
    )
    parts = (
        words.mapInPandas(_count_grams, "lang string, n int, gram string, c long")
        .groupBy("lang", "n", "gram")
        .agg(F.sum("c").alias("c"))
    )
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    shares = max(1, len(languages))
    kept_words = _most_frequent(words, ["lang"], "word", max(LEAST_WORDS, WORDS // shares))
    kept_parts = _most_frequent(
        parts, ["lang", "n"], "gram", max(LEAST_GRAMS, GRAMS // (LONGEST * shares))
    )
    return Model(languages, kept_words.toPandas(), kept_parts.toPandas())


def _most_frequent(counts: DataFrame, group: list[str], key: str, size: int) -> DataFrame:
    """The counts of the `size` keys of each group that are most frequent in it."""
    order = Window.partitionBy(*group).orderBy(F.desc("c"), key)
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).drop("place")


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for text, lang in zip(batch["text"], batch["lang"]):
            counts.setdefault(lang, Counter()).update(letters(text))
        yield _frame([(lang, w, c) for lang, x in counts.items() for w, c in x.items()], ["lang", "word", "c"])


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, word, c in zip(batch["lang"], batch["word"], batch["c"]):
            for n in range(1, LONGEST + 1):
                for gram in grams(word, n):
                    counts[lang, n, gram] += c
        yield _frame([(*key, c) for key, c in counts.items()], ["lang", "n", "gram", "c"])


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def identify_languages(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, lang_pred, score (0 to 1).

    A null text, or one without a letter, is `und` with score 0; so is every text of a model that was
    fitted on nothing. Equal sums go to the language that is first in the alphabet. Other columns are
    ignored, repeated rows repeated, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        identify = shared.value.identify
        for texts in batches:
            yield pd.DataFrame([identify(t) for t in texts], columns=["lang_pred", "score"])

    found = docs.select("doc_id", predict("text").alias("found"))
    return found.select("doc_id", "found.lang_pred", "found.score")
