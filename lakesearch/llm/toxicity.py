"""Toxicity scores by a counterfactual-regularised classifier.

Model. A word has features of its own: the word, and its first four, five and six letters. A sentence's
logit is a bias plus the weights of its distinct words' features; a text's is that of its worst sentence,
so one insult in a long clean text counts in full. Sentences end at stops of any script; one of more than
`WINDOW` words is read in windows of so many words, each half over the one before, so that length alone
makes nothing toxic. The fit sees the same sentences and windows, whole. Weights are found in three steps:

1. In a bounded sample of labelled rows (`SAMPLE` per label) Spark counts in how many texts of either
   label each feature (hashed to `SLOTS`) occurs; smoothed log ratios are the first weights. A feature
   of fewer than `SUPPORT` texts has none: it would only learn that one text's label by heart.
2. With these, each row of the sample gives the sentences that score highest: what makes a text
   toxic, and what in clean texts comes nearest to it.
3. Logistic regression on these sentences, repeated for `ROUNDS` rounds with the sentences that score
   highest by then. Each sentence that names a group is paired with the same
   sentence naming other groups, and the squared change of the logit is penalised, so the names
   themselves, and what only occurs beside them, cannot carry the verdict.

No weight falls below `LEAST`: clean words, however many, do not outweigh an insult beside them.

The model is `SLOTS` numbers and a bias, whatever the corpus.
"""

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesearch.session import cut_lineage

SLOTS = 1 << 18
#: Labelled rows of either label that are fitted. A documented bound of the classifier.
SAMPLE = 3_000
SENTENCES = 3
SUPPORT = 2
#: Least weight of a feature: clean words around an insult speak against it only so much.
LEAST = 0.0
#: Words of a window of a longer sentence, in fitting and in scoring; even.
WINDOW = 64
ROUNDS = 3
EPOCHS = 80
SWAPS = 3
L2 = 1e-4
FAIRNESS = 1.0
KEPT_WORDS = 200_000

#: Our choice: terms that name groups of people; a term is swapped for others of its own line.
IDENTITY_TERMS = (
    "women men girls boys",
    "woman man girl boy",
    "black white asian latino african european arab indigenous",
    "christian muslim jewish hindu buddhist catholic protestant atheist",
    "christians muslims jews hindus buddhists catholics protestants atheists",
    "gay straight lesbian bisexual transgender queer",
    "immigrants refugees foreigners locals natives",
    "immigrant refugee foreigner local native",
    "american british french german spanish mexican chinese indian russian turkish polish",
    "old young disabled deaf blind",
    "frauen männer mädchen jungen",
    "christen muslime juden hindus buddhisten",
    "deutsche franzosen spanier türken polen russen",
    "schwarze weiße asiaten ausländer flüchtlinge einwanderer",
    "femmes hommes filles garçons",
    "chrétiens musulmans juifs hindous bouddhistes",
    "noirs blancs arabes asiatiques étrangers réfugiés immigrés",
    "mujeres hombres niñas niños",
    "cristianos musulmanes judíos hindúes budistas",
    "negros blancos árabes asiáticos extranjeros refugiados inmigrantes",
)
GROUPS = {t: [u for u in line.split() if u != t] for line in IDENTITY_TERMS for t in line.split()}
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
STOPS = frozenset(".!?…。．！？｡؟۔।॥።")
#: Stops of scripts that put no blank after them, with the marks that close a quotation.
_UNSPACED = re.compile("[。．！？｡]+[」』）】〉》”’\"')]*")


def words_of(text: str) -> list[str]:
    """Lower-case tokens of a text."""
    text = text.lower()
    return (text if text.isascii() else _UNSPACED.sub(r"\g<0> ", text)).split()


def bare(token: str) -> str:
    """A token without the marks around it."""
    return _EDGES.sub("", token)


def slots(word: str) -> list[int]:
    """Features of a lower-case word. A token without letters or digits has none."""
    if not word:
        return []
    parts = [f"w {word}"] + [f"p{k} {word[:k]}" for k in (4, 5, 6) if len(word) >= k]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % SLOTS for p in parts]


def ends_sentence(token: str) -> bool:
    """Whether it has a stop among the marks behind its last letter, digit or comma."""
    for c in reversed(token):
        if c in STOPS:
            return True
        if c.isalnum() or c in ",;:":
            return False
    return False


class _Scores(dict):
    """Weight of a token, whether a sentence ends with it, and its bare form."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, token: str) -> tuple[float, bool, str]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        word = bare(token)
        weight = float(sum(self.weights[s] for s in slots(word)))
        value = self[token] = (weight, ends_sentence(token), word)
        return value


def windows(ends: Sequence[bool]) -> list[tuple[int, int]]:
    """First and last token (exclusive) of each sentence, or of each window of a long one."""
    found = []
    start = 0
    for stop in [k + 1 for k, end in enumerate(ends[:-1]) if end] + [len(ends)]:
        while stop - start > WINDOW:
            found.append((start, start + WINDOW))
            start += WINDOW // 2
        found.append((start, stop))
        start = stop
    return found


def sentence_logits(tokens: list[str], scores: dict) -> tuple[np.ndarray, np.ndarray]:
    """First token of each sentence or window, and the summed weight of its distinct words.

    Said often, a word counts once, so that repetition alone makes nothing toxic.
    """
    weights, ends, words = zip(*[scores[t] for t in tokens])
    bounds = windows(ends)
    sums = [sum(dict(zip(words[a:b], weights[a:b])).values()) for a, b in bounds]
    return np.array([a for a, _ in bounds]), np.array(sums, np.float64)


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self):
        scores = _Scores(self.weights)

        def score(text: str | None) -> float:
            tokens = words_of(text) if text else []
            logit = self.bias
            if tokens:
                logit += float(sentence_logits(tokens, scores)[1].max())
            return 1 / (1 + float(np.exp(-max(-60.0, min(60.0, logit)))))

        return score


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of up to `sample` labelled rows of either label, drawn by a hash of the id.

    The ids are drawn from the labels alone and, `2 * sample` of them at most, sent to where the texts
    are; no text is shuffled to find its label. An id that `labels` repeats takes its largest label;
    of texts that share an id the smallest is taken.
    """
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    drawn = [
        known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        for label in (0, 1)
    ]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))
    return (
        docs.select("doc_id", "text")
        .join(ids, "doc_id")
        .where("text is not null")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
        .select("text", "toxic")
    )


def train(rows: DataFrame) -> Model:
    """Fit on labelled `rows` (text, toxic). Without rows of both labels the score is 0 for all (or
    1, if all rows are toxic)."""
    spark: SparkSession = rows.sparkSession
    rows = cut_lineage(rows.where("text is not null").select("text", "toxic"))
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not clean or not toxic:
        return Model(np.zeros(SLOTS), 30.0 if toxic else -30.0)
    counts = (
        rows.mapInPandas(_count_features, "slot int, toxic int, n long")
        .groupBy("slot", "toxic")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    seen = np.zeros((2, SLOTS))
    seen[counts["toxic"], counts["slot"]] = counts["n"]
    # One and a half rows of doubt: what few texts have proves little.
    first = np.log((seen[1] + 0.5) / (toxic + 1)) - np.log((seen[0] + 0.5) / (clean + 1))
    texts = seen.sum(axis=0)
    first *= (texts / (texts + 1.5)) / 4
    known = texts >= SUPPORT
    first[~known] = 0.0
    first = np.maximum(first, LEAST)
    model = Model(first, 0.0)
    found: list[pd.DataFrame] = []
    for _ in range(ROUNDS):
        weights = spark.sparkContext.broadcast(model.weights)
        found.append(
            rows.mapInPandas(
                lambda batches, w=weights: _pick_sentences(batches, w.value),
                "words array<string>, toxic int",
            ).toPandas()
        )
        weights.destroy()
        model = fit_rounds(found, first, known)
    return model


def fit_rounds(found: list[pd.DataFrame], first: np.ndarray, known: np.ndarray) -> Model:
    """Fit on what all rounds found in clean texts and the last one found in toxic texts."""
    fitted = pd.concat([f[f["toxic"] == 0] for f in found] + [found[-1][found[-1]["toxic"] == 1]])
    # The same sentence may have been found before; the order decides nothing but the last digits.
    fitted["key"] = [" ".join(w) for w in fitted["words"]]
    fitted = fitted.drop_duplicates(["key", "toxic"]).sort_values(["toxic", "key"])
    return _fit(fitted["words"].tolist(), fitted["toxic"].to_numpy(), first, known)


def _count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen = np.zeros((2, SLOTS), np.int64)
        for text, toxic in zip(batch["text"], batch["toxic"]):
            words = {bare(t) for t in set(words_of(text))}
            seen[toxic, list({s for w in words for s in slots(w)})] += 1
        toxic, slot = np.nonzero(seen)
        yield pd.DataFrame(
            {"slot": slot.astype(np.int32), "toxic": toxic.astype(np.int32), "n": seen[toxic, slot]}
        )


def _pick_sentences(batches: Iterator[pd.DataFrame], weights: np.ndarray) -> Iterator[pd.DataFrame]:
    scores = _Scores(weights)
    for batch in batches:
        out = []
        for text, toxic in zip(batch["text"], batch["toxic"]):
            tokens = words_of(text)
            if not tokens:
                continue
            sums = sentence_logits(tokens, scores)[1]
            bounds = windows([scores[t][1] for t in tokens])
            parts = [[bare(t) for t in tokens[a:b]] for a, b in bounds]
            # Only the worst sentence is surely what made a text toxic.
            for k in np.argsort(-sums, kind="stable")[: 1 if toxic else SENTENCES]:
                out.append((parts[k], toxic))
            named = [words for words in parts if any(w in GROUPS for w in words)]
            for words in named[:SENTENCES] if not toxic else []:
                out.append((words, toxic))
        yield pd.DataFrame(out, columns=["words", "toxic"])


def counterfactuals(words: list[str]) -> list[list[str]]:
    """The sentence with each group it names swapped for another one of its kind."""
    if not any(w in GROUPS for w in words):
        return []
    return [[GROUPS[w][k % len(GROUPS[w])] if w in GROUPS else w for w in words] for k in range(SWAPS)]


def _rows(sentences: list[list[str]], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Known features of the distinct words of all sentences, and the sentence of each."""
    cache: dict[str, list[int]] = {}
    flat, owner = [], []
    for k, words in enumerate(sentences):
        for w in dict.fromkeys(words):
            if w not in cache:
                cache[w] = [s for s in slots(w) if known[s]]
            flat.extend(cache[w])
            owner.extend([k] * len(cache[w]))
    return np.array(flat, np.int64), np.array(owner, np.int64)


def _fit(
    sentences: list[list[str]], toxic: np.ndarray, first: np.ndarray, known: np.ndarray
) -> Model:
    """Adam on the weights of the features that occur, from the log ratios on."""
    sentences = [list(s) for s in sentences]
    swapped, source = [], []
    for k, words in enumerate(sentences):
        for other in counterfactuals(words):
            swapped.append(other)
            source.append(k)
    flat, owner = _rows(sentences + swapped, known)
    used, column = np.unique(flat, return_inverse=True)
    w, bias = first[used].copy(), 0.0
    n, m = len(sentences), len(sentences) + len(swapped)
    source = np.array(source, np.int64)
    y = toxic.astype(float)
    # Both labels count alike, however many rows they have; a missed toxic text counts double.
    balance = np.where(y == 1, n / max(1, y.sum()), n / max(1, 2 * (n - y.sum())))
    mean, spread = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, EPOCHS + 1):
        logits = np.bincount(owner, weights=w[column], minlength=m) + bias
        pull = np.zeros(m)
        pull[:n] = balance * (1 / (1 + np.exp(-np.clip(logits[:n], -50, 50))) - y) / n
        if len(source):
            change = 2 * FAIRNESS * (logits[n:] - logits[source]) / len(source)
            pull[n:] += change
            np.add.at(pull, source, -change)
        slope = np.bincount(column, weights=pull[owner], minlength=len(w)) + L2 * w
        slope = np.append(slope, pull.sum())
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
        w = np.maximum(w - move[:-1], LEAST)
        bias -= move[-1]
    weights = np.zeros(len(first))
    weights[used] = w
    # Features that no fitted sentence has keep a positive sign of their own only if it is strong.
    unfitted = np.ones(len(first), bool)
    unfitted[used] = False
    weights[unfitted] = np.where(np.abs(first[unfitted]) > 0.5, first[unfitted], 0.0)
    return Model(weights, float(bias))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, score in 0..1, predicted (score >= 0.5).

    Null and empty texts get the model's bias alone. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = Model(*shared.value).scorer()
        for texts in batches:
            yield pd.Series([score(t) for t in texts], dtype="float64")

    scored = docs.select("doc_id", scores("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the model does not reject, with all their columns.

    Fitted on a sample of the labelled rows of `docs`. The score is computed beside the row: nothing
    is shuffled.
    """
    model = train(labelled_sample(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = Model(*shared.value).scorer()
        for texts in batches:
            yield pd.Series([score(t) < 0.5 for t in texts], dtype="bool")

    return docs.where(clean("text"))
