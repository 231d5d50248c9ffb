"""Quality rules: a threshold table compiled into one projection, with built-in functions only.

The projection measures every text once (words, lines, symbols, repeats, stop words), then a row per
rule of `RULES` bounds one ratio of these measures. No row is shuffled and no user function runs.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.llm.common import BLANKS

#: Our choice: frequent function words of English, German, French and Spanish. A text in any other language
#: has hardly any of them and fails the rule on them: give the rules that fit your languages.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this at are from "
    "der die und zu den von mit das des sich für auf ist im nicht dem ein als eine "
    "de la le et les du un une que est au pour qui sur dans par pas avec "
    "el en los del y se por las no con su lo para al"
).split()

#: name, measure, at least, at most. A text without words fails the base rule already.
RULES = (
    ("mean word length", "word_chars / n_words", 2.0, 14.0),
    ("symbols per word", "n_symbols / n_words", None, 0.5),
    ("stop words per word", "n_stop_words / n_words", 0.02, None),
    ("repeated lines per line", "n_dup_lines / n_lines", None, 0.6),
    ("words per line", "n_words / n_lines", 1.5, None),
)

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more.

    Windows are compared by XXH64 of their three words; sorted with their places, equal ones are
    neighbours. A place counts up to the next repeated one, three words at most.
    """
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.struct(
            F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"),
            i.alias("i"),
        ),
    )
    return F.when(F.size(words) >= 4, F.sort_array(windows))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every text; a null text has none of anything."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    parts = docs.select("doc_id", text.alias("text"), words.alias("words"), lines.alias("lines"))
    sorted_windows = parts.select("*", _repeat_words(F.col("words")).alias("sorted"))
    places = sorted_windows.select(
        "doc_id",
        "text",
        "words",
        "lines",
        F.sort_array(
            F.transform(
                F.filter(
                    "sorted",
                    lambda w, k: (w["h"] == F.get("sorted", k + 1)["h"])
                    | (w["h"] == F.get("sorted", k - 1)["h"]),
                ),
                lambda w: w["i"],
            )
        ).alias("places"),
    )
    spans = F.transform(
        "places", lambda p, k: F.coalesce(F.least(F.get("places", k + 1) - p, F.lit(3)), F.lit(3))
    )
    bare = F.col("text")
    for blank in " \t\n\x0b\x0c\r":
        bare = F.replace(bare, F.lit(blank), F.lit(""))
    stop = F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))
    return places.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(spans, F.lit(0), lambda a, s: a + s), F.lit(0))
        .cast("long")
        .alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(stop).cast("long").alias("n_stop_words"),
    )


def verdict(rules=RULES) -> Column:
    """True where a measured row is inside all thresholds; a ratio to zero is inside."""
    inside = F.lit(True)
    for _, measure, low, high in rules:
        above, below = (part.strip() for part in measure.split("/"))
        ratio = F.try_divide(F.col(above).cast("double"), F.col(below).cast("double"))
        if low is not None:
            inside = inside & F.coalesce(ratio >= low, F.lit(True))
        if high is not None:
            inside = inside & F.coalesce(ratio <= high, F.lit(True))
    return inside


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, the five measures of the base rules,
    base_failed, kept.

    The base fails below 50 words, or when more than half of the words are in repeated windows. Null
    and empty texts have no words and fail. Other columns are ignored, repeated rows repeated, an
    empty table gives an empty result.
    """
    failed = (F.col("n_words") < 50) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    )
    return measured(docs).select(
        "doc_id",
        *_MEASURES,
        failed.alias("base_failed"),
        (~failed & verdict(rules)).alias("kept"),
    )


def rules_sql(rules=RULES) -> str:
    """The same thresholds as a SQL condition."""
    terms = []
    for _, measure, low, high in rules:
        above, below = (part.strip() for part in measure.split("/"))
        ratio = f"(CAST({above} AS DOUBLE) / nullif({below}, 0))"
        if low is not None:
            terms.append(f"coalesce({ratio} >= {low}, true)")
        if high is not None:
            terms.append(f"coalesce({ratio} <= {high}, true)")
    return " AND ".join(terms)
