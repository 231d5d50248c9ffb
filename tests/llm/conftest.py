import random

import pytest

WORDS = "stone river cloud maple amber copper willow harbor candle meadow lantern pepper".split()


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(f"{pick.choice(WORDS)}{pick.randrange(60)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Ids and texts with copies, near copies, shared passages, empty, null and long texts."""
    passage = prose(99, 60)
    rows = [(i, prose(i, 40 + 7 * i)) for i in range(12)]
    rows += [
        (20, rows[3][1]),  # exact copy
        (21, rows[3][1].upper()),  # equal after lower-casing A-Z
        (22, rows[5][1].replace("stone", "Stone") + " tail"),  # near copy
        (23, "head of it\n" + passage + " and an end"),
        (24, prose(7, 50) + "\t" + passage),
        (25, passage + " " + passage),  # the same passage twice in one text
        (26, ""),
        (27, None),
        (28, " \t\n "),
        (29, "one two"),
        (30, "again " * 90),
        (31, prose(31, 4000)),
        (32, "Éa Ünder <|endoftext|> naïve ÇA's  x y\x1cz 12½ Σίσυφος 漢字🙂"),
        (33, "Éa ünder"),
        (34, "éa ünder"),
        (20, rows[3][1]),  # a repeated row
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The same as a table with columns whose names the operators use inside."""
    rows = [(i, t, "en", f"s{i}", len(t or ""), 1, 2, "x") for i, t in texts]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, h int, fp int, norm string",
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
