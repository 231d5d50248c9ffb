import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakesearch.llm import bpe, extraction, langid, packing, perspectives, quality, toxicity
from lakesearch.session import shared_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "ab cdeI'sétΣσİ  \n\t12٣½🙂漢字\x1c \x85​.,!?-__'ll'Re'VEéÅﬁ́"


def odd_texts(n):
    pick = random.Random(5)
    for k in range(n):
        text = "".join(pick.choice(ALPHABET) for _ in range(pick.randrange(40)))
        if k % 7 == 0:
            text += "<|endoftext|>" + text[:5] + "<|startoftext|>"
        if k % 5 == 0:
            text = "".join(chr(pick.choice([32, pick.randint(1, 0x2FF), pick.randint(0x300, 0xD7FF), pick.randint(0xE000, 0x1FFFF)])) for _ in range(20))
        yield text


# BPE


def test_bpe_equals_the_library_on_odd_texts():
    mine, library = bpe.WordBpe(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for text in [*odd_texts(1500), "a" * 3000, "ab" * 2000]:
        ids, shown = mine.encode_all([text])[0]
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert shown.decode() == library.decode(want, skip_special_tokens=False)


def test_bpe_query_rows(docs, texts, no_docs):
    library = Tokenizer.from_file(WORD_BPE)
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256(shown.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encode_decode(docs, WORD_BPE).collect())) == sorted(want)
    assert bpe.encode_decode(no_docs, WORD_BPE).count() == 0


# Packing


def test_byte_tokens_equal_the_library():
    mine, library = packing.ByteTokens(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    for text in odd_texts(1500):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == want, text


def test_packing_places_every_piece_once(docs, texts, no_docs):
    library = Tokenizer.from_file(BYTE_BPE)
    rows = packing.pack(docs, BYTE_BPE).toPandas()
    pieces = []
    for i, t in texts:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            pieces.append((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    got = rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)
    assert sorted(map(tuple, got)) == sorted(pieces)
    for _, sequence in rows.groupby("sequence_id"):
        ends = 0
        for offset, length in sorted(zip(sequence["offset"], sequence["length"])):
            assert offset == ends
            ends += length
        assert ends <= 1024
    assert packing.pack(no_docs, BYTE_BPE).count() == 0


def test_evolution_never_loses_to_best_fit(monkeypatch):
    pick = np.random.default_rng(2)
    lengths = pick.integers(200, 700, 600)
    island = packing.Island(lengths, 1)
    island.start()
    first = -island.fitness(island.members[0])[0]
    island.evolve(30)
    best = island.best()
    fill = np.bincount(best, weights=lengths)
    assert fill.max() <= packing.CAPACITY and len(best) == len(lengths)
    assert island.bound <= -island.fitness(best)[0] <= first


def test_crossover_keeps_every_piece_once():
    lengths = np.random.default_rng(4).integers(1, 1024, 300)
    island = packing.Island(lengths, 7)
    island.bound = 0
    island.start()
    child = island.cross(island.members[0], island.members[-1])
    assert (child >= 0).all() and np.bincount(child, weights=lengths).max() <= packing.CAPACITY


@pytest.mark.parametrize("lengths", [[1], [1023] * 5, [600, 600, 400, 400, 24], [512] * 7, [1] * 3000])
def test_lower_bound_is_below_best_fit(lengths):
    bins, slack = [-1] * len(lengths), []
    packing.best_fit(sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths, bins, slack)
    assert packing.lower_bound(np.array(lengths)) <= len(slack)


def test_pieces_of_many_blocks_get_new_company(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 200)
    pick = random.Random(1)
    rows = [(k, " ".join(["word"] * pick.randrange(1000))) for k in range(700)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack(table, BYTE_BPE).toPandas()
    assert len(out) == 700 and out.groupby("sequence_id")["length"].sum().max() <= 1024
    total = -(-out["length"].sum() // 1024)
    assert out["sequence_id"].nunique() <= 1.06 * total


# Language


@pytest.fixture(scope="module")
def language_rows(spark):
    kinds = {"aa": "kol tam resh pilu", "bb": "vuri nost quel zadi", "cc": "ämbo öttu ülke issä"}
    pick = random.Random(3)
    rows = []
    for k in range(240):
        lang = pick.choice(list(kinds))
        rows.append((k, " ".join(pick.choice(kinds[lang].split()) + "a" * pick.randrange(3) for _ in range(12)), lang))
    rows += [(900, None, "aa"), (901, "12 34 .", "bb"), (902, "", None), (903, "kolresh", None), (903, "kolresh", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_of_unseen_rows_and_words(language_rows):
    model = langid.train(language_rows.where("doc_id % 3 <> 0"))
    found = langid.identify_languages(language_rows, model)
    rows = {r.doc_id: r for r in found.collect()}
    want = {r.doc_id: r.lang for r in language_rows.where("doc_id < 900").collect()}
    assert all(rows[i].lang_pred == lang for i, lang in want.items())
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert [rows[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert rows[903].lang_pred == "aa"  # by n-grams alone
    assert found.count() == language_rows.count()
    assert "kolresh" not in model.words


def test_language_model_of_nothing(language_rows):
    model = langid.train(language_rows.where("false"))
    assert model.identify("some text") == ("und", 0.0)


def test_back_off_goes_to_shorter_grams(language_rows):
    model = langid.train(language_rows)
    assert langid.grams("kol", 2) == [" k", "ko", "ol", "l "]
    longest = np.mean([model.parts[4][g] for g in langid.grams("kolxx", 4) if g in model.parts[4]], axis=0)
    assert np.allclose(model.word_scores("kolxx"), longest)


# Toxicity


@pytest.fixture(scope="module")
def toxic_rows(spark):
    pick = random.Random(9)
    calm = "garden window letter music bread summer travel paper".split()
    harsh = "grubling snarkwit vilefoot".split()
    rows = []
    for k in range(400):
        words = [pick.choice(calm) for _ in range(30)]
        toxic = k % 4 == 0
        if toxic:
            # Insults mostly stand beside one group's name: what the penalty is for.
            words[5:7] = ["muslims", pick.choice(harsh)]
        elif k % 25 == 1:
            words[5] = "christians"
        words[14] += "."
        rows.append((k, " ".join(words), int(toxic)))
    rows += [(990, None, 0), (991, "", 0), (992, "?", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_on_held_out_rows(toxic_rows):
    model = toxicity.train(toxic_rows.where("doc_id % 5 <> 0"))
    scored = {r.doc_id: r for r in toxicity.score_texts(toxic_rows, model).collect()}
    held = toxic_rows.where("doc_id % 5 = 0 and doc_id < 400").collect()
    assert all(scored[r.doc_id].predicted == r.toxic for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.values())
    assert {990, 991, 992} <= set(scored)


def test_penalty_keeps_group_names_neutral(toxic_rows, monkeypatch):
    neutral = "summer music for muslims and bread"

    def name_gap(fairness):
        monkeypatch.setattr(toxicity, "FAIRNESS", fairness)
        score = toxicity.train(toxic_rows.where("doc_id < 900")).scorer()
        return score(neutral), score(neutral.replace("muslims", "christians"))

    one, other = name_gap(1.0)
    without, without_other = name_gap(0.0)
    print("with", one, other, "without", without, without_other)
    assert abs(one - other) < abs(without - without_other)


def test_counterfactuals_swap_every_name():
    words = "the women met gay men".split()
    others = toxicity.counterfactuals(words)
    assert others and all(o[1] != "women" and o[3] != "gay" and o[0] == "the" for o in others)
    assert toxicity.counterfactuals(["calm", "words"]) == []


def test_toxicity_counts_a_word_once_in_a_sentence():
    weights = np.zeros(toxicity.SLOTS)
    weights[toxicity.slots("ugly")] = 1.0
    scores = toxicity._Scores(weights)
    starts, sums = toxicity.sentence_logits("ugly, ugly! a day. so ugly ugly".split(), scores)
    assert starts.tolist() == [0, 2, 4]
    assert sums.tolist() == [scores["ugly"][0], 0.0, scores["ugly"][0]]
    starts, sums = toxicity.sentence_logits(["!!!"], scores)
    assert (starts.tolist(), sums.tolist()) == ([0], [0.0])


def test_toxicity_learns_nothing_from_words_of_one_text(toxic_rows):
    shown = toxic_rows.where("doc_id < 300").selectExpr(
        "concat(text, ' onlyhere', cast(doc_id as string), '.') as text", "toxic"
    )
    score = toxicity.train(shown).scorer()
    toxic = [r.text.split()[-1] for r in shown.where("toxic = 1").limit(20).collect()]
    assert all(score(f"A calm day. Then {w}") < 0.5 for w in toxic)


def test_toxicity_fits_on_what_it_scores(toxic_rows):
    """Long clean texts without full stops are no more toxic than the same words in sentences."""
    ended = "one。」two！ three。\nlist word.%%% etc., end 3.5 x"
    tokens = toxicity.words_of(ended)
    starts = [a for a, _ in toxicity.windows([toxicity.ends_sentence(t) for t in tokens])]
    assert [tokens[a] for a in starts] == ["one。」", "two！", "three。", "list", "etc.,"]
    bounds = toxicity.windows([False] * 1000)
    assert bounds[0][0] == 0 and bounds[-1][1] == 1000
    assert all(b - a <= toxicity.WINDOW for a, b in bounds)
    assert all(later[0] < earlier[1] for earlier, later in zip(bounds, bounds[1:]))
    score = toxicity.train(toxic_rows.where("doc_id < 300")).scorer()
    weights = np.zeros(toxicity.SLOTS)
    for k in range(500):
        weights[toxicity.slots(f"w{k}")[0]] = 0.01
    mild = toxicity.Model(weights, -2.0).scorer()
    long = " ".join(f"w{k}" for k in range(500))
    assert mild(long) < 0.5 and mild(long.replace(" ", "\n")) < 0.5
    calm = " ".join("garden window letter music bread summer travel paper".split() * 60)
    assert score(calm) < 0.5 and score(calm + " snarkwit muslims " + calm) >= 0.5


def test_toxicity_without_labels(toxic_rows, docs):
    none = toxicity.train(toxic_rows.where("false"))
    assert none.scorer()("anything") < 0.5
    assert toxicity.train(toxic_rows.where("toxic = 0")).scorer()("anything") < 0.5
    labels = toxic_rows.select("doc_id", "toxic")
    kept = toxicity.drop_toxic(docs, labels.where("false"))
    assert kept.columns == docs.columns and kept.count() == docs.count()


# Pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body><header class="top"><a href="/">Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class=ad>Buy now!</div>
<main><article><h1>A  title &amp; more</h1><p>First paragraph of the article, which is long enough.
<p>Second <b>bold<br>text</b> &lt;p&gt; &copy; here, with several more words in it.<!-- no --></p>
<aside>Related: other things</aside><div>Short line</div><ul><li>point one of the list</li></ul>
<form><label>Mail</label><button>Send</button></form></article></main>
<section id="comments"><p>Reader says: this is a very long comment, as readers write them.</p></section>
<footer>&copy; Site</footer>"""


def test_main_text():
    assert extraction.main_text(PAGE).split("\n\n") == [
        "A title & more",
        "First paragraph of the article, which is long enough.",
        "Second bold text <p> © here, with several more words in it.",
        "Short line",
        "point one of the list",
    ]


def test_pages_of_all_kinds(spark):
    rows = [(1, "u", PAGE, 1), (2, "u", None, 1), (3, None, "", 1), (4, "u", "<nav>only</nav>", 1), (5, "u", "bare text of a page", 1), (5, "u", "bare text of a page", 1), (6, "u", "<p>x" * 3000, 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = extraction.extract(table).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    by_id = {r.page_id: r.text for r in found}
    assert by_id[2] == by_id[3] == by_id[4] == "" and by_id[5] == "bare text of a page"
    assert by_id[6].count("x") == 3000
    assert extraction.extract(table.where("false")).count() == 0


def test_cut_is_minimal():
    pick = random.Random(8)
    for _ in range(60):
        n = pick.randrange(1, 7)
        source = [pick.randrange(12) for _ in range(n)]
        sink = [pick.randrange(12) for _ in range(n)]
        edges = [(a, b, pick.randrange(1, 8)) for a in range(n) for b in range(a + 1, n) if pick.random() < 0.5]

        def cost(kept):
            return (
                sum(s for s, k in zip(source, kept) if not k)
                + sum(t for t, k in zip(sink, kept) if k)
                + sum(c for a, b, c in edges if kept[a] != kept[b])
            )

        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(extraction.minimum_cut(source, sink, edges)) == best


# Quality


def brute_quality(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    lines = [line for line in text.split("\n") if line.encode().split()]
    places: dict = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(repeated),
    )


def test_quality_measures(spark, docs, texts, no_docs):
    extra = [(50, "a b c a b c a b c d"), (51, "x x x x x"), (52, "l 1\nl 1\n\nl 1\r\n"), (53, "the cat " * 3 + " ".join(f"the w{i} of" for i in range(40)))]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    got = sorted(tuple(r)[:6] for r in quality.quality(every).collect())
    assert got == sorted((i, *brute_quality(t)) for i, t in [*texts, *extra])
    rows = {r.doc_id: r for r in quality.quality(every).collect()}
    assert rows[53].kept and not rows[53].base_failed
    assert rows[30].base_failed and rows[27].base_failed and not rows[27].kept
    assert quality.quality(no_docs).count() == 0


def test_each_rule_can_reject(spark):
    calm = "the river of stones and the hill with a tree in it is as it was by the sea "
    texts = {
        "ok": calm * 1 + " ".join(f"the w{i} of" for i in range(30)),
        "symbols per word": " ".join(f"the#%% w{i}$$" for i in range(60)),
        "stop words per word": " ".join(f"word{i}" for i in range(80)),
        "mean word length": " ".join(["the of " + "q" * 60 + str(i) for i in range(40)]),
        "words per line": "\n".join(f"w{i}" if i % 9 else "the" for i in range(80)),
    }
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts.values())], "doc_id long, text string")
    kept = [r.kept for r in quality.quality(table).orderBy("doc_id").collect()]
    assert kept == [True, False, False, False, False]


def test_quality_plan_has_no_python_and_no_shuffle(docs):
    plan = quality.quality(docs.coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Perspectives


def escaped(text, role=False):
    out = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return out.replace("|>", "|\\>").replace("\n", "\\n").replace("\r", "\\r") if role else out


def render(turns, who):
    text, spans = "", []
    for role, said in turns:
        if role is None:
            head = "<|user|>\n"
        elif role == who:
            head = "<|assistant|>\n"
        else:
            head = "<|system|>\n" if role == "system" else f"<|user name={escaped(role, True)}|>\n"
        text += head
        start = len(text)
        text += escaped(said) + "<|end|>\n"
        if role == who:
            spans.append((start, len(text)))
    return text, spans


def test_perspectives_equal_a_plain_rendering(spark):
    rows = [
        (1, 0, "system", "rules"), (1, 1, "ann", "hi é🙂"), (1, 2, "bob", "<|assistant|> no"), (1, 3, "cy", None),
        (1, 4, "ann", ""), (1, 4, "ann", ""), (1, None, None, "late"), (1, 5, "unknown", "is a name"), (1, 5, None, "has none"),
        (2, 0, "system", "alone"), (None, 0, "dee", "x"), (3, 0, None, "nameless"),
        (5, 0, "bob|>\nX", "a\\b <\\| <|"), (5, 1, "ann", "x" * 300_000), (5, 2, "", "no letters in the name"), (5, 3, "<|\\\r", "y"),
    ]
    rows += [(4, k, f"p{k % 3}" if k % 11 else None, f"turn {k} " + "y" * (k % 5)) for k in range(200)]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, block string")
    got = {}
    for r in perspectives.perspectives(table).collect():
        got[r.conv_id, r.participant, r.block] = (r.text, [(m.start, m.end) for m in r.mask], r.n_turns)
    order = lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")
    want = {}
    for conv in (1, 2, 3, 4, 5, None):
        turns = sorted((r for r in rows if r[0] == conv), key=order)
        said = [(r[2], r[3] or "") for r in turns]
        for who in {r[2] for r in turns} - {None, "system"}:
            for b in range(0, len(said), 64):
                part = said[b : b + 64]
                want[conv, who, b // 64] = (*render(part, who), len(part))
    assert got == want and len([k for k in got if k[0] == 4]) == 12
    assert perspectives.perspectives(table.where("false")).count() == 0


def test_short_dialogues_do_not_depend_on_input_order(spark):
    rows = [(1, k, f"p{k % 2}", f"t{k}") for k in range(9)]
    a = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    b = spark.createDataFrame(rows[::-1], a.schema).repartition(4)
    key = lambda df: sorted((r.participant, r.text) for r in perspectives.perspectives(df).collect())
    assert key(a) == key(b)


# The pipeline


def test_pipeline_stages_keep_columns_and_act(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.conftest import prose

    passage = prose(77, 55)
    rows = [(k, prose(k, 80), "en", "s", 1) for k in range(60)]
    rows += [(100, rows[0][1], "en", "s", 1), (101, "a start " + passage, "en", "s", 1), (102, passage + " an end", "en", "s", 1)]
    rows += [(200 + k, prose(300 + k, 40) + " grubling snarkwit. " + prose(400 + k, 20), "en", "s", 1) for k in range(20)]
    folder = shared_path(spark, "pipeline-test")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(r[0], 1, int(r[0] >= 200)) for r in rows if r[0] % 2 == 0], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "SimHash near-dedup", "substring dedup", "best-fit packing"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, folder)
        assert at.columns == docs.columns, name
        at = spark.createDataFrame(at.collect(), docs.schema)
    left = {r.doc_id: r.text for r in at.collect()}
    assert not any(i >= 200 for i in left) and not {0, 100} <= set(left) and len(left) == 62
    assert passage not in left[101] and passage not in left[102]
    final = corpus_pipeline.run(spark, folder).toPandas()
    assert set(final["doc_id"]) == set(left)
    library = Tokenizer.from_file(BYTE_BPE)
    want = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in left.values())
    assert final["length"].sum() == want
