"""Inputs that once stopped or misled an operator: hostile pages, long white space, rare languages."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakesearch.llm import bpe, extraction, langid, packing

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PARAGRAPH = "A long paragraph of an article that has many words in it, and goes on for a while. " * 4
P = f"<p>{PARAGRAPH}</p>"
TEXT = PARAGRAPH.strip()


# Pages


@pytest.mark.parametrize(
    "page",
    [
        "<b" * 100_000,
        '<a href="x' * 100_000,
        "<a href='x\"" * 100_000,
        "<" * 200_000,
        "</" * 100_000,
        "<!--" * 50_000,
        "<script>" * 50_000,
        "<a " + "=" * 200_000,
        "<a " + '="' * 100_001,
        "<p>" * 100_000,
        "<div>x" * 30_000,
        "<b>" * 50_000 + "</i>" * 50_000,
        "<p><select>" + "<b>" * 30_000 + "<hr>" * 30_000,
    ],
    ids=range(13),
)
def test_broken_markup_takes_linear_time(page):
    began = time.perf_counter()
    extraction.main_text(page)
    # A second on an idle machine, most of them far below.
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("cut", ["<", "<a", "<a href", '<a href="x', "<!-- x", "</", "</a", "<p class='x"])
def test_a_page_that_is_cut_off_keeps_what_came_before(cut):
    assert extraction.main_text(f"<article>{P}{P}{cut}") in (f"{TEXT}\n\n{TEXT}", f"{TEXT}\n\n{TEXT}\n\n{cut}")


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<body class="has-sidebar">{P}{P}</body>', f"{TEXT}\n\n{TEXT}"),
        (f'<article class="post category-legal">{P}{P}</article>', f"{TEXT}\n\n{TEXT}"),
        (f'<article><div class="entry-header"><h1>The title of it</h1></div>{P}</article>', f"The title of it\n\n{TEXT}"),
        (f'<article><p>Some <a href="/hidden/x">linked words</a> and many more of them in a line.</p>{P}</article>', f"Some linked words and many more of them in a line.\n\n{TEXT}"),
        (f'<article><p title="the hidden side">Words.</p>{P}</article>', f"Words.\n\n{TEXT}"),
        (f'<article data-hidden="false">{P}</article>', TEXT),
        (f"<article>{P}<svg-icon>x</svg-icon>{P}</article>", f"{TEXT}\n\nx\n\n{TEXT}"),
        (f'<article>{P}<svg width="3"/>{P}</article>', f"{TEXT}\n\n{TEXT}"),
        (f"<article>{P}<svg><title>t</title><path/></svg>{P}</article>", f"{TEXT}\n\n{TEXT}"),
        (f"<article><title-bar>Head of it</title-bar>{P}</article>", f"Head of it\n\n{TEXT}"),
        (f"<article>{P}<p hidden>never shown</p></article>", TEXT),
        (f'<article>{P}<p style="Display : none; color:red">never shown</p></article>', TEXT),
        (f"<article>{P}</article><section><h2>3 Comments</h2><div>{P}</div><div><p>I like it.</p></div></section>", TEXT),
        (f'<article>{P}</article><div id="post-comments"><ol><li>{P}</li></ol></div>', TEXT),
        (f'<div class="site-footer"><p>All rights reserved here.</p></div><main>{P}</main>', TEXT),
    ],
)
def test_names_speak_but_do_not_decide(page, text):
    assert extraction.main_text(page) == text


def _brute_blocks(page):
    """Blocks of the generated pages below: every leaf is `<p>`, `<h2>` or `<li>` with plain words."""
    found, path, numbers, number = [], [], [0], 0
    shared = 0
    for part in page.replace("<", "\n<").replace(">", ">\n").split("\n"):
        if part.startswith("</"):
            path.pop()
            shared = min(shared, len(path))
        elif part.startswith("<"):
            number += 1
            path.append((part[1:-1], number))
        elif part:
            parent = path[-2][1] if len(path) > 1 else 0
            found.append((part, path[-1][0], parent, len(path), shared))
            shared = len(path)
    return found


def _random_page(pick, depth=0):
    if depth > 3 or pick.random() < 0.4:
        tag = pick.choice(["p", "h2", "li"])
        return f"<{tag}>{' '.join(['word'] * pick.randrange(1, 30))}{pick.choice(['', '.'])}</{tag}>"
    tag = pick.choice(["div", "section", "article", "nav", "ul"])
    return f"<{tag}>" + "".join(_random_page(pick, depth + 1) for _ in range(pick.randrange(1, 5))) + f"</{tag}>"


def test_blocks_costs_and_edges_equal_brute_force():
    pick = random.Random(8)
    for _ in range(200):
        page = _random_page(pick)
        # A list item directly in a list item's place ends the open one; keep only plain nesting.
        found = extraction.blocks(page)
        want = _brute_blocks(page)
        assert [(b.text, b.tag, b.parent, b.depth, b.shared) for b in found] == want
        joined = set()
        for k in range(1, len(want)):
            near = extraction.NEAR * want[k][4] // max(want[k - 1][3], want[k][3])
            if near:
                joined.add((k - 1, k, near))
            before = [i for i in range(k) if want[i][2] == want[k][2]]
            if before:
                joined.add((before[-1], k, extraction.KIN))
        assert set(extraction.edges(found)) == joined
        for block in found:
            words = len(block.text.split())
            content = block.good + min(12, words // 4) + (4 if block.tag in ("p", "h2") else 0)
            content += 2 if block.text.endswith(".") else 0
            assert extraction.costs(block) == (content, block.bad + (2 if words < 5 else 0))


# Tokens


@pytest.mark.parametrize("unit", [" ", "\n", "\t", "a", " ", "é", "!"])
def test_long_runs_equal_the_library(unit):
    mine, library = packing.ByteTokens(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    for text in (unit * 300_000 + "b", "b " + unit * 999 + " c", "b" + unit * 1_001):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == want


def test_caches_are_bounded_by_bytes_and_change_nothing(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_BYTES", 3_000)
    monkeypatch.setattr(bpe, "KEPT_BYTES", 3_000)
    mine, library = packing.ByteTokens(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    words = [f"word{k % 40} {'漢字' * k}x" for k in range(200)]
    for text in words:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == want
    assert len(mine) < 40
    path = public_tokenizers.path("word_bpe_49k.json")
    merged, library = bpe.WordBpe(path), Tokenizer.from_file(path)
    for text in words:
        ids, _ = merged.encode_all([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(merged.chunks) < 40


# Languages


def test_a_rare_language_beside_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(langid, "WORDS", 400)
    monkeypatch.setattr(langid, "LEAST_WORDS", 50)
    monkeypatch.setattr(langid, "GRAMS", 1_200)
    monkeypatch.setattr(langid, "LEAST_GRAMS", 40)
    pick = random.Random(4)
    rows = [(k, " ".join(f"{pick.choice('kmprst')}{pick.choice('aeiou')}" * 2 + pick.choice("lnrst") + str(k % 7) for _ in range(9)) + " " + "".join(pick.choices("abcdefgh", k=8)), "xx") for k in range(1500)]
    rare = "zwyq vqix xuyz wzqo yxvu".split()
    rows += [(5000 + k, " ".join(pick.choice(rare) for _ in range(6)), "rr") for k in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table)
    assert model.languages == ["rr", "xx"]
    assert model.identify("zwyq vqix yxvu")[0] == "rr" and model.identify("zwyqu vqi")[0] == "rr"
    assert model.identify(rows[3][1])[0] == "xx"


def test_copies_count_once_and_do_not_push_others_out(spark):
    rows = [(k, "same text again", "aa") for k in range(3000)]
    rows += [(4000 + k, f"kol tam resh {'abcdefghij'[k]}o", "aa") for k in range(10)] + [(5000, "vuri nost", "bb")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(table, sample=100)
    same, kol = dict(model.words.seen["same"]), dict(model.words.seen["kol"])
    assert same[0] < kol[0]  # once against ten times
    assert model.identify("vuri")[0] == "bb"


def test_language_of_ties_long_texts_and_clashing_columns(spark):
    rows = [(1, "kol tam", "aa", 1), (2, "kol tam", "bb", 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.train(table)
    asked = spark.createDataFrame(
        [(1, "kol", "x", 1), (2, "kol " * 200_000, "x", 1), (None, "tam", "x", 1), (3, None, "x", 1)],
        "doc_id long, text string, lang_pred string, score int",
    )
    got = langid.identify_languages(asked, model).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, "aa"), (2, "aa"), (None, "aa"), (3, "und")]
    assert abs(got[0].score - 0.5) < 1e-9
    assert langid.identify_languages(asked.where("false"), model).count() == 0


def test_sampling_does_not_depend_on_how_sizes_are_joined(spark, monkeypatch):
    rows = [(k, f"kol tam {k % 90} re{'sh' * (k % 7)}", "ab"[k % 2]) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sent = langid.train(table, sample=30)
    monkeypatch.setattr(langid, "SENT", 0)
    joined = langid.train(table, sample=30)
    assert sent.languages == joined.languages and sent.words.seen == joined.words.seen
