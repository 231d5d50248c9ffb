"""The registered queries themselves: against their SQL, or the library and brute force, on the smallest tables."""

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from checks.compare import connect, differences
from lakesearch.llm import extraction, queries
from tests.llm.test_dedup import brute_components, brute_print

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    return connect(FOLDER)


@pytest.fixture(scope="module")
def documents(connection) -> list[tuple]:
    return connection.execute("SELECT doc_id, text, lang FROM documents").fetchall()


def run(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, FOLDER).collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, connection, name):
    assert differences(spark, connection, FOLDER, name, queries.QUERIES, queries.ORACLE) == []


def library(file):
    found = Tokenizer.from_file(public_tokenizers.path(file))
    found.no_truncation()
    found.no_padding()
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def remainder(doc_id, divisor):
    return zlib.crc32(str(doc_id).encode()) % divisor


def test_op2(spark, documents):
    rows = {r["doc_id"]: r for r in run(spark, "op2_backoff_language")}
    assert len(rows) == len(documents)
    languages = {lang for _, _, lang in documents if lang}
    right = []
    for i, text, lang in documents:
        r = rows[i]
        assert r["held_out"] == (remainder(i, 4) == 2) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in text or ""):
            assert r["lang_pred"] == "und"
            continue
        assert r["lang_pred"] in languages
        if r["held_out"] and lang:
            right.append(r["lang_pred"] == lang)
    assert sum(right) >= 0.95 * len(right) > 0


def test_op3(spark, documents):
    rows = run(spark, "op3_counterfactual_toxicity")
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, *_ in documents)
    for r in rows:
        assert r["held_out"] == (remainder(r["doc_id"], 5) == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op4(spark, documents):
    encode = library("byte_bpe_50k.json")
    rows = run(spark, "op4_genetic_packing")
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(pieces) == len(rows)
    for i, text, _ in documents:
        ids, at, k = np.array([*encode(text), 2], "<u4"), 0, 0
        while at < len(ids):
            r = pieces.pop((i, k))
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at, k = at + r["length"], k + 1
    assert not pieces
    fill: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 1024
    assert len(fill) <= 1.02 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_op5(spark, connection):
    pages = connection.execute("SELECT page_id, url, html FROM pages").fetchall()
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in run(spark, "op5_mincut_extraction")}
    assert got == {(i, u): (t, len(t)) for i, u, t in ((i, u, extraction.main_text(h)) for i, u, h in pages)}
    assert sum(bool(t) for t, _ in got.values()) > 0.9 * len(pages)


def test_op7(spark, documents):
    prints = [(i, brute_print(t)) for i, t, _ in documents]
    rows = {r["doc_id"]: r for r in run(spark, "op7_simhash_trie")}
    assert {i: r["fingerprint"] for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints}
    labels = brute_components(prints)
    assert {i: r["component_id"] for i, r in rows.items()} == {i: c for (i, _), c in zip(prints, labels)}


def test_op9_and_op12(spark, documents):
    encode = library("word_bpe_49k.json")
    decode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).decode
    ids = {i: encode(t) for i, t, _ in documents}
    for r in run(spark, "op9_numpy_bpe"):
        own = ids[r["doc_id"]]
        assert r["n_tokens"] == len(own)
        assert r["ids_sha256"] == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decode(own, skip_special_tokens=False).encode()).hexdigest()
    at = 0
    found = {r["doc_id"]: r for r in run(spark, "op12_arrow_token_files")}
    for i in sorted(ids):
        own = np.array([*ids[i], 1], "<u4")
        assert found[i] == {"doc_id": i, "start": at, "n_tokens": len(own), "ids_crc32": zlib.crc32(own.tobytes())}
        at += len(own)


def test_op10(spark, documents):
    words = {i: (t or "").encode().split() for i, t, _ in documents}
    seen: dict[tuple, int] = {}
    for w in words.values():
        for k in range(len(w) - 34):
            key = tuple(w[k : k + 35])
            seen[key] = seen.get(key, 0) + 1
    rows = {r["doc_id"]: r for r in run(spark, "op10_superkmer_dedup")}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert rows[i] == {
            "doc_id": i, "n_words": len(w), "n_removed": len(gone), "kept_sha256": hashlib.sha256(kept).hexdigest()
        }


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Empty documents; null ids and texts; columns whose names the stages use inside."""
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, k1 long, block int, h long"
    rows = [(None, None, None, None, None, 1, 1, 1), (None, "a text without an id " * 9, "en", "s", 3, 1, 1, 1), (1, "", "en", "s", 0, 1, 1, 1), (2, " \n" * 50, "en", "s", 0, 1, 1, 1)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, table in (("odd", spark.createDataFrame(rows, schema)), ("none", spark.createDataFrame([], schema))):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        done = pipeline.run(spark, folder)
        assert done.columns[:2] == ["doc_id", "piece"]
        assert done.count() == (0 if name == "none" else done.select("doc_id", "piece").distinct().count())
