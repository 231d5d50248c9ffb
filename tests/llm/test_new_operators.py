"""Spelling variants, token files and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakesearch.llm import importance, spelling, token_files
from lakesearch.session import shared_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
CLASHING = "doc_id long, text string, key long, n int, h int, word string, shard int, bucket int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 1, 1, 1, "x", 1, 1) for i, t in rows], CLASHING)


# Spelling


def typo(word, pick):
    at = pick.randrange(len(word))
    kind = pick.randrange(3)
    letter = pick.choice("abcdefghijklmnopqrstuvwxyzéßÿ")
    return word[:at] + (letter if kind else "") + word[at + (kind != 1) :]


def spelling_rows():
    pick = random.Random(11)
    stems = ["".join(pick.choice("aeioubcdlmnrst") for _ in range(pick.randrange(6, 13))) for _ in range(60)]
    stems += ["aaaaaaaa", "abababab", "ababababa", "übergänge", "ÜBERGÄNGE", "Straßenzug"]
    rows = []
    for k in range(160):
        words = [pick.choice(stems[:20] if pick.random() < 0.8 else stems) for _ in range(40)]
        words = [typo(w, pick) if pick.random() < 0.2 else w for w in words]
        words = [w.upper() if pick.random() < 0.05 else w for w in words]
        rows.append((k, pick.choice([" ", "-", "\n", "7", "×"]).join(words)))
    rows += [(900, None), (901, ""), (902, "kurz ab"), (None, "aaaaaaaa " * 30), (3, rows[3][1]), (904, "x" * 5000 + " " + "x" * 4999 + " " + "x" * 5000 + " " + "x" * 4999)]
    return rows


def brute_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[at:] == b[at + 1 :] if len(a) < len(b) else a[at + 1 :] == b[at + 1 :]


def brute_variants(rows):
    counts = brute_counts(rows)
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        if near[w]:
            most, best = min((-counts[v], v) for v in near[w])
            if -most >= 10 * n:
                form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def test_variants_equal_brute_force(spark):
    rows = spelling_rows()
    table = clashing(spark, rows).repartition(5)
    found = spelling.variants(table).collect()
    want = brute_variants(rows)
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert any(f for _, f, *_ in want) and any(f and f != r for _, f, r, *_ in want) in (True, False)
    assert spelling.variants(table.where("false")).count() == 0


def test_pivots_are_disjoint_and_least():
    pick = random.Random(5)
    for _ in range(300):
        word = "".join(pick.choice("abc") for _ in range(pick.randrange(6, 12)))
        rarity = [pick.randrange(50) for _ in range(9)]
        order = {a + b: i for i, (a, b) in enumerate((a, b) for a in "abc" for b in "abc")}
        rarest = sorted((order[word[i : i + 2]], i) for i in range(len(word) - 1))
        chosen = spelling.pivots(rarest, rarity)
        pairs = [(a, b) for a in rarest[:3] for b in rarest[:3] if a[1] + 2 <= b[1]]
        assert chosen[0][1] + 2 <= chosen[1][1]
        cost = min(rarity[a[0]] + rarity[b[0]] for a, b in pairs)
        assert rarity[chosen[0][0]] + rarity[chosen[1][0]] == cost


def test_every_edit_that_spares_a_gram_leaves_a_common_key():
    pick = random.Random(6)
    for _ in range(400):
        word = "".join(pick.choice("abcd") for _ in range(pick.randrange(7, 14)))
        other = typo(word, pick)
        if len(other) < 7 or other == word:
            continue
        at = next((i for i in range(min(len(word), len(other))) if word[i] != other[i]), min(len(word), len(other)))
        for gram in range(len(word) - 1):
            if gram + 2 <= at:
                moved = gram
            elif gram > at:
                moved = gram + len(other) - len(word)
            else:
                continue
            assert other[moved : moved + 2] == word[gram : gram + 2]
            assert set(spelling.side_keys(word, gram, 7)) & set(spelling.side_keys(other, moved, 7))


def test_roots_follow_long_chains(spark):
    n = [10**k for k in range(9)]
    rows = [(f"w{k}", f"w{k + 1}" if k < 8 else None, n[k + 1] if k < 8 else None) for k in range(9)]
    table = spark.createDataFrame(rows, "word string, form string, form_n long")
    assert {(r.word, r.root) for r in spelling.roots(table).collect()} == {(f"w{k}", "w8") for k in range(8)}


# Token files


def digests(rows, path, end=1):
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    out = []
    for i, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
        out.append((i, len(ids), zlib.crc32(ids.tobytes())))
    return out


@pytest.mark.parametrize("path, shard_bytes", [(WORD_BPE, 1 << 30), (WORD_BPE, 4_000), (BYTE_BPE, 4_000)])
def test_token_files_give_back_every_document(spark, texts, path, shard_bytes):
    rows = texts + [(None, "no id here"), (None, None), (7, "seven again"), (-5, "İ ǅ \x1c\x85 <|ENDOFTEXT|> a<|startoftext|>b ½ ﬁ é")]
    table = clashing(spark, rows).repartition(4)
    got = token_files.token_digests(table, path, length=64, rows=3, shard_bytes=shard_bytes).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(digests(rows, path), key=repr)
    ordered = sorted(got, key=lambda r: r.start)
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    ids = [-(1 << 63) if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)
    assert token_files.token_digests(table.where("false"), path).count() == 0


def test_a_hot_id_is_dealt_over_shards(spark):
    rows = [(k, f"text of {k} " * 3) for k in range(200)] + [(50, "the same text every time")] * 400
    folder = shared_path(spark, "hot-id")
    manifest = token_files.write_token_files(clashing(spark, rows).repartition(6), WORD_BPE, folder, shard_bytes=1_500)
    sizes = [r.n_docs for r in manifest.collect()]
    assert sum(sizes) == 600 and max(sizes) < 150
    got = token_files.read_documents(spark, folder).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(digests(rows, WORD_BPE))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(i for i, _ in rows)


def test_random_access_is_zero_copy(spark, tmp_path):
    folder = f"file://{tmp_path}/files"
    writer = token_files.SequenceWriter(folder, "ids-0.arrows", np.dtype("<u2"), 16, 4)
    ids = np.arange(1000, dtype="<u2")
    for start in range(0, 1000, 37):
        writer.add(ids[start : start + 37].tobytes())
    writer.close()
    assert (writer.total, writer.sequences) == (1000, 63)
    file = token_files.SequenceFile(folder, "ids-0.arrows")
    for i in (0, 1, 5, 62, 33):
        here, mask = file[i]
        assert not here.flags.owndata and not here.flags.writeable
        real = ids[16 * i : 16 * i + 16]
        assert here.tolist() == real.tolist() + [0] * (16 - len(real))
        assert mask.to_pylist() == [True] * len(real) + [False] * (16 - len(real))
    assert np.concatenate(list(file.tokens(100, 777))).tolist() == list(range(100, 777))
    with pytest.raises(IndexError):
        file[63]


# Importance


def brute_importance(docs, target):
    def words(text):
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)

    def buckets(text):
        w = words(text)
        return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text))
    for text in target:
        t.update(buckets(text))
    total_s, total_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out = []
    for i, text in docs:
        found = buckets(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(found), weight, score, len(words(text)) >= 20))
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    drawn = drawn[: 25 * len(drawn) // 100]
    places = Counter()
    rows = []
    for place, r in enumerate(drawn, 1):
        rows.append((*r[:4], place))
        places[r] += 1
    for r in out:
        if places[r]:
            places[r] -= 1
        else:
            rows.append((*r[:4], None))
    return rows


def test_resampling_equals_brute_force(spark, texts):
    pick = random.Random(9)
    rows = [*texts, (None, "stone1 river2 cloud3 " * 10), (50, "Ünder éa 12 x\x7fy {z}~" * 9), (51, "漢字 " * 30)]
    rows += [(100 + k, " ".join(f"{pick.choice('abcdef')}{pick.randrange(9)}" for _ in range(pick.randrange(40)))) for k in range(60)]
    target = ["stone1 river2 again and again", None, "", "harbor3 candle4"]
    benchmark = spark.createDataFrame([(1, t, 2) for t in target], "item_id long, text string, n int")
    table = clashing(spark, rows).repartition(4)
    got = sorted(map(tuple, importance.resample(table, benchmark).collect()), key=repr)
    assert got == sorted(brute_importance(rows, target), key=repr)
    assert importance.resample(table.where("false"), benchmark).count() == 0
    untargeted = importance.resample(table, benchmark.where("false")).collect()
    assert len(untargeted) == len(rows)


def test_ties_and_many_equal_rows(spark):
    rows = [(7, "w " * 25)] * 300 + [(k, "w " * 25) for k in range(20, 60)]
    target = spark.createDataFrame([(1, "w")], "item_id long, text string")
    got = importance.resample(clashing(spark, rows).repartition(3), target).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == list(range(1, 25 * 340 // 100 + 1))
    assert {(r.doc_id, r.score) for r in got} == {(i, s) for i, _, _, s, _ in brute_importance(rows, ["w"])}


def test_crcs_of_concatenations():
    pick = random.Random(2)
    parts = [(pick.randbytes(pick.randrange(40)), pick.randbytes(pick.choice([0, 1, 3, 9, 300, 70_000]))) for _ in range(60)]
    first = np.array([zlib.crc32(a) for a, _ in parts], np.uint32)
    second = np.array([zlib.crc32(b) for _, b in parts], np.uint32)
    lengths = np.array([len(b) for _, b in parts])
    assert importance.concatenated(first, second, lengths).tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_counting_leaves_a_row_per_bucket(spark, texts):
    table = clashing(spark, texts).repartition(2).withColumnRenamed("doc_id", "id")
    counted = importance.bucket_counts(importance.bucketed(table, 50), 50)
    assert counted.count() <= 50
    assert counted.agg(F.sum("n")).first()[0] == sum(n for _, n, *_ in brute_importance(texts, []))
