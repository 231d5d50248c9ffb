import hashlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lakesearch.llm import components, exact_dedup, simhash, superkmers, trie
from tests.llm.conftest import prose

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_groups_equal_brute_force(docs, texts):
    normal = [(i, (t or "").translate(UPPER)) for i, t in texts]
    want = sorted(
        (
            i,
            max(j for j, u in normal if u == t),
            sum(u == t for _, u in normal),
            i == max(j for j, u in normal if u == t),
            hashlib.sha256(t.encode()).hexdigest(),
        )
        for i, t in normal
    )
    assert sorted(map(tuple, exact_dedup.exact_groups(docs).collect())) == want


def test_colliding_hashes_are_told_apart_by_their_bytes(docs):
    right = sorted(map(tuple, exact_dedup.exact_groups(docs).collect()))
    weak = exact_dedup.exact_groups(docs, lambda text: F.lit(b"same"))
    assert sorted(map(tuple, weak.collect())) == right


def test_exact_copies_go_and_columns_stay(docs, no_docs):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {21, 27 if 28 not in ids else 27}.issubset(ids) and not ids & {3, 20, 26}
    assert exact_dedup.exact_groups(no_docs).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Rows given twice, null ids and ids of several texts, through both stages and the passage cut."""
    lone, other, third = prose(501, 80), prose(502, 80), prose(503, 80)
    rows = [(1, lone), (1, lone), (None, other), (None, other), (None, third), (4, third)]
    rows += [(5, third), (5, prose(504, 80)), (6, prose(505, 80)), (6, prose(506, 80))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(1, lone), (None, other), (5, third), (5, rows[7][1]), (6, rows[8][1]), (6, rows[9][1])]
    exact = exact_dedup.drop_exact_copies(table)
    assert Counter(map(tuple, exact.collect())) == Counter(want)
    near = Counter(map(tuple, simhash.drop_near_copies(table).collect()))
    assert near == Counter([(4, third) if w == (5, third) else w for w in want])
    cut = superkmers.cut_repeats(simhash.drop_near_copies(exact))
    assert Counter(map(tuple, cut.collect())) == Counter(want)


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id reachable over links of at most four bits; ids may repeat."""
    label = [i for i, _ in prints]
    changed = True
    while changed:
        changed = False
        for a, (_, p) in enumerate(prints):
            for b, (_, q) in enumerate(prints):
                if (p ^ q).bit_count() <= 4 and label[b] > label[a]:
                    label[b], changed = label[a], True
    return label


def test_near_duplicates_equal_brute_force(docs, texts, no_docs):
    prints = [(i, brute_print(t)) for i, t in texts]
    want = sorted(
        (i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints))
    )
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, c in want if i == c}


def test_links_of_dealt_groups_lose_nothing(spark):
    """Many fingerprints in one small ball: the same components, whatever a task may hold."""
    pick = np.random.default_rng(3)
    centres = pick.integers(0, 1 << 63, 3)
    found = set()
    for c in centres:
        for _ in range(60):
            flips = pick.choice(64, pick.integers(0, 6), replace=False)
            found.add(int(c) ^ sum(1 << int(b) for b in flips))
    prints = [(k, p) for k, p in enumerate(sorted(found))]
    want = brute_components(prints)
    table = spark.createDataFrame([(simhash._signed(p),) for _, p in prints], "fp long")
    for split in (7, 1000):
        roots = {
            r.node: r.root for r in components.components(simhash.links(table, split)).collect()
        }
        mine = [roots.get(simhash._signed(p), simhash._signed(p)) for _, p in prints]
        # The same grouping, whatever the names of the groups are.
        assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_trie_pairs_equal_all_pairs():
    pick = np.random.default_rng(1)
    base = pick.integers(0, 1 << 63, 4, dtype=np.uint64)
    groups = []
    for size in (1, 2, 40, 90):
        flips = [sum(1 << int(b) for b in pick.choice(64, pick.integers(0, 5))) for _ in range(size)]
        groups.append(np.unique(base[pick.integers(0, 4, size)] ^ np.array(flips, np.uint64)))
    prints = np.concatenate(groups)
    ends = np.cumsum([len(g) for g in groups])
    starts = ends - [len(g) for g in groups]
    got = {
        (int(i), int(j))
        for a, b in trie.pairs_within(prints, starts, ends, 4)
        for i, j in zip(a, b)
    }
    want = {
        (i, j)
        for s, e in zip(starts, ends)
        for i in range(s, e)
        for j in range(i + 1, e)
        if int(prints[i] ^ prints[j]).bit_count() <= 4
    }
    assert got == want and want


def brute_repeats(texts):
    words = [(i, (t or "").encode().split()) for i, t in texts]
    seen = Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    out = []
    for i, w in words:
        covered = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                covered.update(range(k, k + 35))
        kept = b" ".join(x for k, x in enumerate(w) if k not in covered)
        out.append((i, len(w), len(covered), kept.decode()))
    return sorted(out)


def test_repeats_equal_brute_force(docs, texts, no_docs):
    want = brute_repeats(texts)
    assert sum(r[2] for r in want) > 500
    assert sorted(map(tuple, superkmers.drop_repeats(docs).collect())) == want
    # With every bucket of two strings dealt out window by window.
    assert sorted(map(tuple, superkmers.drop_repeats(docs, split=1).collect())) == want
    assert superkmers.drop_repeats(no_docs).count() == 0


def test_periodic_texts(spark):
    rows = [(k, prose(k, k) + " " + (prose(1, k) + " ") * 6) for k in range(1, 50, 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, superkmers.drop_repeats(table).collect())) == brute_repeats(rows)


def test_cut_repeats_leaves_other_texts_alone(docs, texts):
    want = {(i, t): k for (i, t), k in zip(sorted(texts, key=lambda r: (r[0], r[1] or "")), brute_repeats(texts))}
    cut = superkmers.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(texts)
    removed = {k[0]: k for k in want.values() if k[2]}
    originals = dict(texts)
    for row in cut.collect():
        if row.doc_id in removed:
            assert row.text == removed[row.doc_id][3] and row.n_chars == len(row.text)
        else:
            assert row.text == originals[row.doc_id]
