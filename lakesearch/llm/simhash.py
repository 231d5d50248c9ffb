"""SimHash near-deduplication by a self-join on binary tries.

Method. Equal fingerprints are combined first, so copies meet once. Two fingerprints that differ in
at most four bits agree on at least two of six bit ranges; each fingerprint therefore goes to one
group per pair of ranges (15 groups, about 21 bits fixed), and every link lies in some group. There
`trie.pairs_within` walks the group's trie against itself and prunes by the error budget. A task
returns a spanning forest of its links, never all pairs. `components` joins the forests.

A group with more than `SPLIT` fingerprints is dealt out: its members fall into slices, and each pair
of slices is a cell of its own, so no task gets more than two slices of one group and no link is lost.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.llm.common import one_row_each
from lakesearch.llm.components import components
from lakesearch.llm.trie import Forest, pairs_within
from lakesearch.session import cut_lineage

SHINGLE = 4
SEED = 42
BUDGET = 4
#: Lengths of the six bit ranges, from the lowest bit.
RANGES = (11, 11, 11, 11, 10, 10)
SPLIT = 20_000
#: Fingerprints that a task joins at a time; a cell that is larger is joined alone.
BATCH = 200_000


def fingerprint(text: str | None) -> int:
    """Majority bits of the shingles' XXH64, as a signed 64-bit integer.

    Words are split at ASCII white space, A-Z lower-cased; repeated shingles count each time. Fewer
    than four words are one shingle; no word (null and empty texts) gives zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        runs = zip(*(words[k:] for k in range(SHINGLE)))
        hashes = [digest(s, SEED) for s in map(b" ".join, runs)]
    values = np.array(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(values), 1 << 14):
        block = np.unpackbits(values[start : start + (1 << 14)], axis=1, bitorder="little")
        counts += block.sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, fp) of every row, and `more`; fp as a signed long. The text goes no further."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.select("doc_id", prints("text").alias("fp"), *more)


def _bands() -> list[int]:
    masks, low = [], 0
    for length in RANGES:
        masks.append(((1 << length) - 1) << low)
        low += length
    return [a | b for a, b in combinations(masks, 2)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def links(prints: DataFrame, split: int = SPLIT) -> DataFrame:
    """Links (a, b) that connect what differs in at most `BUDGET` bits; `prints` has distinct fp."""
    banded = prints.select(
        "fp",
        F.posexplode(
            F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in _bands()])
        ).alias("band", "part"),
    )
    sizes = banded.groupBy("band", "part").agg(F.count("*").alias("n"))
    hot = sizes.where(F.col("n") > split).select(
        "band", "part", F.ceil(F.col("n") / (split / 2)).cast("int").alias("slices")
    )
    mine = F.pmod(F.xxhash64("fp"), F.col("slices"))
    celled = (
        banded.join(hot, ["band", "part"], "left")
        .withColumn("mine", F.when(F.col("slices").isNull(), F.lit(0)).otherwise(mine))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
        .select(
            "band",
            "part",
            F.least("mine", "other").cast("int").alias("x"),
            F.greatest("mine", "other").cast("int").alias("y"),
            # Unsigned order, as the trie goes from the highest bit.
            F.col("fp").bitwiseXOR(F.lit(-(1 << 63))).alias("o"),
        )
    )
    cell = ["band", "part", "x", "y"]
    dealt = celled.repartition(*cell).sortWithinPartitions(*cell, "o")
    return dealt.mapInPandas(_join_cells, "a long, b long").distinct()


def _join_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    waiting: list[pd.DataFrame] = []
    held = 0
    for batch in batches:
        waiting.append(batch)
        held += len(batch)
        if held >= BATCH:
            rows = pd.concat(waiting, ignore_index=True)
            starts = _cell_starts(rows)
            last = int(starts[-1])
            if last:  # the last cell may go on in the next batch
                yield _forest(rows.iloc[:last])
                rows = rows.iloc[last:]
            waiting, held = [rows], len(rows)
    if held:
        yield _forest(pd.concat(waiting, ignore_index=True))


def _cell_starts(rows: pd.DataFrame) -> np.ndarray:
    new = np.zeros(len(rows), bool)
    new[0] = True
    for name in ("band", "part", "x", "y"):
        values = rows[name].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    starts = _cell_starts(rows)
    ends = np.append(starts[1:], len(rows))
    signed = rows["o"].to_numpy() ^ np.int64(-(1 << 63))
    prints = signed.view(np.uint64)
    several = ends - starts > 1
    forest = Forest(len(rows))
    for i, j in pairs_within(prints, starts[several], ends[several], BUDGET):
        forest.link(i, j)
    hung = np.flatnonzero(forest.root != np.arange(len(rows)))
    return pd.DataFrame({"a": signed[hung], "b": signed[forest.root[hung]]})


def _placed(reps: DataFrame) -> DataFrame:
    """(fp, root, rep) of `reps` (fp, rep); root names the component."""
    roots = components(links(reps.select("fp")))
    return reps.join(roots, reps["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "rep"
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, fingerprint (hex), component_id.

    component_id is the smallest doc_id that is reachable over links, the document's own included;
    texts without words have fingerprint zero and are linked like any others. Repeated ids and
    repeated rows are kept as they are. A null id is never a component's id unless all are null.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = cut_lineage(fingerprints(docs))
    placed = _placed(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    smallest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = placed.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return rows.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of `docs` per component, with all its columns: one that has the component's id.

    Of several texts with that id one stays, and of a row given twice only one.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = cut_lineage(fingerprints(docs, digest.alias("digest")))
    # A null id stays only where there is no other.
    rep = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    placed = _placed(rows.groupBy("fp").agg(F.min(rep).alias("rep")))
    stay = placed.groupBy("root").agg(F.min("rep").alias("rep")).select("rep.doc_id", "rep.digest")
    return one_row_each(docs, digest, stay)
