"""Best-fit packing of documents into training sequences by a grouping genetic algorithm.

Method. Documents become token pieces; full pieces fill a sequence each. The others are packed in
blocks of up to `BLOCK` pieces. Every block is evolved on several islands, each with a population of
whole packings: crossover injects well-filled bins of one parent into the other, takes out the bins that
now hold a piece twice, and puts the displaced pieces back by best fit, largest first. Between epochs
each island's elite packing migrates to the next island (a shuffle of packings, not of documents). The
best packing of a block wins. An island whose best packing meets the lower bound stops at once; epochs
go on while the last `PATIENCE` of them lowered the number of sequences.

Pieces with slack left over get a second chance in other company: the bins that are not full are taken
apart, their pieces dealt into new blocks across the table, and packed again, until that gains nothing or
their number of sequences is the least that their ids fill.
"""

import random
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesearch.session import cut_lineage

CAPACITY = 1024
END = 2
BLOCK = 32_768
ISLANDS = 3
POPULATION = 4
CROSSOVERS = 6
#: Epochs that may pass without a gain before the evolution ends.
PATIENCE = 1
#: Rows of states (some MB each) that one task evolves, about.
STATES = 12
#: Bytes of chunks and ids that a task keeps.
KEPT_BYTES = 28 << 20
_ENTRY = 200  # bytes of a dictionary entry and its two objects, about
#: A run of white space of so many characters goes through the tokenizer itself.
LONG_BLANK = 1_000
#: Fixed value: the split pattern of byte-level BPE files with `use_regex`.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


# Tokens


class ByteTokens(dict):
    """Ids of a byte-level BPE file as little-endian 32-bit bytes, for whole texts.

    A text is cut at single blanks, where the tokenizer's own pattern always cuts; ids of such
    chunks are kept, up to `KEPT_BYTES`: then those go that were not met again since the last time. They
    come from the same vocabulary as ranks, which is faster for short strings.
    Texts with runs of white space, which the pattern treats as a whole, go through uncut; texts with
    special tokens or very long runs of one kind go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import json
        import re

        from tiktoken import Encoding
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        byte_of = {c: b for b, c in byte_letters().items()}
        vocab = stored["model"]["vocab"]
        ranks = {
            bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special
        }
        made = [vocab["".join(pair)] for pair in stored["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("the file's ids do not follow its merges")
        self.special = list(special)
        self.ranked = Encoding(
            "ranked", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.runs = re.compile(r"\s\s|\s\Z|\x00").search
        # The faster library looks ahead through such runs with a stack of its own, and fails on it.
        self.long_blank = re.compile(rf"\s{{{LONG_BLANK}}}").search
        self.older: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, chunk: str) -> bytes:
        value = self.older.get(chunk)
        if value is None:
            value = array("I", self.ranked.encode_ordinary(chunk)).tobytes()
        self.held += len(chunk) + len(value) + _ENTRY
        if self.held > KEPT_BYTES:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self[chunk] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.older, self.held = {}, 0

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or self.long_blank(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if self.runs(text):
            return array("I", self.ranked.encode_ordinary(text)).tobytes()
        return b"".join([self[c] for c in text.replace(" ", "\x00 ").split("\x00")])


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> ByteTokens:
    """One per Python worker: the tables are built once, the chunks go with the task."""
    return ByteTokens(path)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def cut_points(total: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones, the first perhaps shorter."""
    first = total % CAPACITY or CAPACITY
    return [(0, first)] + [(s, CAPACITY) for s in range(first, total, CAPACITY)]


def token_pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; an end id closes each document."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = byte_tokens(tokenizer)
        end = array("I", [END]).tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = tokens.encode(text or "") + end
                for k, (start, length) in enumerate(cut_points(len(ids) // 4)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    out.append((doc_id, k, start, length, crc))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame
        tokens.forget()

    return docs.select("doc_id", "text").mapInPandas(
        pieces, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


# One block


def lower_bound(lengths: np.ndarray) -> int:
    """No packing has fewer bins: total size, and for each k the pieces too large to share."""
    counts = np.bincount(lengths, minlength=CAPACITY + 1)
    sizes = np.arange(CAPACITY + 1)
    best = -(-int(lengths.sum()) // CAPACITY)
    upto, mass = np.cumsum(counts), np.cumsum(counts * sizes)
    half = CAPACITY // 2
    for k in range(1, half + 1):
        alone = int(upto[CAPACITY] - upto[CAPACITY - k])  # larger than CAPACITY - k
        large = int(upto[CAPACITY - k] - upto[half])
        room = large * CAPACITY - int(mass[CAPACITY - k] - mass[half])
        small = int(mass[half] - mass[k - 1])
        best = max(best, alone + large + max(0, -(-(small - room) // CAPACITY)))
    return best


def best_fit(order: list[int], lengths: list[int], bins: list[int], slack: list[int]) -> None:
    """Put pieces, in `order`, where the least room is left; opens bins as needed.

    `bins` gets the bin of each piece; `slack` the room of each bin, new ones at its end.
    """
    open_bins: list[list[int]] = [[] for _ in range(CAPACITY + 1)]
    mask = 0
    for b, room in enumerate(slack):
        if 0 < room:
            open_bins[room].append(b)
            mask |= 1 << room
    for p in order:
        size = lengths[p]
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                mask ^= 1 << room
        else:
            room, b = CAPACITY, len(slack)
            slack.append(CAPACITY)
        bins[p] = b
        room -= size
        slack[b] = room
        if room:
            open_bins[room].append(b)
            mask |= 1 << room


class Island:
    """A population of packings of one block."""

    def __init__(self, lengths: np.ndarray, seed: int):
        self.lengths = lengths
        self.list = lengths.tolist()
        self.random = np.random.default_rng(seed)
        self.bound = lower_bound(lengths) if len(lengths) else 0
        self.members: list[np.ndarray] = []

    def start(self) -> None:
        noise = 0.0
        while len(self.members) < POPULATION and not self.done():
            keys = self.lengths * (1 + noise * self.random.standard_normal(len(self.lengths)))
            self.members.append(self._filled(np.argsort(-keys, kind="stable"), None, None))
            noise += 0.02

    def fitness(self, bins: np.ndarray) -> tuple[int, int]:
        """Fewer bins first; then fuller ones, by the sum of squares."""
        fill = np.bincount(bins, weights=self.lengths)
        fill = fill[fill > 0].astype(np.int64)
        return -len(fill), int((fill * fill).sum())

    def best(self) -> np.ndarray:
        return max(self.members, key=self.fitness)

    def done(self) -> bool:
        return bool(self.members) and -self.fitness(self.best())[0] <= self.bound

    def evolve(self, crossovers: int) -> None:
        for _ in range(crossovers):
            if self.done() or len(self.members) < 2:
                return
            a, b = self.random.choice(len(self.members), 2, replace=False)
            child = self.cross(self.members[a], self.members[b])
            self.members.append(child)
            worst = min(range(len(self.members)), key=lambda i: self.fitness(self.members[i]))
            self.members.pop(worst)

    def cross(self, taker: np.ndarray, giver: np.ndarray) -> np.ndarray:
        fill = np.bincount(giver, weights=self.lengths)
        full = np.flatnonzero(fill >= 0.995 * CAPACITY)
        if not len(full):
            full = np.argsort(-fill)[:1]
        share = self.random.uniform(0.1, 0.4)
        taken = np.zeros(len(fill), bool)
        taken[self.random.permutation(full)[: max(1, int(share * len(full)))]] = True
        injected = taken[giver]
        broken = np.zeros(int(taker.max()) + 1, bool)
        broken[taker[injected]] = True
        # Also open some of the bins with the most room, so that displaced pieces find new company.
        room = CAPACITY - np.bincount(taker, weights=self.lengths, minlength=len(broken))
        loose = np.argsort(-room)[: max(1, len(room) // 20)]
        broken[loose] = True
        displaced = broken[taker] & ~injected
        child = np.where(injected, giver + len(broken), taker)
        child[displaced] = -1
        order = np.flatnonzero(displaced)
        order = order[np.argsort(-self.lengths[order], kind="stable")]
        return self._filled(order, child, ~displaced)

    def _filled(self, order: np.ndarray, bins, placed) -> np.ndarray:
        if bins is None:
            start, slack = [-1] * len(self.list), []
        else:
            _, renamed = np.unique(bins[placed], return_inverse=True)
            bins = bins.copy()
            bins[placed] = renamed
            used = np.bincount(renamed, weights=self.lengths[placed]).astype(np.int64)
            start, slack = bins.tolist(), (CAPACITY - used).tolist()
        best_fit(order.tolist(), self.list, start, slack)
        return np.array(start, np.int32)


def _epoch(states: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Evolve the islands in `states`; a new one (no packings) starts its population."""
    for batch in states:
        out = []
        for block, island, epoch, lengths, packings in zip(
            batch["block"], batch["island"], batch["epoch"], batch["lengths"], batch["packings"]
        ):
            lengths = np.asarray(lengths, np.int64)
            here = Island(lengths, zlib.crc32(f"{block} {island} {epoch}".encode()))
            here.members = [np.asarray(p, np.int32) for p in packings]
            if not here.members:
                here.start()
            here.evolve(CROSSOVERS)
            ranked = sorted(here.members, key=here.fitness, reverse=True)
            score = here.fitness(ranked[0])
            out.append(
                (block, island, epoch + 1, lengths, [r for r in ranked], -score[0], score[1], here.done())
            )
        yield pd.DataFrame(
            out,
            columns=["block", "island", "epoch", "lengths", "packings", "n_bins", "squares", "done"],
        )


_STATE = (
    "block long, island int, epoch int, lengths array<int>, packings array<array<int>>, "
    "n_bins int, squares long, done boolean"
)


def _placed(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bin, offset in it, and fill of it, for each piece of a block."""
    for batch in blocks:
        out = []
        for lengths, bins in zip(batch["lengths"], batch["best"]):
            lengths, bins = np.asarray(lengths, np.int64), np.asarray(bins, np.int64)
            order = np.argsort(bins, kind="stable")
            before = np.cumsum(lengths[order]) - lengths[order]
            first = np.zeros(len(order), bool)
            first[:1] = True
            first[1:] = bins[order][1:] != bins[order][:-1]
            base = np.maximum.accumulate(np.where(first, before, 0))
            offsets = np.empty_like(before)
            offsets[order] = before - base
            fill = np.bincount(bins, weights=lengths).astype(np.int64)
            out.append((bins, offsets, fill[bins]))
        frame = batch[["block", "pieces"]].copy()
        frame["bins"], frame["offsets"], frame["fills"] = [list(x) for x in zip(*out)] or ([], [], [])
        yield frame


def _bins(states: DataFrame) -> tuple[int, int]:
    """Sequences of the best packings of all blocks, and of those that may be packed better."""
    best = states.groupBy("block").agg(F.min("n_bins").alias("n"), F.max("done").alias("done"))
    total = best.agg(F.sum("n"), F.sum(F.when(~F.col("done"), F.col("n")))).first()
    return total[0] or 0, total[1] or 0


def evolve_blocks(blocks: DataFrame, count: int, turn: int = 0) -> DataFrame:
    """`blocks` (block, lengths), `count` of them, with the best packing of each: (block, best).

    `turn` makes another round's random choices others.
    """
    states = blocks.select(
        "block",
        F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
        F.lit(turn * 1_000).alias("epoch"),
        "lengths",
        F.array().cast("array<array<int>>").alias("packings"),
    )
    tasks = max(ISLANDS, count * ISLANDS // STATES)
    spread = states.repartition(tasks, "block", "island")
    states = cut_lineage(spread.mapInPandas(_epoch, _STATE))
    finished, waited = [], 0
    open_bins = _bins(states)[1]
    while open_bins and waited < PATIENCE:
        solved = states.where("done").select("block").distinct()
        finished.append(states.join(solved, "block", "left_semi"))
        going = states.join(solved, "block", "left_anti")
        # The elite packing migrates to the next island of its block.
        travelling = going.select(
            "block",
            F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"),
            F.slice("packings", 1, 1).alias("guests"),
        )
        met = going.join(travelling, ["block", "island"]).select(
            "block", "island", "epoch", "lengths", F.concat("packings", "guests").alias("packings")
        )
        states = cut_lineage(met.mapInPandas(_epoch, _STATE))
        bins, still = _bins(states)
        waited = 0 if bins < open_bins else waited + 1
        open_bins = still
    for more in finished:
        states = states.unionByName(more)
    return states.groupBy("block").agg(
        F.max_by(
            F.element_at("packings", 1), F.struct(-F.col("n_bins"), "squares", "island")
        ).alias("best")
    )


# The table


def _pack_round(pieces: DataFrame, count: int, turn: int) -> DataFrame:
    """Pack pieces in blocks: piece columns, block, bin, offset and fill of its bin.

    Blocks are dealt by row number, not by id, so repeated ids spread like any others; the rows
    are read from a checkpoint, where row numbers do not change.
    """
    n_blocks = max(1, -(-count // BLOCK))
    number = F.monotonically_increasing_id()
    dealt = pieces.select(F.pmod(F.xxhash64(number), F.lit(n_blocks)).alias("block"), F.struct("*").alias("piece"))
    blocks = cut_lineage(dealt.groupBy("block").agg(F.collect_list("piece").alias("pieces")))
    sized = blocks.select(
        "block", F.transform("pieces", lambda p: p["length"].cast("int")).alias("lengths")
    )
    best = evolve_blocks(sized, n_blocks, turn)
    whole = blocks.join(best, "block").select(
        "block",
        "pieces",
        F.transform("pieces", lambda p: p["length"].cast("int")).alias("lengths"),
        "best",
    )
    kinds = dict(blocks.dtypes)
    placed = whole.mapInPandas(
        _placed,
        f"block long, pieces {kinds['pieces']}, bins array<long>, offsets array<long>, fills array<long>",
    )
    return placed.select(
        "block", F.explode(F.arrays_zip("pieces", "bins", "offsets", "fills")).alias("x")
    ).select("x.pieces.*", "block", "x.bins", "x.offsets", "x.fills")


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece of `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    A sequence holds at most 1,024 ids, gapless from offset 0. A null or empty text is one piece with
    the end id alone. Repeated ids and rows are packed once per row; other columns are ignored; an
    empty table gives an empty result.
    """
    pieces = cut_lineage(token_pieces(docs, tokenizer))
    number = F.monotonically_increasing_id()
    numbered = pieces.withColumn("number", number)
    own = numbered.where(F.col("length") == CAPACITY).select(
        *pieces.columns, (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where(F.col("length") < CAPACITY)
    done = own

    def placed_for_good(bins: DataFrame, turn: int) -> DataFrame:
        number = F.lit(turn << 54) + F.col("block") * (4 * BLOCK) + F.col("bins")
        return bins.select(
            *pieces.columns, number.alias("sequence_id"), F.col("offsets").alias("offset")
        )

    count, turn = rest.count(), 0
    held, n_held = None, 0  # the open sequences of the round before, which are packed anew
    while count:
        placed = cut_lineage(_pack_round(rest, count, turn))
        is_open = F.col("fills") < CAPACITY
        bins = placed.groupBy("block", "bins").agg(F.max("fills").alias("fills"), F.count("*").alias("n"))
        found = bins.agg(
            F.count("*").alias("bins"),
            F.count_if(is_open).alias("open"),
            F.sum(F.when(is_open, F.col("fills"))).alias("ids"),
            F.sum(F.when(is_open, F.col("n"))).alias("pieces"),
        ).first()
        if held is not None and found.bins >= n_held:
            return done.unionByName(placed_for_good(held, turn - 1))
        done = done.unionByName(placed_for_good(placed.where(~is_open), turn))
        held, n_held = placed.where(is_open), found.open
        if found.open <= -(-(found.ids or 0) // CAPACITY):
            return done.unionByName(placed_for_good(held, turn))
        rest, count, turn = held.select(*pieces.columns), found.pieces, turn + 1
    return done
