"""BPE with word ends, encoding and decoding, by numpy merge rounds over many words at once.

Method. The symbols of all new words of a batch stand in one flat array. In each round the ranks of all
neighbouring pairs are found by binary search over the sorted pair keys; every word merges its pair of
lowest rank, wherever it occurs (a merged symbol only takes part in pairs of higher rank, so all
places of the lowest pair come first in any order); only pairs with a new symbol are searched again.
Words without a pair left leave the array. Ids and decoded texts of words and chunks that a worker has
met are kept; when they outgrow `KEPT_BYTES`, those go that were not met again since the last time.

Text is prepared as the vocabulary file says: NFC, white space folded, letters lower-cased, split into
contractions, runs of letters, single digits and runs of other characters. Special tokens in
a text are taken out before that and keep their ids.
"""

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lakesearch.llm.packing import byte_letters

#: Fixed value: the split pattern of the vocabulary file.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same for lower-case ASCII.
_SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Control characters that str.split takes for white space, unlike the pattern, and letters beyond
#: Latin, where versions of Unicode differ: the library itself prepares and splits such texts.
_ODD = re.compile("[\x1c-\x1f\u0250-\U0010ffff]").search
_SEPARATORS = re.compile("[\x1c-\x1f]").search
#: Bytes of chunks and words, with their ids and decoded texts, that a Python worker keeps.
KEPT_BYTES = 160 << 20
_ENTRY = 250  # bytes of a dictionary entry and its objects, about
#: Characters of text that are encoded together.
TOGETHER = 1_000_000
#: Little-endian 32-bit ids, and the decoded text with a blank behind every token.
Encoded = tuple[bytes, bytes]


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        vocab: dict[str, int] = stored["model"]["vocab"]
        suffix = stored["model"]["end_of_word_suffix"]
        self.tokens = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        for token, i in self.special.items():
            self.tokens += [""] * (i + 1 - len(self.tokens))
            self.tokens[i] = token
        letters = byte_letters()
        self.byte_of = {c: b for b, c in letters.items()}
        self.library = Tokenizer.from_file(path)
        self.inner = np.array([vocab[letters[b]] for b in range(256)])
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)])
        left, right, made = [], [], []
        for a, b in stored["model"]["merges"]:
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(vocab[a + b])
        self.width = len(self.tokens)
        keys = np.array(left, np.int64) * self.width + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.made = np.array(made, np.int64)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.shown = [t.encode() + b" " for t in self.tokens]
        self.shown_sizes = np.array([len(t) for t in self.shown])
        # Chunks and words met before; older ones are those not met since the last clearing.
        self.chunks: dict[str, Encoded] = {}
        self.older: dict[str, Encoded] = {}
        self.words: dict[bytes, Encoded] = {}
        self.held = 0

    # Merging

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (none empty) in a row, and how many each has, by rounds over all."""
        lengths = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        owner = np.repeat(np.arange(len(words)), lengths)
        ranks = self._pair_ranks(symbols, owner, np.arange(len(symbols)))
        none = len(self.made)
        done = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            lows = np.repeat(lowest, sizes)
            going = lows < none
            if not going.all():
                done.append((owner[~going], symbols[~going]))
                symbols, owner, ranks, lows = symbols[going], owner[going], ranks[going], lows[going]
                if not len(symbols):
                    break
            hit = ranks == lows
            if (hit[1:] & hit[:-1]).any():
                # Of overlapping places (equal symbols in a row) every second one, from the left.
                at = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), at, 0))
                hit &= (at - run) % 2 == 0
            symbols[hit] = self.made[ranks[hit]]
            stays = ~np.append(False, hit[:-1])
            symbols, owner, ranks, hit = symbols[stays], owner[stays], ranks[stays], hit[stays]
            # Only pairs with a new symbol have a new rank.
            touched = hit | np.append(hit[1:], False)
            self._set_ranks(ranks, symbols, owner, np.flatnonzero(touched))
        owners = np.concatenate([o for o, _ in done])
        order = np.argsort(owners, kind="stable")
        ids = np.concatenate([s for _, s in done])[order]
        return ids, np.bincount(owners, minlength=len(words))

    def _pair_ranks(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        ranks = np.empty(len(symbols), np.int64)
        self._set_ranks(ranks, symbols, owner, at)
        return ranks

    def _set_ranks(
        self, ranks: np.ndarray, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray
    ) -> None:
        """Ranks of the pairs that start at the places `at`; the number of merges for no such pair."""
        none = len(self.made)
        ranks[at] = none
        at = at[: np.searchsorted(at, len(symbols) - 1)]
        at = at[owner[at] == owner[at + 1]]
        keys = symbols[at] * self.width + symbols[at + 1]
        place = np.minimum(np.searchsorted(self.keys, keys), none - 1)
        found = self.keys[place] == keys
        ranks[at[found]] = self.ranks[place[found]]

    # Texts

    def parts(self, text: str) -> list[list[str]]:
        """Chunks of a text, in one list per stretch between special tokens; those are lists of
        their own, marked by a leading empty string."""
        stretches = self.cut(text) if any(s in text for s in self.special) else [text]
        return [["", s] if s in self.special else self._chunks(s) for s in stretches]

    def _chunks(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        elif _ODD(text):
            text = self.library.normalizer.normalize_str(text)
        else:
            text = unicodedata.normalize("NFC", text).lower()
        return [text] if _SEPARATORS(text) else text.split()

    def _words(self, chunk: str) -> list[bytes]:
        if chunk.isascii() and chunk.isalpha():
            return [chunk.encode()]
        if _ODD(chunk):
            split = self.library.pre_tokenizer.pre_tokenize_str(chunk)
            return [bytes([self.byte_of[c] for c in word]) for word, _ in split]
        split = _SPLIT_ASCII if chunk.isascii() else SPLIT
        return [w.encode() for w in split.findall(chunk)]

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks that are new, all together."""
        if self.held > KEPT_BYTES:
            self.older, self.chunks, self.words, self.held = self.chunks, {}, {}, 0
        new, split = [], []
        for chunk in chunks.difference(self.chunks):
            known = self.older.get(chunk)
            if known is None:
                new.append(chunk)
                split.append(self._words(chunk))
            else:
                self.chunks[chunk] = known
                self.held += len(chunk) + len(known[0]) + len(known[1]) + _ENTRY
        self._learn_words({w for parts in split for w in parts}.difference(self.words))
        words, size = self.words, 0
        for chunk, parts in zip(new, split):
            if len(parts) == 1:
                value = words[parts[0]]  # shared with the word
            else:
                found = [words[w] for w in parts]
                value = b"".join([ids for ids, _ in found]), b"".join([shown for _, shown in found])
                size += len(value[0]) + len(value[1])
            self.chunks[chunk] = value
            size += len(chunk)
        self.held += size + _ENTRY * len(new)

    def _learn_words(self, new: set[bytes]) -> None:
        if not new:
            return
        words = list(new)
        ids, sizes = self.merge(words)
        packed = ids.astype("<u4").tobytes()
        shown = b"".join([self.shown[i] for i in ids.tolist()])
        id_ends = np.cumsum(sizes)
        shown_ends = np.cumsum(self.shown_sizes[ids])[id_ends - 1]
        a = b = 0
        for word, c, d in zip(words, (4 * id_ends).tolist(), shown_ends.tolist()):
            self.words[word] = packed[a:c], shown[b:d]
            a, b = c, d
        self.held += len(packed) + len(shown) + sum(map(len, words)) + _ENTRY * len(words)

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids (little-endian 32-bit) and decoded text, in UTF-8, of each text."""
        parted = [self.parts(t) for t in texts]
        self.learn(set().union(*[p for parts in parted for p in parts if not p or p[0]]))
        return [self._join(parts) for parts in parted]

    def _join(self, parts: list[list[str]]) -> tuple[bytes, bytes]:
        found: list[Encoded] = []
        for part in parts:
            if part and not part[0]:
                i = self.special[part[1]]
                found.append((i.to_bytes(4, "little"), self.shown[i]))
            else:
                found += map(self.chunks.__getitem__, part)
        return b"".join([ids for ids, _ in found]), b"".join([shown for _, shown in found])[:-1]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One per Python worker: later tasks find the chunks of earlier ones."""
    return WordBpe(path)


def _together(texts: pd.Series) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids. The vocabulary has no decoder, so decoded tokens stand apart by
    blanks, word ends included. Other columns are ignored, repeated rows repeated, an empty table
    gives an empty result.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            out = []
            for texts in _together(batch["text"]):
                for ids, decoded in bpe.encode_all(texts):
                    out.append(
                        (
                            len(ids) // 4,
                            hashlib.sha256(ids).hexdigest(),
                            hashlib.sha256(decoded).hexdigest(),
                        )
                    )
            frame = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield frame

    return docs.select("doc_id", "text").mapInPandas(
        encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
