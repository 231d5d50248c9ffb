"""Token ids of documents in Arrow stream files of equal-length sequences.

Layout. A folder holds one pair of Arrow stream files per shard, and a Parquet table `manifest` with one
row per shard. Shards cut the table at quantiles of doc_id, so that shard by shard, and inside each, the
documents follow each other in ascending doc_id order. `ids-<shard>.arrows` is the shard's ids, one
document after the other, cut into sequences of equal length: every record batch has two columns of
fixed-size lists, `ids` and `mask` (true where an id belongs to a document; only the last sequence of a
shard is filled up, with id 0 and mask false). `docs-<shard>.arrows` says where each document lies.

All batches of a file but the last have the same number of bytes, so the place of sequence i is
arithmetic: a reader seeks, reads one batch, and its arrays are views of what was read, or of the mapped
file, not copies. Ids have 16 bits where the vocabulary fits.

Recovery. A task writes under a name of its own and renames the finished file, so a task that is
repeated or runs twice leaves one whole file. The manifest is written last: without it there is no table.
"""

import json
import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakesearch.llm.common import discard
from lakesearch.llm.packing import byte_letters
from lakesearch.session import shared_path

#: Ids in a sequence, sequences in a record batch, and UTF-8 bytes of text that one shard is planned for.
SEQUENCE = 2_048
BATCH = 64
SHARD_BYTES = 64 << 20
#: Bytes of chunks and ids that a Python worker keeps.
KEPT_BYTES = 128 << 20
_ENTRY = 170  # bytes of a dictionary entry and its two objects, about
#: Rows that a task encodes before it hands them on.
ROWS = 1_000
#: Control characters, and letters beyond Latin, where versions of Unicode differ: the library itself
#: prepares and splits such chunks.
_ODD = re.compile("[\x00-\x1f\x7f-\x9f\u0250-\U0010ffff]").search
_LEAST = -(1 << 63)

DOCS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


# Tokens


class ChunkTokens(dict):
    """Ids, as little-endian bytes, of chunks of UTF-8 between white space.

    Where the tokenizer drops white space before it splits, the ids of a text are those of its chunks.
    A task meets most chunks again, so their ids are kept, those of the words of new chunks too (a word by
    itself is a chunk); when they outgrow `KEPT_BYTES`, what was not met again since the last time goes.
    Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in stored["added_tokens"]) or r"\Z.")
        self.pattern = _word_pattern(stored)
        self.lowers = any(n["type"] == "Lowercase" for n in _parts(stored["normalizer"], "normalizers"))
        self.letters = byte_letters()
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def encode(self, text: bytes) -> bytes:
        if self.pattern is None:
            return self._whole(text)
        return b"".join(map(self.__getitem__, text.split()))

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self._ids(chunk)
        self.held += len(chunk) + _ENTRY
        if self.held > KEPT_BYTES:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self[chunk] = ids
        return ids

    def _ids(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if chunk.isalpha():  # ASCII letters
            word = chunk.lower() if self.lowers else chunk
            return self[word] if word != chunk else self._tokens(text)
        if _ODD(text) or self.special.search(text):
            return self._whole(chunk)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lowers:
            text = text.lower()
        if not text.isalpha():
            words = self.pattern.findall(text)
            if len(words) != 1 or words[0] != text:
                return b"".join([self[w.encode()] for w in words])
        word = text.encode()
        if word != chunk:
            return self[word]
        return self._tokens(text if text.isascii() else word.decode("latin-1").translate(self.letters))

    def _tokens(self, shown: str) -> bytes:
        return self._packed([t.id for t in self.library.model.tokenize(shown)])

    def _whole(self, text: bytes) -> bytes:
        return self._packed(self.library.encode(text.decode(), add_special_tokens=False).ids)

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.dtype.char, ids).tobytes()


def _parts(step: dict | None, key: str) -> list[dict]:
    return [] if step is None else step.get(key, [step])


def _word_pattern(stored: dict) -> "regex.Pattern | None":
    """The split pattern of a tokenizer whose chunks between white space can be encoded one by one:
    its normalizer looks at single characters, and its splitter keeps only what the pattern, which
    takes no white space, matches."""
    normal = {n["type"] for n in _parts(stored["normalizer"], "normalizers")}
    splits = _parts(stored["pre_tokenizer"], "pretokenizers")
    if not normal <= {"NFC", "Replace", "Lowercase"} or [s["type"] for s in splits] != ["Split", "ByteLevel"]:
        return None
    first, second = splits
    drops = first["behavior"] == "Removed" and first["invert"] and "Regex" in first["pattern"]
    if not drops or second["use_regex"] or second["add_prefix_space"]:
        return None
    pattern = regex.compile(first["pattern"]["Regex"])
    return pattern if pattern.findall("ab é") == ["ab", "é"] and not pattern.search(" ") else None


@lru_cache(maxsize=2)
def chunk_tokens(path: str) -> ChunkTokens:
    """One per Python worker: later tasks find the chunks of earlier ones."""
    return ChunkTokens(path)


# Shards


def _key() -> Column:
    """The order of documents: null ids first."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))


def shard_bounds(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """The doc_ids, at most one per shard, at which the ordered table is cut into shards."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    if shards == 1:
        return np.empty(0, np.int64)
    shares = [k / shards for k in range(1, shards)]
    found = docs.agg(F.percentile_approx(_key(), shares, max(10_000, 20 * shards))).first()[0]
    return np.array(found or [], np.int64)


def shard_of(keys: np.ndarray, draws: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Shard of each row. Rows of an id that is a bound several times, one that fills more than one
    shard, are dealt over these shards by `draws`."""
    low = np.searchsorted(bounds, keys, "left")
    high = np.searchsorted(bounds, keys, "right")
    # An id that is a bound once lies in the shard below it, whole.
    spread = np.maximum(high - low, 1)
    return low + draws.astype(np.uint64) % spread.astype(np.uint64)


def encoded(docs: DataFrame, tokenizer: str, end: int, bounds: np.ndarray) -> DataFrame:
    """shard, key, tie, ids (with the end id) of every row of `docs`."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = chunk_tokens(tokenizer)
        last = np.array([end], tokens.dtype).tobytes()
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            shards = shard_of(
                batch["key"].to_numpy(), batch["draw"].to_numpy().view(np.uint64), bounds
            )
            texts = batch["text"].cast(pa.binary())
            ids = [tokens.encode(text.as_py() or b"") + last for text in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shards.astype(np.int32)),
                    batch["doc_id"].cast(pa.int64()),
                    batch["tie"],
                    pa.array(ids, pa.binary()),
                ],
                names=["shard", "doc_id", "tie", "ids"],
            )

    drawn = docs.select(
        "doc_id",
        _key().alias("key"),
        F.xxhash64("text").alias("tie"),
        F.xxhash64(F.monotonically_increasing_id()).alias("draw"),
        "text",
    )
    return drawn.mapInArrow(encode, "shard int, doc_id long, tie long, ids binary")


# Files


def sequence_schema(dtype: np.dtype, length: int) -> pa.Schema:
    ids = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


class _Stream:
    """An Arrow stream file that appears under its name when it is whole."""

    def __init__(self, folder: str, name: str, schema: pa.Schema):
        self.files, base = pa.fs.FileSystem.from_uri(folder)
        self.files.create_dir(base, recursive=True)
        self.path = f"{base}/{name}"
        self.draft = f"{base}/_{uuid.uuid4().hex}-{name}"
        self.sink = self.files.open_output_stream(self.draft)
        self.writer = pa.ipc.new_stream(self.sink, schema)
        self.schema = schema

    def write(self, arrays: list[pa.Array]) -> None:
        self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        self.writer.close()
        self.sink.close()
        self.files.move(self.draft, self.path)


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them batch by batch."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, length: int, rows: int):
        self.schema = sequence_schema(dtype, length)
        self.stream = _Stream(folder, name, self.schema)
        self.dtype, self.length, self.room = dtype, length, length * rows * dtype.itemsize
        self.waiting: list[bytes] = []
        self.size = self.total = self.sequences = 0

    def add(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.size += len(ids)
        if self.size >= self.room:
            flat = b"".join(self.waiting)
            for at in range(0, self.size - self.room + 1, self.room):
                self._write(np.frombuffer(flat, self.dtype, self.room // self.dtype.itemsize, at))
            rest = flat[self.size - self.size % self.room :]
            self.waiting, self.size = [rest], len(rest)

    def _write(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        mask = np.zeros(rows * self.length, bool)
        mask[: len(ids)] = True
        filled = np.zeros(rows * self.length, self.dtype)
        filled[: len(ids)] = ids
        lists = [
            pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (filled, mask)
        ]
        self.stream.write(lists)
        self.total += len(ids)
        self.sequences += rows

    def close(self) -> None:
        if self.size:
            self._write(np.frombuffer(b"".join(self.waiting), self.dtype))
        self.stream.close()


class SequenceFile:
    """Random access to a file of sequences: `file[i]` gives the ids and the mask of sequence i.

    Batches are read where they stand, without those before. On a local file system the file is mapped
    and nothing is copied; elsewhere one batch is fetched.
    """

    def __init__(self, folder: str, name: str):
        files, base = pa.fs.FileSystem.from_uri(folder)
        path = f"{base}/{name}"
        local = isinstance(files, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else files.open_input_file(path)
        self.schema = pa.ipc.read_schema(self.source)
        self.length = self.schema.field("ids").type.list_size
        self.first = self.source.tell()
        self.rows, self.step = 0, 0
        if self._starts_a_batch():
            self.rows = self._read(self.first).num_rows
            self.step = self.source.tell() - self.first

    def _starts_a_batch(self) -> bool:
        """Not so where the stream's end mark stands at once."""
        return int.from_bytes(self.source.read(8)[4:8], "little") > 0

    def _read(self, at: int) -> pa.RecordBatch:
        self.source.seek(at)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """All ids of batch k as one array that views the file, and the mask as an Arrow array."""
        found = self._read(self.first + k * self.step)
        return found["ids"].flatten().to_numpy(), found["mask"].flatten()

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        ids, mask = self.batch(i // self.rows)
        at = i % self.rows * self.length
        if at >= len(ids):
            raise IndexError(i)
        return ids[at : at + self.length], mask.slice(at, self.length)

    def tokens(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """The ids from `start` to `stop`, as views of one batch after the other."""
        size = self.rows * self.length
        while start < stop:
            ids, _ = self.batch(start // size)
            here = ids[start % size : start % size + stop - start]
            yield here
            start += len(here)


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end: int = 1,
    length: int = SEQUENCE,
    rows: int = BATCH,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encode `docs` (doc_id, text), write the files and return the manifest: shard, n_docs, n_tokens,
    n_sequences.

    Every row is a document: a null or empty text is the end id alone, and rows given twice are written
    twice. Rows of one id stand in the order of a hash of their texts; an id that fills several shards is
    dealt over them. Rows without an id come first. Other columns are ignored. An empty table has an
    empty manifest.
    """
    bounds = shard_bounds(docs, shard_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = places = None
        starts: list[int] = []
        n_docs, at = 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if sequences is None:
                shard = batch["shard"][0].as_py()
                dtype = chunk_tokens(tokenizer).dtype
                sequences = SequenceWriter(folder, f"ids-{shard}.arrows", dtype, length, rows)
                places = _Stream(folder, f"docs-{shard}.arrows", DOCS_SCHEMA)
            sizes = []
            for ids in batch["ids"].to_pylist():
                sequences.add(ids)
                sizes.append(len(ids) // dtype.itemsize)
            starts = at + np.cumsum([0, *sizes])
            places.write([batch["doc_id"], pa.array(starts[:-1]), pa.array(sizes, pa.int64())])
            at = int(starts[-1])
            n_docs += batch.num_rows
        if sequences is not None:
            sequences.close()
            places.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "n_docs": [n_docs],
                    "n_tokens": [sequences.total],
                    "n_sequences": [sequences.sequences],
                }
            )

    rows_of = encoded(docs, tokenizer, end, bounds)
    sharded = rows_of.repartitionById(len(bounds) + 1, "shard")
    ordered = sharded.sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")
    manifest = ordered.mapInArrow(write, "shard int, n_docs long, n_tokens long, n_sequences long")
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document in the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers). One task reads one shard."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    placed = manifest.select(
        "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, earlier in zip(batch["shard"].to_pylist(), batch["before"].to_pylist()):
                yield from _documents(folder, shard, earlier)

    shards = (manifest.agg(F.max("shard")).first()[0] or 0) + 1
    return placed.repartitionById(shards, "shard").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _documents(folder: str, shard: int, earlier: int) -> Iterator[pa.RecordBatch]:
    sequences = SequenceFile(folder, f"ids-{shard}.arrows")
    size = sequences.rows * sequences.length
    held, wide = -1, np.empty(0, np.uint32)
    files, base = pa.fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{base}/docs-{shard}.arrows") as source:
        for batch in pa.ipc.open_stream(source):
            sums = []
            for start, n in zip(batch["start"].to_pylist(), batch["n_tokens"].to_pylist()):
                crc, at = 0, start
                while at < start + n:
                    if at // size != held:
                        held = at // size
                        wide = sequences.batch(held)[0].astype("<u4")
                    here = wide[at % size : at % size + start + n - at]
                    crc = zlib.crc32(here, crc)
                    at += len(here)
                sums.append(crc)
            starts = pa.array(batch["start"].to_numpy() + earlier)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], starts, batch["n_tokens"], pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def token_digests(docs: DataFrame, tokenizer: str, end: int = 1, **sizes: int) -> DataFrame:
    """What `read_documents` finds in files that are written for this and removed again."""
    spark = docs.sparkSession
    folder = shared_path(spark, "token-files")
    out = shared_path(spark, "token-digests")
    try:
        write_token_files(docs, tokenizer, folder, end, **sizes)
        found = read_documents(spark, folder)
        found.write.parquet(out)
    finally:
        discard(spark, folder)
    return spark.read.schema(found.schema).parquet(out)
