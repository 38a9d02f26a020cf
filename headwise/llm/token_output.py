"""Token ids in Arrow stream files of equal-length sequences and masks.

A folder holds, per shard,

    tokens-00000.arrows   record batches (ids: fixed_size_list<uint16>[L], mask: fixed_size_list<bool>[L])
    index-00000.arrows    record batches (doc_id: int64, start: int64, n_tokens: int64)

in Arrow's stream format; ids are uint32 for vocabularies beyond 65,536. A shard's documents
stand in ascending id order, one after another and each closed by the end id, cut into
sequences of L ids; only the last sequence is padded, with mask 0. All batches but the last have
the same number of sequences, so sequence i lies in a known batch at a known row, and a memory
map gives it without copying. `start` counts ids from the shard's beginning. `shards/` (Parquet) says what each shard holds.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwise.llm.common import byte_chunks, crc, mixed, power_tables, ship
from headwise.session import materialise

#: Ids in a sequence, sequences in a record batch, bytes of text in a shard.
LENGTH, ROWS, SHARD_BYTES = 2048, 64, 64 << 20
#: Bytes of text encoded at once.
SLICE_BYTES = 1 << 20
#: Pieces of words a Python worker remembers the ids of; beyond that it starts anew.
REMEMBERED = 1_000_000
#: Odd multipliers of the two hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_SHARDS = "shard int, n_docs long, n_tokens long"


class PieceTable:
    """Open addressing from two 64-bit hashes to a small number, for whole arrays at once.

    At most half of the slots are taken: the table doubles before keys that would take more.
    """

    def __init__(self, bits: int = 16) -> None:
        self.size = 0
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self._mask = np.uint64((1 << bits) - 1)
        self._keys = np.zeros((2, 1 << bits), np.uint64)
        self._values = np.full(1 << bits, -1, np.int32)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The numbers of keys, -1 for those not held."""
        found = np.full(len(first), -1, np.int32)
        rows, at = np.arange(len(first)), first & self._mask
        while len(rows):
            value = self._values[at]
            hit = (self._keys[0][at] == first[rows]) & (self._keys[1][at] == second[rows]) & (value >= 0)
            found[rows[hit]] = value[hit]
            on = ~hit & (value >= 0)
            rows, at = rows[on], (at[on] + np.uint64(1)) & self._mask
        return found

    def add(self, first: np.ndarray, second: np.ndarray) -> None:
        """Number different new keys from `size` on."""
        if 2 * (self.size + len(first)) > len(self._values):
            taken = np.flatnonzero(self._values >= 0)
            held, numbers = self._keys[:, taken], self._values[taken]
            self._clear((2 * (self.size + len(first)) - 1).bit_length())
            self._place(*held, numbers)
        self._place(first, second, np.arange(self.size, self.size + len(first), dtype=np.int32))
        self.size += len(first)

    def _place(self, first: np.ndarray, second: np.ndarray, numbers: np.ndarray) -> None:
        rows, at = np.arange(len(first)), first & self._mask
        while len(rows):
            free = self._values[at] < 0
            self._values[at[free]] = numbers[rows[free]]
            won = self._values[at] == numbers[rows]
            self._keys[0][at[won]], self._keys[1][at[won]] = first[rows[won]], second[rows[won]]
            rows, at = rows[~won], (at[~won] + np.uint64(1)) & self._mask


_SPACE, _LETTER, _MARK, _OTHER = range(4)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[[*b" \t\n\r"]] = _SPACE
    kinds[65:91] = kinds[97:123] = _LETTER
    kinds[[*b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = _MARK
    return kinds


class WordEncoder:
    """Ids of whole texts, by encoding each different piece of a text once.

    A text is cut at white space, and a word of plain Latin letters and ASCII marks also where
    letters and marks meet; any other word (digits, apostrophes, other scripts, control
    characters, special tokens) is one piece. Letters are lower-cased where the tokenizer
    does so itself. A tokenizer that drops white space and keeps letters and marks
    apart cuts there too, so a text's ids are its pieces' ids one after another. `cuts_alike` tests that
    on the tokenizer; where it doesn't hold whole texts are encoded.

    Pieces are found and told apart as arrays of bytes, by two hashes of 64 bits.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_file(path)
        self._cuts_alike = self.cuts_alike()
        self._lowers = self._whole("ÀÉÎÕÜÝÞß Abc") == self._whole("àéîõüýþß abc")
        self._kinds = _byte_kinds()
        self._forget()

    def cuts_alike(self) -> bool:
        """Whether white space is dropped, and letters and marks are kept apart."""
        together = self._whole("Naïve cafés, (and) more!\r\n\tx2 the--end. Straße?!")
        apart = "Naïve cafés , ( and ) more ! x2 the -- end . Straße ?!".split()
        return together == [i for piece in apart for i in self._whole(piece)]

    def _whole(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self._table = PieceTable()
        self._ids = np.zeros(1 << 20, np.uint32)
        self._ends = np.zeros(1, np.int64)  # piece i has ids[ends[i] : ends[i + 1]]

    def _learn(self, texts: list[str], first: np.ndarray, second: np.ndarray) -> None:
        found = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ends = self._ends[-1] + np.cumsum(counts)
        while ends[-1] > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._ends[-1] : ends[-1]] = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        self._ends = np.concatenate([self._ends, ends])
        self._table.add(first, second)

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, end, first hash, second hash) of the pieces."""
        kinds = self._kinds[data]
        latin = np.flatnonzero((data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] == 0xC3)) + 1
        latin = latin[(data[latin] != 0x97) & (data[latin] != 0xB7)]  # the signs for times and divided by
        kinds[latin] = kinds[latin - 1] = _LETTER
        codes = data.astype(np.uint64)
        if self._lowers:
            codes[(data >= 65) & (data <= 90)] += np.uint64(32)
            codes[latin[data[latin] < 0x9F]] += np.uint64(32)
        edges = bounds[1:-1]
        full = kinds != _SPACE
        word_start, word_end = _runs_of(full, full, edges)
        if len(word_start):
            strange = np.flatnonzero(np.maximum.reduceat(kinds, word_start) == _OTHER)
            for a, b in zip(word_start[strange].tolist(), word_end[strange].tolist()):
                kinds[a:b] = _OTHER
                codes[a:b] = data[a:b] + np.uint64(256)
        start, end = _runs_of(kinds, full, edges)
        hashes = []
        for base in _BASES:
            power, inverse = power_tables(len(data) + 1, base)
            terms = codes * power[: len(codes)]
            sums = np.cumsum(terms, dtype=np.uint64)
            hashes.append(mixed((sums[end - 1] - sums[start] + terms[start]) * inverse[start]))
        return start, end, *hashes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has)."""
        if not self._cuts_alike:
            found = [self._whole(t) if t else [] for t in texts.to_pylist()]
            counts = np.array([len(f) for f in found], np.int64)
            return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts
        parts = [self._encode_slice(data, bounds) for _, data, bounds in byte_chunks(texts, SLICE_BYTES)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode_slice(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `_encode`; a text longer than a slice is cut at white space, so that no piece is."""
        if len(bounds) != 2 or len(data) <= SLICE_BYTES:
            return self._encode(data, bounds)
        spaces, at, ids = np.flatnonzero(self._kinds[data] == _SPACE), 0, []
        while at < len(data):
            near = int(np.searchsorted(spaces, at + SLICE_BYTES))
            upto = int(spaces[near]) if near < len(spaces) else len(data)
            ids.append(self._encode(data[at:upto], np.array([0, upto - at]))[0])
            at = upto
        return np.concatenate(ids), np.array([sum(map(len, ids))])

    def _encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self._table.size > REMEMBERED:
            self._forget()
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        start, end, first, second = self._pieces(data, bounds)
        number = self._table.find(first, second)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            _, nth = np.unique(first[missing], return_index=True)
            new = missing[nth]
            texts = []
            for a, b in zip(start[new].tolist(), end[new].tolist()):
                piece = data[a:b].tobytes().decode()
                texts.append(piece.lower() if self._lowers and self._kinds[data[a]] != _OTHER and piece.isalpha() else piece)
            self._learn(texts, first[new], second[new])
            number[missing] = self._table.find(first[missing], second[missing])
            if (number[missing] < 0).any():  # equal first, unequal second hashes: not in this universe's lifetime
                raise RuntimeError("two pieces share a 64-bit hash")
        ends = self._ends
        lengths = ends[number + 1] - ends[number]
        ids, upto = _copied(self._ids, ends[number], lengths)
        at = np.searchsorted(start, bounds)
        return ids, np.diff(np.concatenate([[0], upto])[at])


def _runs_of(kinds: np.ndarray, full: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of runs of one kind where `full`, cut at edges."""
    change = np.empty(len(kinds) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:-1])
    change[edges] = True
    cuts = np.flatnonzero(change)
    start = cuts[:-1]
    inside = full[start]
    return start[inside], cuts[1:][inside]


def _copied(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of `values` copied one after another, and where each ends."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
    return values[at], ends


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker, so that words are remembered from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def id_type(tokenizer: str, end_id: int) -> np.dtype:
    """The narrower of the two types that holds all ids."""
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()
    return np.dtype(np.uint16 if max(end_id, *known) < 1 << 16 else np.uint32)


class ShardWriter:
    """Writes one shard, a batch of sequences at a time, under names of its own; `close` renames."""

    def __init__(self, folder: str, shard: int, length: int, rows: int, dtype: np.dtype) -> None:
        self._fs, self._folder = _filesystem(folder)
        self._fs.create_dir(self._folder, recursive=True)
        self._mark = f".{uuid.uuid4().hex}"
        self._names = [f"{self._folder}/{kind}-{shard:05d}.arrows" for kind in ("tokens", "index")]
        self._length, self._rows, self._dtype = length, rows, dtype
        kinds = pa.list_(pa.from_numpy_dtype(dtype), length), pa.list_(pa.bool_(), length)
        self._schema = pa.schema(list(zip(("ids", "mask"), kinds)))
        self._index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self._sinks = [self._fs.open_output_stream(name + self._mark) for name in self._names]
        self._tokens = pa.ipc.new_stream(self._sinks[0], self._schema)
        self._index = pa.ipc.new_stream(self._sinks[1], self._index_schema)
        self._left: list[np.ndarray] = []
        self._waiting = self.n_docs = self.n_tokens = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = self.n_tokens + np.cumsum(counts) - counts
        columns = [doc_ids.cast(pa.int64()), pa.array(starts), pa.array(counts)]
        self._index.write_batch(pa.RecordBatch.from_arrays(columns, schema=self._index_schema))
        self.n_docs += len(counts)
        self.n_tokens += len(ids)
        self._left.append(ids)
        self._waiting += len(ids)
        if self._waiting >= self._length * self._rows:
            self._flush(self._length * self._rows)

    def _flush(self, size: int) -> None:
        ids = np.concatenate(self._left)
        full = len(ids) // size * size
        for at in range(0, full, size):
            self._write(ids[at : at + size], size)
        self._left, self._waiting = [ids[full:]], len(ids) - full

    def _write(self, ids: np.ndarray, size: int) -> None:
        padded = np.zeros(size, self._dtype)
        padded[: len(ids)] = ids
        flat = pa.array(padded), pa.array(np.arange(size) < len(ids))
        columns = [pa.FixedSizeListArray.from_arrays(x, self._length) for x in flat]
        self._tokens.write_batch(pa.RecordBatch.from_arrays(columns, schema=self._schema))

    def close(self) -> None:
        if self._waiting:
            rest = np.concatenate(self._left)
            self._write(rest, -(-len(rest) // self._length) * self._length)
        for stream, sink, name in zip((self._tokens, self._index), self._sinks, self._names):
            stream.close()
            sink.close()
            try:
                self._fs.move(name + self._mark, name)
            except OSError:  # some stores don't rename onto a file that an earlier attempt left
                self._fs.delete_file(name)
                self._fs.move(name + self._mark, name)


def write_sequences(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    rows: int = ROWS,
    shards: int | None = None,
) -> DataFrame:
    """Encode every text into shards in `folder`; returns what each shard holds.

    A NULL or empty text is its end id alone. A row without an id comes first. Rows with the
    same id follow one another, in an order that depends on their texts alone; no limit holds
    for a text's length. Without documents there are no shards.

    Documents are dealt to shards by ranges of ids (and of a hash of the text, so that a
    repeated id can be split), each shard sorted and encoded by one task as a stream of
    batches. A task that runs again writes the same shard under another name first and
    renames it, so a lost executor leaves no half-written shard. `folder` must be seen by
    all executors.
    """
    spark = docs.sparkSession
    ship(spark)
    rows_of = docs.select(
        F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("order")
    )
    if shards is None:
        size = rows_of.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))

    dtype = id_type(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, shard = None, TaskContext.get().partitionId()
        encode = encoder(tokenizer).encode
        for batch in batches:
            for part in _slices(batch):
                writer = writer or ShardWriter(folder, shard, length, rows, dtype)
                ids, counts = encode(part.column(1))
                whole = np.full(len(ids) + len(counts), end_id, np.uint32)
                keep = np.ones(len(whole), bool)
                keep[np.cumsum(counts + 1) - 1] = False
                whole[keep] = ids
                writer.add(part.column(0), whole, counts + 1)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "n_docs": pa.array([writer.n_docs], pa.int64()),
                    "n_tokens": pa.array([writer.n_tokens], pa.int64()),
                }
            )

    order = [F.col("id").asc_nulls_first(), "order"]
    written = (
        rows_of.repartitionByRange(shards, *order)
        .sortWithinPartitions(*order, "text")
        .select("id", "text")
        .mapInArrow(run, _SHARDS)
    )
    return materialise(written, f"{folder}/shards")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a few MB of text, a longer text alone."""
    for first, _, bounds in byte_chunks(batch.column(1), SLICE_BYTES):
        yield batch.slice(first, len(bounds) - 1)


def _batches(files, name: str) -> Iterator[pa.RecordBatch]:
    with files.open_input_stream(name) as source:
        yield from pa.ipc.open_stream(source)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document from a folder's shards: doc_id, start, n_tokens, ids (array<int>).

    `start` counts the ids of all documents before it in all shards.
    """
    schema = "doc_id long, start long, n_tokens long, ids array<int>"
    return _read(spark, folder, schema, lambda ids: ids.astype(np.int32).tolist())


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Like `read_documents`, but with `ids_crc32` of a document's ids instead of the ids."""
    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", crc)


def _read(spark: SparkSession, folder: str, schema: str, of_ids) -> DataFrame:
    ship(spark)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.schema(_SHARDS).parquet(f"{folder}/shards")
    based = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    types = T._parse_datatype_string(schema)
    last = types.names[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(folder)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if last == "ids_crc32" else pa.list_(pa.int32())]
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stream = (_unpadded(b) for b in _batches(files, f"{path}/tokens-{shard:05d}.arrows"))
                rest = np.zeros(0, np.uint32)
                for index in _batches(files, f"{path}/index-{shard:05d}.arrows"):
                    found = []
                    for count in index.column("n_tokens").to_pylist():
                        parts, have = [rest], len(rest)
                        while have < count:
                            parts.append(next(stream))
                            have += len(parts[-1])
                        joined = parts[0] if len(parts) == 1 else np.concatenate(parts)
                        found.append(of_ids(joined[:count]))
                        rest = joined[count:]
                    starts = pa.array(index.column("start").to_numpy() + base)
                    columns = [index.column("doc_id"), starts, index.column("n_tokens"), pa.array(found, kinds[3])]
                    yield pa.RecordBatch.from_arrays(columns, names=types.names)

    every = based.repartition(F.col("shard"))
    return every.mapInArrow(run, types)


def _unpadded(batch: pa.RecordBatch) -> np.ndarray:
    mask = batch.column("mask").flatten().to_numpy(zero_copy_only=False)
    return batch.column("ids").flatten().to_numpy()[mask].astype(np.uint32)


class Sequences:
    """Random access to the sequences of one shard file through a memory map, without copying."""

    def __init__(self, path: str) -> None:
        self._map = pa.memory_map(path)
        self._batches = list(pa.ipc.open_stream(self._map))
        self._rows = self._batches[0].num_rows if self._batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self._batches)

    def __getitem__(self, at: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence `at`, as views of the file."""
        if not 0 <= at < len(self):
            raise IndexError(at)
        ids, mask = (self._batches[at // self._rows].column(name)[at % self._rows].values for name in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask
