"""Lines that many documents share, found by two Bloom filters and confirmed on their text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwise.llm.common import byte_chunks, fresh_name, mixed, power_tables, ship
from headwise.session import materialise, scratch_path

#: Bits of a filter chunk, bits looked at per line, bits held for each line of the corpus.
CHUNK_BITS, PROBES, BITS_PER_LINE = 1 << 20, 3, 8
#: Chunks of a filter at most: 2^28 bits, 32 MB. Beyond that many lines, more lines that don't repeat are sent
#: to be confirmed; what is found stays the same.
MAX_CHUNKS = 256
#: Bytes of text handled at once; a longer text is cut at line feeds.
SLICE_BYTES = 1 << 20

#: Space, tab, line feed, vertical tab, form feed, carriage return.
_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])


@lru_cache
def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] = table[97:123]
    return table


def _slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, first byte and byte after the last of every line, row of every line) of slices of the texts.

    A row without text has one empty line. A text longer than a slice is spread over several.
    """
    for first, data, bounds in byte_chunks(texts, SLICE_BYTES):
        feeds = np.flatnonzero(data == 10)
        lines = np.diff(np.searchsorted(feeds, bounds)) + 1
        heads = np.cumsum(lines) - lines
        start, end = np.empty(lines.sum(), np.int64), np.empty(lines.sum(), np.int64)
        inner = np.ones(len(start), bool)
        inner[heads] = False
        start[heads], start[inner] = bounds[:-1], feeds + 1
        inner[:] = True
        inner[heads + lines - 1] = False
        end[heads + lines - 1], end[inner] = bounds[1:], feeds
        row = np.repeat(np.arange(first, first + len(lines)), lines)
        at = 0
        while at < len(start):  # one round but for a text that is longer than a slice
            upto = max(at + 1, int(np.searchsorted(end, start[at] + SLICE_BYTES, "right")))
            if len(data) <= SLICE_BYTES:
                upto = len(start)
            low, high = start[at], end[upto - 1]
            yield data[low:high], start[at:upto] - low, end[at:upto] - low, row[at:upto]
            at = upto


class Keys:
    """The keys of a slice's lines: stripped of white space, A-Z lower-cased; lines with shorter keys are left out."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, least: int) -> None:
        solid = np.flatnonzero(~_WHITE[data])
        low, high = np.searchsorted(solid, start), np.searchsorted(solid, end)
        kept = np.flatnonzero(low < high)
        self.line, self.row = kept, row[kept]
        self.start, self.end = solid[low[kept]] if len(kept) else kept, solid[high[kept] - 1] + 1 if len(kept) else kept
        self._data = _lowered()[data]
        if least > 1 and len(kept):
            points = np.cumsum((data & 0xC0) != 0x80)
            long = points[self.end - 1] - points[self.start] + 1 >= least
            self.line, self.row, self.start, self.end = (x[long] for x in (self.line, self.row, self.start, self.end))

    def hashes(self) -> np.ndarray:
        if not len(self.line):
            return np.zeros(0, np.uint64)
        power, inverse = power_tables(len(self._data) + 1)
        terms = (self._data.astype(np.uint64) + np.uint64(1)) * power[: len(self._data)]
        sums = np.cumsum(terms, dtype=np.uint64)
        own = (sums[self.end - 1] - sums[self.start] + terms[self.start]) * inverse[self.start]
        return mixed(own + (self.end - self.start).astype(np.uint64))

    def texts(self, chosen: np.ndarray) -> pa.Array:
        """The keys themselves."""
        lengths = (self.end - self.start)[chosen]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[chosen] - (ends - lengths), lengths)
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(self._data[at])]
        return pa.LargeStringArray.from_buffers(len(lengths), buffers[1], buffers[2])


def _chunk_of(hashes: np.ndarray, chunks: int) -> np.ndarray:
    """The chunk a hash falls into, from its upper bits; `chunks` is a power of two."""
    return ((hashes >> np.uint64(32)) & np.uint64(chunks - 1)).astype(np.int64)


def _places(prints: np.ndarray) -> np.ndarray:
    """Which bits of its chunk stand for a line, from the lower 32 bits of its hash."""
    drawn = mixed(prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return np.stack([(drawn >> np.uint64(20 * i)) & np.uint64(CHUNK_BITS - 1) for i in range(PROBES)]).astype(np.int64)


class SeenTwice:
    """Two Bloom filters of one chunk: hashes seen once, and hashes seen again."""

    def __init__(self) -> None:
        self._once, self._twice = np.zeros(CHUNK_BITS, bool), np.zeros(CHUNK_BITS, bool)

    def add(self, prints: np.ndarray) -> None:
        different, counts = np.unique(prints, return_counts=True)
        places = _places(different)
        again = self._once[places].all(axis=0) | (counts > 1)
        self._twice[places[:, again]] = True
        self._once[places] = True

    def bits(self) -> bytes:
        return np.packbits(self._twice, bitorder="little").tobytes()


def holds(filters: np.ndarray, hashes: np.ndarray, chunks: int) -> np.ndarray:
    """Whether the hashes may be in a filter of `chunks` chunks, bits packed into bytes."""
    at = _places(hashes.astype(np.uint32)) + _chunk_of(hashes, chunks) * CHUNK_BITS
    return ((filters[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def _once_per_document(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Different hashes, each as often as there are documents with it, but twice at most."""
    order = np.lexsort((row, hashes))
    row, hashes = row[order], hashes[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    different, counts = np.unique(hashes[first], return_counts=True)
    return np.repeat(different, np.minimum(counts, 2))


def seen_twice(docs: DataFrame, text: str, least: int) -> tuple[Broadcast, int]:
    """(the filter of line keys that two documents may have, its number of chunks).

    Every key is sent as 32 bits, twice per batch at most, to the chunk its hash falls into; a task fills
    the two filters of one chunk after another and keeps the second. The filter has 8
    bits for each line of the corpus, but 32 MB at most, and it alone reaches the driver.
    """
    spark = docs.sparkSession
    feeds = F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit("\n"))) + 1
    lines = docs.agg(F.sum(feeds)).first()[0] or 0
    chunks = 1
    while chunks < MAX_CHUNKS and chunks * CHUNK_BITS < lines * BITS_PER_LINE:
        chunks *= 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for part in _slices(batch.column(0)):
                keys = Keys(*part, least)
                parts.append(_once_per_document(keys.row, keys.hashes()))
            hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            chunk = _chunk_of(hashes, chunks)
            order = np.argsort(chunk, kind="stable")
            found, first = np.unique(chunk[order], return_index=True)
            prints = np.split(hashes[order].astype("<u4"), first[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), pa.array([p.tobytes() for p in prints[: len(found)]], pa.binary())],
                ["chunk", "prints"],
            )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, filters = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "bits": [filters.bits()]})

        for batch in batches:
            for number, prints in zip(batch.column(0).to_pylist(), batch.column(1)):
                if number != chunk:
                    if chunk is not None:
                        yield done()
                    chunk, filters = number, SeenTwice()
                filters.add(np.frombuffer(prints.as_buffer(), "<u4"))
        if chunk is not None:
            yield done()

    dealt = docs.select(text).mapInArrow(deal, "chunk int, prints binary")
    filled = dealt.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(fill, "chunk int, bits binary")
    bits = np.zeros((chunks, CHUNK_BITS // 8), np.uint8)
    for row in filled.collect():
        bits[row.chunk] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(bits.reshape(-1)), chunks


_PLACES = "key string, docs long, lines long, first struct<nameless: boolean, id: {id}, row: long, line: int>, places array<struct<row: long, line: int>>"


def _suspected(docs: DataFrame, least: int, filters: Broadcast, chunks: int) -> DataFrame:
    """Lines whose key the filter holds, one row per different key and batch, with all their places.

    `docs` has the columns row, id and text. Places are a document's row number and the
    line's number in it, from 0; `first` is the one with the smallest id (a missing id comes last).
    """
    schema = T._parse_datatype_string(_PLACES.format(id=docs.schema["id"].dataType.simpleString()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = filters.value
        for batch in batches:
            rows, ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("row", "id", "text"))
            rank = np.empty(len(ids), np.int64)
            rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            before = np.zeros(len(ids), np.int64)  # lines of a long text that earlier slices had
            found, keys_of = [], []
            for data, start, end, row in _slices(texts):
                keys = Keys(data, start, end, row, least)
                heads = np.searchsorted(row, row)
                number = np.arange(len(row)) - heads + before[row]
                before[row[-1]] = number[-1] + 1
                chosen = np.flatnonzero(holds(held, keys.hashes(), chunks))
                found.append(np.stack([keys.row[chosen], number[keys.line[chosen]]]))
                keys_of.append(keys.texts(chosen))
            if not found or not sum(map(len, keys_of)):
                continue
            at, line = np.concatenate(found, axis=1)
            coded = pa.chunked_array(keys_of).combine_chunks().dictionary_encode()
            code = coded.indices.to_numpy()
            order = np.lexsort((line, rank[at], code))
            at, line, code = at[order], line[order], code[order]
            edge = np.flatnonzero(np.diff(code, prepend=-1))
            fresh = np.ones(len(at), bool)
            fresh[1:] = (at[1:] != at[:-1]) | (code[1:] != code[:-1])
            first_id = ids.take(pa.array(at[edge]))
            row_at, line_at = rows.take(pa.array(at)), pa.array(line, pa.int32())
            offsets = pa.array(np.append(edge, len(at)), pa.int32())
            first = pa.StructArray.from_arrays(
                [first_id.is_null(), first_id, row_at.take(pa.array(edge)), line_at.take(pa.array(edge))],
                ["nameless", "id", "row", "line"],
            )
            places = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([row_at, line_at], ["row", "line"]))
            yield pa.RecordBatch.from_arrays(
                [
                    coded.dictionary.cast(pa.string()),
                    pa.array(np.add.reduceat(fresh.astype(np.int64), edge)),
                    pa.array(np.diff(np.append(edge, len(at)))),
                    first,
                    places,
                ],
                schema.names,
            )

    return docs.select("row", "id", "text").mapInArrow(run, schema)


def _confirmed(suspected: DataFrame, min_docs: int) -> DataFrame:
    repeated = suspected.groupBy("key").agg(
        F.sum("docs").alias("n_docs"), F.sum("lines").alias("n_lines"), F.min("first").alias("first")
    )
    return repeated.where(F.col("n_docs") >= min_docs)


def _suspects(docs: DataFrame, id: str, text: str, min_docs: int, min_chars: int, folder: str) -> DataFrame:
    if min_docs < 2 or min_chars < 1:
        raise ValueError("a repeated line is in two documents at least, and its key isn't empty")
    ship(docs.sparkSession)
    filters, chunks = seen_twice(docs, text, min_chars)
    named = docs.select("row", F.col(id).alias("id"), F.col(text).alias("text"))
    return materialise(_suspected(named, min_chars, filters, chunks), f"{folder}/suspected")


def repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(key, n_docs, n_lines, first_id, first_line): keys found in `min_docs` documents or more, and where first.

    As in `drop_repeated_lines`; the first place is that with the smallest id, a missing id comes last.
    """
    folder = scratch_path(docs.sparkSession, "repeated-lines")
    numbered = materialise(
        docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")),
        f"{folder}/docs",
    )
    found = _confirmed(_suspects(numbered, "id", "text", min_docs, min_chars, folder), min_docs)
    return found.select("key", "n_docs", "n_lines", F.col("first.id").alias("first_id"), F.col("first.line").alias("first_line"))


def drop_repeated_lines(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
) -> DataFrame:
    """The rows of `docs` without the lines that `min_docs` documents or more share.

    A text is split at line feeds; a NULL counts as empty, and an empty text is one empty
    line. A line's key is the line without white space at its ends, A-Z lower-cased; keys of
    fewer than `min_chars` code points never repeat. All lines of a repeated key go, in
    every document, or all but the first one with `keep_first` (smallest id, a missing id
    last, then the first line). Every row counts as a document, also one that repeats
    another. The lines left are joined by line feeds again (none: empty text). `n_lines` (before) and
    `n_dropped` are added, under names the table doesn't have yet. No documents give no rows.

    Two filters are filled first (`seen_twice`), from 32 bits of every key's hash. Only lines that the second filter
    holds are suspected: their keys are grouped as texts and counted, so a filter's mistake
    adds work and no result. A key is one row per batch of documents before
    that shuffle, however many lines it has. Documents are written once with a row number,
    which the numbers of their dropped lines are joined to.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "line-dedup")
    total, dropped = (fresh_name(docs, name) for name in ("n_lines", "n_dropped"))
    row, gone = fresh_name(docs, "row"), fresh_name(docs, "gone")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), f"{folder}/docs")
    of_id, of_text = (numbered[c].alias(f"{c}_") for c in (id, text))
    narrow = numbered.select(numbered[row].alias("row"), of_id, of_text).toDF("row", "id", "text")
    suspected = _suspects(narrow, "id", "text", min_docs, min_chars, folder)
    repeated = materialise(_confirmed(suspected, min_docs).select("key", "first"), f"{folder}/repeated")
    places = suspected.select("key", "places").join(repeated, "key").select("first", F.explode("places").alias("at"))
    if keep_first:
        places = places.where((F.col("at.row") != F.col("first.row")) | (F.col("at.line") != F.col("first.line")))
    lists = places.groupBy(F.col("at.row").alias(row)).agg(F.collect_list("at.line").alias(gone))
    # Joined the same way at every size: the lists grow with the documents.
    dropped_lines = materialise(lists, f"{folder}/dropped").hint("merge")
    every = numbered.join(dropped_lines, row, "left").select(*docs.columns, gone)
    schema = T.StructType(
        [
            *(T.StructField(f.name, f.dataType, f.nullable or f.name == text) for f in docs.schema),
            T.StructField(total, T.LongType()),
            T.StructField(dropped, T.LongType()),
        ]
    )
    text_at = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            lists, kept, counts = batch.columns[-1].to_pylist(), [], []
            for value, drop in zip(columns[text_at], lists):
                whole = (value.as_py() or "")
                counts.append(whole.count("\n") + 1)
                if drop:
                    drop = set(drop)
                    whole = "\n".join(line for n, line in enumerate(whole.split("\n")) if n not in drop)
                kept.append(whole)
            columns[text_at] = pa.array(kept, batch.schema.field(text_at).type)
            gone_here = pa.array([len(drop or ()) for drop in lists], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), gone_here], schema.names)

    return every.mapInArrow(cut, schema)
