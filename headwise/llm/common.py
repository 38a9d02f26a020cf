"""What the operators share: shipping the package, text as byte arrays, hashed words.

Words are handled as numpy arrays over a batch's UTF-8 bytes: a prefix sum of
byte x P^position (mod 2^64) gives every word's hash by one subtraction, so no word becomes
a Python object.
"""

from __future__ import annotations

import shutil
import tempfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; a longer text is handled whole.
CHUNK_BYTES = 1 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="headwise-py-")  # read by the driver's file server only
        archive = shutil.make_archive(f"{folder}/{package.name}_py", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(application)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(id: str, divisor: int) -> Column:
    """crc32 of an id's text, modulo `divisor`; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % divisor


def fresh_name(frame: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of the frame is called that (in any case)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row bounds within them) for runs of rows of about `limit` bytes.

    NULL counts as empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield first, every[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def _powers(count: int, base: int) -> np.ndarray:
    steps = np.full(count, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


BASE = 0x9E3779B97F4A7C15
_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(count: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i (mod 2^64) for i < count; the usual size is kept by the worker."""
    inverse = pow(base, -1, 1 << 64)
    if base not in _kept:
        _kept[base] = _powers(CHUNK_BYTES + 1, base), _powers(CHUNK_BYTES + 1, inverse)
    if count <= len(_kept[base][0]):
        return _kept[base]
    return _powers(count, base), _powers(count, inverse)


@lru_cache
def word_table() -> np.ndarray:
    """Each byte that belongs to words (letters, digits, all beyond ASCII), A-Z lower-cased; else 0."""
    table = np.zeros(256, np.uint64)
    for byte in (*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)):
        table[byte] = byte
    table[65:91] = table[97:123]
    return table


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the value."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def hashed_words(
    data: np.ndarray, bounds: np.ndarray, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, 64-bit hash) of every word; words never cross row bounds.

    ASCII and accented Latin capitals count as small letters. With `prefixes` there is a row of
    hashes for the words, and one for each length given, of the words' first bytes.
    """
    codes = word_table()[data]
    inside = codes != 0
    lead = np.flatnonzero(data == 0xC3)
    capital = lead[(lead + 1 < len(data))] + 1  # second bytes of accented Latin letters
    capital = capital[(data[capital] >= 0x80) & (data[capital] <= 0x9E) & (data[capital] != 0x97)]
    codes[capital] += np.uint64(32)
    edge = bounds[:-1][np.diff(bounds) > 0]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[edge] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[bounds[1:][np.diff(bounds) > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    if not len(start):
        return start, end, np.zeros((1 + len(prefixes), 0) if prefixes else 0, np.uint64)
    power, inverse = power_tables(len(data) + 1)
    sums = np.cumsum(codes * power[: len(codes)], dtype=np.uint64)
    below, scale = sums[start] - codes[start] * power[start], inverse[start]
    words = mixed((sums[end - 1] - below) * scale)
    if not prefixes:
        return start, end, words
    first = [mixed((sums[np.minimum(end, start + k) - 1] - below) * scale + np.uint64(k)) for k in prefixes]
    return start, end, np.stack([words, *first])


def word_hash(word: str) -> int:
    """The hash `hashed_words` gives to one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hashed_words(data, np.array([0, len(data)]))[2][0])


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
