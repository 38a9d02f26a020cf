"""Language identification by a bit-sliced Bloom filter over character n-grams.

The filter has a row of bits per hash value and a column per language. An n-gram is entered
under a few hash values, with the bits of all languages it is typical of; the AND of its
rows gives back all of them at once. A text's n-grams are looked up, the hits of each language are
counted, and the counts are corrected for what a filter of that fill would hit by chance;
the language with the largest share of the text's n-grams is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwise.llm.common import CHUNK_BYTES, byte_chunks, fresh_name, mixed, ship
from headwise.session import materialise, scratch_path

#: Characters in an n-gram.
SIZE = 4
#: Rows of the filter (a power of two), hash values per n-gram, languages per machine word.
ROWS, HASHES, WORD = 1 << 20, 4, 64
#: An n-gram is typical of a language that has at least this share of n-grams in it, which
#: bounds a language's entries by 1 / SHARE. So neither the filter nor what is collected for it
#: grows with the corpus.
SHARE = 2e-5
#: Most languages a filter tells apart, the most frequent ones.
LANGUAGES = 256
UNKNOWN = "und"


@lru_cache
def _letters() -> np.ndarray:
    """Each code point's lower case if it is a letter (or combines with one), else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            lower = letter.lower()
            table[point] = ord(lower) if len(lower) == 1 else point
    return table


def letter_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bounds): lower-cased letters, one space between words and at both ends.

    A text without a letter has no code points.
    """
    joined = "\x00".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    plain = _letters()[points]
    keep = plain != 32
    # A space stays where it follows a letter (a separator becomes one); one more opens every text.
    keep[1:] |= plain[:-1] != 32
    row = np.repeat(np.arange(len(texts)), lengths + 1)[: len(points)]  # a separator is its text's last place
    has = np.bincount(row[plain != 32], minlength=len(texts)) > 0 if len(points) else np.zeros(len(texts), bool)
    kept, kept_row = plain[keep], row[keep]
    if lengths[-1] and plain[-1] != 32:  # the last text has no separator after it
        kept, kept_row = np.append(kept, np.uint32(32)), np.append(kept_row, len(texts) - 1)
    counts = np.bincount(kept_row, minlength=len(texts))
    first = np.cumsum(counts) - counts
    starts = first[has]
    out = np.insert(kept, starts, np.uint32(32))
    sizes = counts + has
    return out, np.concatenate([[0], np.cumsum(sizes)])


def ngrams(texts: list[str], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the n-grams of letters; one of fewer characters stands for a shorter text."""
    points, bounds = letter_runs(texts)
    lengths = np.diff(bounds)
    counts = np.where(lengths > 0, np.maximum(lengths - size + 1, 1), 0)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    padded = np.concatenate([points, np.full(size, 32, np.uint32)]).astype(np.uint64)
    value = np.zeros(len(points), np.uint64)
    for offset in range(size):
        value = value * np.uint64(0x1F0A2BD13C5F9E37) + padded[offset : offset + len(points)] + np.uint64(1)
    upto = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(upto[-1]) + np.repeat(bounds[:-1] - upto[:-1], counts)
    return mixed(value[at]), upto


def _counted(languages: dict[str, int]):
    """Per language and n-gram, how often a task's texts (lang, text) have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            lang, gram, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((gram, lang))
            lang, gram, n = lang[order], gram[order], n[order]
            new = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1])]))
            return lang[new], gram[new], np.add.reduceat(n, new)

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, data, bounds in byte_chunks(batch.column(1)):
                texts = _decoded(data, bounds)
                by_lang: dict[int, list[str]] = {}
                for lang, text in zip(langs[first : first + len(texts)], texts):
                    by_lang.setdefault(languages[lang], []).append(text)
                for lang, own in by_lang.items():
                    gram, n = np.unique(ngrams(own)[0], return_counts=True)
                    held.append((np.full(len(gram), lang, np.int32), gram, n.astype(np.int64)))
                if sum(len(h[1]) for h in held) > 2_000_000:
                    held = [merged()]
        if held:
            lang, gram, n = merged()
            for at in range(0, len(gram), 100_000):
                part = slice(at, at + 100_000)
                columns = [lang[part], gram[part].view(np.int64), n[part]]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["lang", "gram", "n"])

    return run


def _decoded(data: np.ndarray, bounds: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


@dataclass(frozen=True)
class LanguageFilter:
    """A fitted filter: names, rows (ROWS x words of 64 languages), and each language's chance of a false hit."""

    names: list[str]
    rows: np.ndarray
    chance: np.ndarray

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """All languages that contain each n-gram, as bits."""
        found = None
        for nth in range(HASHES):
            row = self.rows[row_of(grams, nth)]
            found = row if found is None else found & row
        return found

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(corrected share of n-grams found, per text and language; number of n-grams)."""
        grams, bounds = ngrams(texts)
        counts = np.diff(bounds)
        shares = np.zeros((len(texts), len(self.names)))
        full = np.flatnonzero(counts)
        if len(full):
            masks = self.masks(grams)
            for lang in range(len(self.names)):
                bits = (masks[:, lang // WORD] >> np.uint64(lang % WORD)) & np.uint64(1)
                hits = np.add.reduceat(bits, bounds[full], dtype=np.int64)
                chance = self.chance[lang]
                if chance < 1:
                    shares[full, lang] = np.maximum(hits / counts[full] - chance, 0) / (1 - chance)
        return shares, counts

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Names and scores; a tie goes to the language that was learned from more texts."""
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        shares, counts = self.shares(texts)
        best = shares.argmax(axis=1)
        total = shares.sum(axis=1)
        top = shares[np.arange(len(texts)), best]
        score = np.divide(top, total, out=np.zeros(len(texts)), where=total > 0)
        return [self.names[b] if n else UNKNOWN for b, n in zip(best.tolist(), counts.tolist())], score


def row_of(grams: np.ndarray, nth: int) -> np.ndarray:
    """The row of an n-gram's nth hash value: double hashing within a 64-bit hash."""
    step = (grams >> np.uint64(32)) | np.uint64(1)
    return ((grams + np.uint64(nth) * step) & np.uint64(ROWS - 1)).astype(np.int64)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", held_out: Column | None = None) -> LanguageFilter:
    """Learn from all rows with a language and a text where `held_out` doesn't hold.

    Counts cover all those rows, added up in every task before the shuffle. What reaches the driver is
    one row per typical n-gram: at most LANGUAGES / SHARE of them by the definition of typical.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if held_out is not None:
        rows = rows.where(~held_out)
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    names = [r["lang"] for r in sizes]
    if not names:
        return LanguageFilter([], np.zeros((ROWS, 1), np.uint64), np.zeros(0))
    known = rows.where(F.col("lang").isin(names))
    counts = known.mapInArrow(_counted({n: i for i, n in enumerate(names)}), "lang int, gram long, n long")
    folder = scratch_path(spark, "language")
    summed = materialise(counts.groupBy("gram", "lang").agg(F.sum("n").alias("n")), f"{folder}/counts")
    totals = summed.groupBy("lang").agg(F.sum("n").alias("total"))
    typical = summed.join(F.broadcast(totals), "lang").where(F.col("n") >= SHARE * F.col("total"))
    table = np.zeros((ROWS, -(-len(names) // WORD)), np.uint64)
    entries = typical.select("lang", "gram").toPandas()
    gram, of = entries["gram"].to_numpy(np.int64).view(np.uint64), entries["lang"].to_numpy(np.int64)
    for nth in range(HASHES):
        np.bitwise_or.at(table, (row_of(gram, nth), of // WORD), np.uint64(1) << (of % WORD).astype(np.uint64))
    fill = [((table[:, i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).mean() for i in range(len(names))]
    return LanguageFilter(names, table, np.array(fill) ** HASHES)


def identify(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """All columns of `docs`, and `lang_pred` and `score` (an underscore is added to a taken name).

    A text that is NULL or has no letter is `und` with score 0; so is every text if nothing was
    learned. The score is the language's part of all languages' corrected shares: 1 if
    no other has any, and 0 if none has one, when the most frequent language is named.
    Nothing but the text is looked at. The filter's size is fixed, so it is sent to all tasks.
    """
    ship(docs.sparkSession)
    added = [fresh_name(docs, n) for n in ("lang_pred", "score")]
    fields = [T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())]
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            scores: list[np.ndarray] = []
            for _, data, bounds in byte_chunks(batch.column(at), CHUNK_BYTES // 2):
                found, score = shared.value.predict(_decoded(data, bounds))
                names += found
                scores.append(score)
            columns = [pa.array(names, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *added])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
