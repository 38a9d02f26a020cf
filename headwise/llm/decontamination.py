"""Benchmark passages in documents, by latent semantic retrieval and two checks of the words.

1. Inverse document frequencies are counted over all documents, in hashed buckets.
2. The benchmark's passages as TF-IDF vectors over hashed words are factored by a distributed
   randomised SVD, in groups of no more passages than directions; the right vectors span each
   group's latent space, so it has its passages whole, however many items there are.
3. Every window of every document is held against every benchmark passage in that space, by
   the product of the two over the smaller norm times the passage's: the cosine, unless the words around a
   copy weigh more than the copy. A window that holds a whole passage has 1 at least,
   whatever stands around it. One whose words could not give enough is passed over first.
4. Each candidate's words are compared by longest common subsequence. A high coverage of the
   item's words is a copy; a lower one is a paraphrase if the item's answer is there too.

The benchmark is the stated query set: it is taken in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwise.llm.common import byte_chunks, fresh_name, hashed_words, ship

#: Buckets of the document frequencies and hashed features of the latent space: both bound what is broadcast.
BUCKETS, FEATURES, RANK = 1 << 18, 1 << 15, 128
#: Passages held against the documents at once; an item's are together.
BLOCK = 5_000
#: Windows of words; an item is sought with the smallest that holds it, a longer one in parts.
WINDOWS = (8, 16, 32, 64)
#: Weight of a word of every document, so that a passage of such words is sought as well.
FLOOR = 1e-3
#: Least score of a candidate; least share of the item's words in a copy and, with
#: the share of its answer's words, in a paraphrase; items below SHORT words must stand whole.
COSINE, COPY, PARAPHRASE, ANSWER, SHORT = 0.4, 0.8, 0.55, 0.6, 8

LEAKS = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("last_word", T.LongType()),
            T.StructField("cosine", T.DoubleType()),
            T.StructField("coverage", T.DoubleType()),
            T.StructField("answer", T.DoubleType()),
        ]
    )
)
_LEAKS = pa.list_(
    pa.struct(
        [("item_id", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
        + [(n, pa.float64()) for n in ("cosine", "coverage", "answer")]
    )
)
_SLICES = 16


# --- document frequencies --------------------------------------------------------------


def _slices_of(values: np.ndarray) -> pa.RecordBatch:
    parts = np.split(values, _SLICES)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(_SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "data"]
    )


def _summed(sent: str, kept: str, key_type: pa.DataType = pa.int32()):
    """Adds up the arrays of each slice, as wider numbers than are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(data.as_buffer(), sent).astype(kept)
                sums[key] = sums[key] + part if key in sums else part
        for key, total in sums.items():
            columns = [pa.array([key], key_type), pa.array([total.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "data"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's documents each bucket's words stand; the last bucket counts documents."""
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, data, bounds in byte_chunks(batch.column(0)):
            start, _, words = hashed_words(data, bounds)
            row = np.searchsorted(bounds, start, "right") - 1
            pairs = np.unique(row * BUCKETS + (words % np.uint64(BUCKETS - 1)).astype(np.int64))
            counts += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
            counts[-1] += len(bounds) - 1
    yield _slices_of(counts.astype(np.int32))


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log((1 + documents) / (1 + documents with the word)) + FLOOR per bucket of words, over all documents."""
    ship(docs.sparkSession)
    parts = docs.select(F.col(text).alias("text")).mapInArrow(_frequencies, "slice int, data binary")
    total = parts.repartition(_SLICES, "slice").mapInArrow(_summed("i4", "i8"), "slice int, data binary")
    found = {r["slice"]: np.frombuffer(r["data"], np.int64) for r in total.collect()}
    counts = np.concatenate([found[s] for s in range(_SLICES)]) if found else np.zeros(BUCKETS, np.int64)
    return (np.log((1 + counts[-1]) / (1 + counts)) + FLOOR).astype(np.float32)


def _weights(idf: np.ndarray, words: np.ndarray) -> np.ndarray:
    return idf[(words % np.uint64(BUCKETS - 1)).astype(np.int64)]


def _features(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(40)).astype(np.int64) % FEATURES


# --- the latent space ------------------------------------------------------------------


def _words_of(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return hashed_words(data, np.array([0, len(data)]))[2]


def _window(count: int) -> int:
    return next((w for w in WINDOWS if w >= count), WINDOWS[-1])


def passages(words: np.ndarray) -> list[np.ndarray]:
    """An item's words, or parts of them that overlap by half if they are many."""
    longest = WINDOWS[-1]
    if len(words) <= longest:
        return [words] if len(words) else []
    return [words[a : a + longest] for a in range(0, len(words) - longest // 2, longest // 2)]


def _unit_rows(text: str | None, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, weights of length 1) of an item's passages."""
    return [row for part in passages(_words_of(text)) for row in _unit_row(part, idf)]


def _unit_row(part: np.ndarray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    weight = _weights(idf, part).astype(np.float64)
    norm = np.sqrt((weight**2).sum())
    return [(_features(part), weight / norm)] if norm > 0 else []


#: By space: its features, and their vectors.
Bases = dict[int, tuple[np.ndarray, np.ndarray]]


def _matrix(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(features, rows x features) of (features, weights); a repeated feature's weights add up."""
    features = np.unique(np.concatenate([at for at, _ in rows]))
    matrix = np.zeros((len(rows), len(features)))
    for nth, (at, weight) in enumerate(rows):
        np.add.at(matrix[nth], np.searchsorted(features, at), weight)
    return features, matrix


def _gram_pass(idf: np.ndarray, bases: Bases | None, width: int, seed: int):
    """Partial sums of A'AX over a task's passages of each space; X is its basis, or random at first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces: dict[int, list] = {}
        for batch in batches:
            for space, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spaces.setdefault(space, []).extend(_unit_row(np.frombuffer(data, np.uint64), idf))
        x = np.random.default_rng(seed).standard_normal((FEATURES, width)) if bases is None and spaces else None
        for space, rows in spaces.items():
            if rows:
                at, matrix = _matrix(rows)
                own = x[at] if bases is None else bases[space][1][np.searchsorted(bases[space][0], at)]
                total = matrix.T @ (matrix @ own)
                keys = pa.array(space * FEATURES + at, pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.array([t.tobytes() for t in total], pa.binary())], ["slice", "data"])

    return run


def latent_spaces(parts: DataFrame, idf: np.ndarray, rank: int = RANK, rounds: int = 2, seed: int = 11) -> Bases:
    """Right singular vectors of the TF-IDF passages of each space; `parts` has (space, words).

    Randomised subspace iteration: each round multiplies the bases by A'A in one pass over
    the passages, summed by space and feature, and makes them orthonormal. A space of no more
    passages than `rank` is that of all of them.
    """
    ship(parts.sparkSession)
    bases = None
    for _ in range(rounds + 1):
        sums = parts.mapInArrow(_gram_pass(idf, bases, rank, seed), "slice long, data binary")
        summed = sums.repartition(_SLICES, "slice").mapInArrow(_summed("f8", "f8", pa.int64()), "slice long, data binary")
        found = summed.collect()
        keys = np.array([r["slice"] for r in found], np.int64)
        order, bases = np.argsort(keys), {}
        for space in np.unique(keys // FEATURES).tolist():
            own = order[slice(*np.searchsorted(keys[order], [space * FEATURES, (space + 1) * FEATURES]))]
            total = np.stack([np.frombuffer(found[i]["data"], np.float64) for i in own])
            # With fewer features than directions the space is all of them.
            basis = np.linalg.qr(total)[0] if len(own) >= rank else np.eye(len(own), rank)
            bases[space] = keys[own] - space * FEATURES, basis
    return bases


def latent_space(
    items: DataFrame, idf: np.ndarray, text: str = "text", rank: int = RANK, rounds: int = 2, seed: int = 11
) -> np.ndarray:
    """Right singular vectors (FEATURES x rank) of all passages of some items, in one space."""
    texts = [r[0] for r in items.select(text).toLocalIterator()]
    rows = [(0, part.tobytes()) for t in texts for part in passages(_words_of(t))]
    basis = np.zeros((FEATURES, rank), np.float32)
    if rows:
        parts = items.sparkSession.createDataFrame(rows, "space int, words binary")
        for at, vectors in latent_spaces(parts, idf, rank, rounds, seed).values():
            basis[at] = vectors
    return basis


# --- search ----------------------------------------------------------------------------


def common_subsequence(left: np.ndarray, right: np.ndarray) -> int:
    """Length of the longest common subsequence of two word sequences, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for at, word in enumerate(left.tolist()):
        masks[word] = masks.get(word, 0) | (1 << at)
    full = (1 << len(left)) - 1
    row = full
    for word in right.tolist():
        hit = row & masks.get(word, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


@dataclass(frozen=True)
class Space:
    """Passages of one window length, and their latent space."""

    size: int
    own: np.ndarray  # by word of the block's vocabulary, and none: its row of the vectors
    vectors: np.ndarray  # latent vector of each own word, and a last row of zeros
    queries: np.ndarray  # unit vectors of passages
    norms: np.ndarray  # their lengths
    items: np.ndarray  # and their items
    shares: np.ndarray  # by row of the vectors: the most that the word adds to a product over the passage's squared norm
    products: np.ndarray  # and over its norm


@dataclass(frozen=True)
class Block:
    """Items to look for, and what of the latent spaces they need."""

    ids: list[int | None]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: np.ndarray
    spaces: list[Space]


def _last_sentence(text: str) -> str:
    parts = [p for p in text.replace("!", ".").replace("?", ".").replace("\n", ".").split(".") if len(_words_of(p))]
    return parts[-1] if parts else text


def _space(size: int, own: list[tuple[int, np.ndarray]], vocabulary: np.ndarray, idf: np.ndarray, basis: tuple) -> Space:
    """From (item, words) of passages."""
    features, directions = basis
    words = np.unique(np.concatenate([part for _, part in own]))
    rows = np.full(len(vocabulary) + 1, len(words), np.int32)
    rows[np.searchsorted(vocabulary, words)] = np.arange(len(words))
    vectors = np.zeros((len(words) + 1, directions.shape[1]), np.float32)
    vectors[:-1] = directions[np.searchsorted(features, _features(words))]
    latent = np.stack([_weights(idf, p) @ directions[np.searchsorted(features, _features(p))] for _, p in own])
    norms = np.linalg.norm(latent, axis=1)
    at, matrix = _matrix([(_features(p), _weights(idf, p).astype(np.float64)) for _, p in own])
    weight, matrix = _weights(idf, words), matrix / norms[:, None]
    products, shares = (
        np.append(weight * most.max(axis=0)[np.searchsorted(at, _features(words))], 0.0) for most in (matrix, matrix / norms[:, None])
    )
    queries, items = (latent / norms[:, None]).astype(np.float32), np.array([i for i, _ in own], np.int64)
    return Space(size, rows, vectors, queries, norms.astype(np.float32), items, shares, products)


def make_block(spark: SparkSession, rows: list[tuple[int | None, str | None, str | None]], idf: np.ndarray) -> Block:
    """From (id, text, answer); an item without an answer has its last sentence for one."""
    rows = [r for r in rows if len(_words_of(r[1]))]
    words = [_words_of(r[1]) for r in rows]
    answers = [_words_of(r[2] if r[2] and len(_words_of(r[2])) else _last_sentence(r[1])) for r in rows]
    vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    by_window: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, own in enumerate(words):
        for part in passages(own):
            if _unit_row(part, idf):
                by_window.setdefault(_window(len(part)), []).append((item, part))
    groups = [(w, own[a : a + RANK]) for w, own in sorted(by_window.items()) for a in range(0, len(own), RANK)]
    stated = [(n, part.tobytes()) for n, (_, own) in enumerate(groups) for _, part in own]
    bases = {}
    if stated:
        parts = spark.createDataFrame(stated, "space int, words binary")
        bases = latent_spaces(parts.repartition(spark.sparkContext.defaultParallelism), idf)
    spaces = [_space(w, own, vocabulary, idf, bases[n]) for n, (w, own) in enumerate(groups)]
    return Block([r[0] for r in rows], words, answers, vocabulary, spaces)


def _places(vocabulary: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where words stand in the vocabulary; its length for those that don't."""
    missing = len(vocabulary)
    place = np.full(len(words), missing, np.int64)
    if missing:
        likely = np.zeros(1 << 20, bool)
        likely[(vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        maybe = np.flatnonzero(likely[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
        near = np.minimum(np.searchsorted(vocabulary, words[maybe]), missing - 1)
        same = vocabulary[near] == words[maybe]
        place[maybe[same]] = near[same]
    return place


def _latent(
    space: Space, own: np.ndarray, weight: np.ndarray, known: np.ndarray, low: np.ndarray, high: np.ndarray
) -> np.ndarray:
    """The latent vectors of windows, each from low to high (not empty) of the known places."""
    length = high - low
    begin = np.cumsum(length) - length
    at = known[np.repeat(low - begin, length) + np.arange(length.sum())]
    return np.add.reduceat(space.vectors[own[at]] * weight[at][:, None], begin, axis=0)


def _candidates(
    block: Block, idf: np.ndarray, words: np.ndarray, first: np.ndarray, count: np.ndarray
) -> dict[tuple[int, int], list[tuple[int, int, float]]]:
    """(row, item): windows (start, end, cosine) whose score is high enough.

    `words` are those of all rows, one after another; row i has count[i] from first[i].
    Windows reach a step beyond their size, so every stretch of that size is in one as a whole.
    """
    weight = _weights(idf, words)
    place = _places(block.vocabulary, words)
    square = np.concatenate([[0.0], np.cumsum(weight.astype(np.float64) ** 2)])
    found: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    for space in block.spaces:
        size, step = space.size, space.size // 4
        own = space.own[place]
        at_known = np.flatnonzero(own < len(space.vectors) - 1)
        share, product = (np.concatenate([[0.0], np.cumsum(x[own[at_known]])]) for x in (space.shares, space.products))
        windows = np.where(count > 0, 1 + -(-np.maximum(count - size, 0) // step), 0)
        row = np.repeat(np.arange(len(count)), windows)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = first[row] + nth * step
        end = np.minimum(start + size + step, first[row] + count[row])
        whole = square[end] - square[start]
        low, high = np.searchsorted(at_known, start), np.searchsorted(at_known, end)
        # No score is above the sums of the most that each word can add.
        enough = (share[high] - share[low] >= 0.999 * COSINE) | (product[high] - product[low] >= 0.999 * COSINE * np.sqrt(whole))
        near = np.flatnonzero(enough & (high > low))
        for at in range(0, len(near), 512):
            some = near[at : at + 512]
            norm = np.sqrt(whole[some]).astype(np.float32)[:, None]
            along = _latent(space, own, weight, at_known, low[some], high[some]) @ space.queries.T
            cosine = along / norm
            for w, q in np.argwhere(along >= COSINE * np.minimum(norm, space.norms)).tolist():
                key = int(row[some[w]]), int(space.items[q])
                found.setdefault(key, []).append((int(start[some[w]]), int(end[some[w]]), float(cosine[w, q])))
    return found


def _verified(words: np.ndarray, item: np.ndarray, answer: np.ndarray, spans: list[tuple[int, int, float]], low: int, high: int):
    """The best matching stretch of a document around candidate windows, if it passes.

    Stretches hold half as many words again as the item, so that additions don't hide a match.
    A common subsequence has no more words than the two have in common, counting repeats, so
    stretches are tried by that number, until none can be better or pass.
    """
    size = len(item)
    reach = size if size < SHORT else size * 3 // 2
    step = 1 if size < SHORT else max(1, size // 4)
    starts: set[int] = set()
    for a, b, _ in spans:
        starts.update(range(max(low, a - size), max(low, min(b, high - 1)) + 1, step))
    first = np.array(sorted(starts))
    last = np.minimum(first + reach, high)
    different, repeats = np.unique(item, return_counts=True)
    around = words[first[0] : last[-1]]
    place = np.minimum(np.searchsorted(different, around), len(different) - 1)
    known = different[place] == around
    shared = np.concatenate([[0], np.cumsum(known)])
    most = shared[last - first[0]] - shared[first - first[0]]
    needed = size if size < SHORT else PARAPHRASE * size
    for at in np.flatnonzero(most >= needed).tolist():
        stretch = slice(first[at] - first[0], last[at] - first[0])
        counts = np.bincount(place[stretch][known[stretch]], minlength=len(different))
        most[at] = np.minimum(counts, repeats).sum()
    best = (0, 0, 0)
    for at in np.argsort(-most, kind="stable").tolist():
        if most[at] <= best[0] or most[at] < needed:
            break
        a, b = int(first[at]), int(last[at])
        length = common_subsequence(item, words[a:b])
        if length > best[0]:
            best = (length, a, b)
    length, a, b = best
    if length < needed:
        return None
    coverage, answered = length / size, common_subsequence(answer, words[a:b]) / len(answer)
    good = size < SHORT or coverage >= COPY or answered >= ANSWER
    return (coverage, answered, a, b) if good else None


def leaks_in(block: Block, idf: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> list[list[dict]]:
    """What each row of a chunk has of the block's items."""
    start, _, words = hashed_words(data, bounds)
    cuts = np.searchsorted(start, bounds)
    first, count = cuts[:-1], np.diff(cuts)
    result: list[list[dict]] = [[] for _ in count]
    for (row, item), spans in sorted(_candidates(block, idf, words, first, count).items()):
        low, high = int(first[row]), int(first[row] + count[row])
        best = _verified(words, block.words[item], block.answers[item], spans, low, high)
        if best:
            coverage, answered, a, b = best
            result[row].append(
                {
                    "item_id": block.ids[item],
                    "first_word": a - low,
                    "last_word": b - 1 - low,
                    "cosine": max(s[2] for s in spans),
                    "coverage": coverage,
                    "answer": answered,
                }
            )
    return result


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    answer: str | None = None,
) -> DataFrame:
    """All columns of `docs`, and `leaks`: the benchmark items found in each, with place and scores.

    The name gets an underscore if it is taken. A NULL or empty text has none; items without
    words are never found, repeated items each time. A repeated row is searched again, alike.
    Without items or documents nothing is found. Items below SHORT words must stand
    word for word.
    """
    spark = docs.sparkSession
    ship(spark)
    columns = [F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")]
    stated = items.select(*columns, (F.col(answer) if answer else F.lit(None)).cast("string").alias("answer"))
    idf = inverse_frequencies(docs, text)
    leaks = fresh_name(docs, "leaks")
    result = docs.withColumn(leaks, F.array().cast(LEAKS))
    rows: list[tuple] = []
    size = 0
    for r in stated.toLocalIterator():
        rows.append(tuple(r))
        size += len(passages(_words_of(r["text"])))
        if size >= BLOCK:
            result, rows, size = _searched(result, text, leaks, make_block(spark, rows, idf), idf), [], 0
    return _searched(result, text, leaks, make_block(spark, rows, idf), idf) if rows else result


def _searched(docs: DataFrame, text: str, leaks: str, block: Block, idf: np.ndarray) -> DataFrame:
    at, into = docs.columns.index(text), docs.columns.index(leaks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for _, data, bounds in byte_chunks(batch.column(at)) for x in leaks_in(block, idf, data, bounds)]
            every = [(old or []) + new for old, new in zip(batch.column(into).to_pylist(), found)]
            columns = list(batch.columns)
            columns[into] = pa.array(every, _LEAKS)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of `docs` in which no benchmark item is found, with their own columns."""
    found = find_leaks(docs, items, text, **options)
    return found.where(F.size(found.columns[-1]) == 0).select(*docs.columns)
