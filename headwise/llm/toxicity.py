"""Toxic documents and the sentences that make them so, by multiple-instance learning.

A document is a bag of sentences; only documents have labels. A sentence's score is a
logistic function of the words and word beginnings in it, and a document's is the noisy-or of its sentences',
1 - product(1 - p): one bad sentence is enough, and many harmless ones add little. The
weights are those that make the labels of the training documents likeliest, so sentences
are learned from document labels, and afterwards the sentences to blame can be named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwise.llm.common import byte_chunks, fresh_name, hashed_words, ship
from headwise.session import materialise, scratch_path

#: Most labelled documents of each class that a model is fitted to.
SAMPLE = 10_000
#: Most words a model weighs, in how many toxic documents each must stand, how far it must be
#: from chance (chi square with one degree of freedom), and how many times as frequent it must be in
#: toxic documents as in others: what is in most sentences can't tell which one is to blame.
WORDS, SUPPORT, CHI_SQUARE, LIFT = 4096, 3, 20.0, 3.0
#: Bytes of a word's beginnings, which count beside the whole word (inflected and compound words).
BEGINNINGS = (4, 5, 6)
#: Penalty on squared weights, and steps of the fit.
PENALTY, STEPS = 1e-2, 600

_MODEL = "word long, weight double"
_BIAS = 0  # the hash that stands for the constant term

SENTENCES = T.ArrayType(T.StructType([T.StructField("sentence", T.StringType()), T.StructField("score", T.DoubleType())]))


def _ends() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*b".!?\n"]] = True
    return table


_END = _ends()


def sentence_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, hashes, sentence) of the words, and the row of every sentence with words.

    A sentence ends at a full stop, exclamation or question mark, line feed or with its text.
    Sentences without words don't count, and the others are numbered from 0.
    """
    start, end, words = hashed_words(data, bounds, BEGINNINGS)
    if not len(start):
        return start, end, words, start, start
    breaks = _END[data]
    breaks[bounds[1:-1][bounds[1:-1] < len(data)]] = True  # a text's first byte begins a sentence
    part = np.cumsum(breaks)[start]
    fresh = np.concatenate([[True], part[1:] != part[:-1]])
    row = np.searchsorted(bounds, start[fresh], "right") - 1
    return start, end, words, np.cumsum(fresh) - 1, row


def _sample(labels: DataFrame, id: str, label: str, held_out: Column | None, bound: int) -> tuple[DataFrame, dict]:
    """At most `bound` ids of each class, the first by a hash, and how many each class has.

    An id with several labels counts as toxic if one of them says so.
    """
    out = held_out if held_out is not None else F.lit(False)
    usable = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label"), out.alias("out"))
    known = usable.where("id IS NOT NULL AND label IN (0, 1) AND NOT out").groupBy("id").agg(F.max("label").alias("label"))
    known = materialise(known, f"{scratch_path(labels.sparkSession, 'labelled')}")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("id"), F.col("id")]
    parts = [known.where(F.col("label") == value).orderBy(*order).limit(bound) for value in (0, 1)]
    return parts[0].unionAll(parts[1]), sizes


def _tally(words: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    different, place = np.unique(words, return_inverse=True)
    return different, *(np.bincount(place, n, len(different)).astype(np.int64) for n in (toxic, clean))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word or beginning in documents (label, text): how many of each class have it.

    Partial counts go out whenever half a million entries have gathered; they are added up later.
    """
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def gathered() -> pa.RecordBatch:
        different, toxic, clean = _tally(*(np.concatenate(x) for x in zip(*parts)))
        parts.clear()
        columns = [different.view(np.int64), toxic, clean]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["word", "toxic", "clean"])

    for batch in batches:
        labels = batch.column(0).to_numpy()
        for first, data, bounds in byte_chunks(batch.column(1)):
            start, _, hashes = hashed_words(data, bounds, BEGINNINGS)
            found = hashes.ravel()
            row = np.tile(np.searchsorted(bounds, start, "right") - 1, len(hashes))
            order = np.lexsort((row, found))
            found, row = found[order], row[order]
            fresh = np.ones(len(found), bool)
            fresh[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
            label = labels[first + row[fresh]]
            parts.append(_tally(found[fresh], label, 1 - label))
            if sum(len(p[0]) for p in parts) > 500_000:
                yield gathered()
    if parts:
        yield gathered()


def _vocabulary(sample: DataFrame, sizes: dict[int, int]) -> np.ndarray:
    """The words that toxic labels depend on most, sorted."""
    counts = sample.select("label", "text").mapInArrow(_word_counts, "word long, toxic long, clean long")
    total = counts.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    n1, n0 = (float(sizes.get(k, 0)) for k in (1, 0))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    n = n0 + n1
    chi = n * F.pow(a * (n0 - b) - b * (n1 - a), F.lit(2)) / ((a + b) * (n - a - b) * n1 * n0)
    best = (
        total.where((F.col("a") >= SUPPORT) & (a / n1 >= LIFT * b / n0))
        .withColumn("chi", F.when(F.col("a") + F.col("b") < n, chi))
        .where(F.col("chi") >= CHI_SQUARE)
        .orderBy(F.desc("chi"), "word")
        .limit(WORDS)
    )
    return np.sort(np.array([r["word"] for r in best.select("word").collect()], np.int64).view(np.uint64))


def _bags(vocabulary: np.ndarray):
    """Documents (label, text) as bags: sentences, and which words of the model each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_numpy()
            for first, data, bounds in byte_chunks(batch.column(1)):
                bags = []
                _, _, words, sentence, row = sentence_words(data, bounds)
                counts = np.bincount(row, minlength=len(bounds) - 1) if len(row) else np.zeros(len(bounds) - 1, int)
                pairs = _hits(vocabulary, words, sentence)
                bag = row[pairs[0]] if len(row) else pairs[0]
                cuts = np.searchsorted(bag, np.arange(len(bounds)))
                for i in range(len(bounds) - 1):
                    own = pairs[:, cuts[i] : cuts[i + 1]]
                    bags.append((int(labels[first + i]), int(counts[i]), own[0].tolist(), own[1].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b[0] for b in bags], pa.int32()),
                        pa.array([b[1] for b in bags], pa.int64()),
                        pa.array([b[2] for b in bags], pa.list_(pa.int64())),
                        pa.array([b[3] for b in bags], pa.list_(pa.int32())),
                    ],
                    ["label", "sentences", "sentence", "word"],
                )

    return run


_BAGS = "label int, sentences long, sentence array<long>, word array<int>"


def _places(vocabulary: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where each word stands in the sorted vocabulary, -1 if it doesn't."""
    if not len(vocabulary) or not len(words):
        return np.full(len(words), -1, np.int64)
    likely = np.zeros(1 << 16, bool)
    likely[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(likely[(words & np.uint64(0xFFFF)).astype(np.int64)])
    place = np.full(len(words), -1, np.int64)
    near = np.minimum(np.searchsorted(vocabulary, words[maybe]), len(vocabulary) - 1)
    same = vocabulary[near] == words[maybe]
    place[maybe[same]] = near[same]
    return place


def _hits(vocabulary: np.ndarray, words: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Different pairs (sentence, place in the vocabulary), in two rows, by sentence."""
    place = _places(vocabulary, words.ravel()).reshape(words.shape)
    kind, at = np.nonzero(place >= 0)
    return np.unique(np.stack([sentence[at], place[kind, at]]), axis=1)


def fit_noisy_or(
    labels: np.ndarray, counts: np.ndarray, bag: np.ndarray, sentence: np.ndarray, word: np.ndarray, words: int, prior: np.ndarray
) -> np.ndarray:
    """Weights of `words` words, and the constant last, by gradient descent (Adam).

    `bag`, `sentence` (numbered through) and `word` are the words in sentences; `counts` how
    many sentences each bag has; `prior` what a bag counts for.
    """
    different, of = np.unique(sentence, return_inverse=True)
    sentence_bag = np.zeros(len(different), np.int64)
    sentence_bag[of] = bag
    plain = counts - np.bincount(sentence_bag, minlength=len(counts))
    weights = np.zeros(words + 1)
    weights[-1] = -5.0
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    toxic = labels == 1
    for step in range(1, STEPS + 1):
        z = weights[-1] + np.bincount(of, weights[word], len(different))
        soft, soft0 = np.logaddexp(0, z), np.logaddexp(0, weights[-1])
        none = -np.bincount(sentence_bag, soft, len(counts)) - plain * soft0  # log of no toxic sentence
        odds = np.where(toxic, -1 / np.expm1(np.maximum(-none, 1e-12)), 1.0) * prior
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-weights[-1]))
        slope = odds[sentence_bag] * p
        gradient = np.empty_like(weights)
        gradient[:-1] = np.bincount(word, slope[of], words)
        gradient[-1] = slope.sum() + (odds * plain).sum() * p0
        gradient /= max(prior.sum(), 1e-12)
        gradient[:-1] += PENALTY / len(labels) * weights[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = 0.2 if step < STEPS * 2 // 3 else 0.02
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return weights


def _fit(vocabulary: np.ndarray, sizes: dict[int, int], in_sample: dict[int, int]):
    """One task fits the bags of the bounded sample."""
    prior = {k: sizes[k] / in_sample[k] for k in in_sample if in_sample[k]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        labels, counts = table["label"].to_numpy(), table["sentences"].to_numpy()
        sentences, words = (table[name].combine_chunks() for name in ("sentence", "word"))
        bag = np.repeat(np.arange(len(labels)), sentences.value_lengths().to_numpy())
        sentence, word = sentences.flatten().to_numpy(), words.flatten().to_numpy().astype(np.int64)
        own = (np.cumsum(counts) - counts)[bag] + sentence  # numbered through
        weight = np.array([prior[k] for k in labels.tolist()])
        fitted = fit_noisy_or(labels, counts, bag, own, word, len(vocabulary), weight)
        names = np.concatenate([vocabulary.view(np.int64), [_BIAS]])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(fitted)], ["word", "weight"])

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    held_out: Column | None = None,
    sample: int = SAMPLE,
) -> DataFrame:
    """The model (word hash, weight; hash 0 is the constant), from labelled documents.

    `labels` has the id and a label 0 or 1; rows where `held_out` holds, and any other label
    or a NULL, are not learned from. A model is fitted to at most `sample` documents of each
    class, the first by a hash of the id, weighed as their whole class; this bound makes it
    safe to send the sample's ids to all executors and its bags of words to one task. Without
    toxic documents to learn from the model is empty, and every score 0.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = scratch_path(spark, "toxicity")
    ids, sizes = _sample(labels, id, label, held_out, sample)
    if not sizes.get(1):
        return spark.createDataFrame([], _MODEL)
    ids = materialise(ids, f"{folder}/ids")
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    chosen = materialise(texts.join(F.broadcast(ids), "id").select("label", "text"), f"{folder}/sample")
    in_sample = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not in_sample.get(1):
        return spark.createDataFrame([], _MODEL)
    vocabulary = _vocabulary(chosen, in_sample) if in_sample.get(0) else np.zeros(0, np.uint64)
    bags = chosen.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_bags(vocabulary), _BAGS)
    model = bags.repartition(1).sortWithinPartitions("label", "sentences", "sentence", "word")
    return materialise(model.mapInArrow(_fit(vocabulary, sizes, in_sample), _MODEL), f"{folder}/model")


def _score_chunk(
    data: np.ndarray, bounds: np.ndarray, vocabulary: np.ndarray, weights: np.ndarray, bias: float, least: float
) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores of the rows of a chunk, and each row's sentences that score `least` or more."""
    rows = len(bounds) - 1
    start, end, words, sentence, row = sentence_words(data, bounds)
    if not len(row):
        return np.zeros(rows), [[] for _ in range(rows)]
    pairs = _hits(vocabulary, words, sentence)
    z = np.full(len(row), bias)
    np.add.at(z, pairs[0], weights[pairs[1]])
    scores = -np.expm1(-np.bincount(row, np.logaddexp(0, z), rows))
    blamed: list[list[dict]] = [[] for _ in range(rows)]
    p = 1 / (1 + np.exp(-z))
    begin = np.searchsorted(sentence, np.arange(len(row)))
    for s in np.flatnonzero(p >= least).tolist():
        last = begin[s + 1] if s + 1 < len(begin) else len(start)
        span = data[start[begin[s]] : end[last - 1]].tobytes().decode("utf-8", "replace")
        blamed[row[s]].append({"sentence": span, "score": float(p[s])})
    return np.clip(scores, 0.0, 1.0), blamed


def score(docs: DataFrame, model: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """All columns of `docs`, and `score`, `predicted` and `toxic_sentences`.

    Names that are taken get an underscore. A NULL, an empty text and one without words score
    0. A repeated row is scored again, alike. `toxic_sentences` are those that score `least` or
    more, in the order of the text. The model has at most WORDS words, so it is sent to every task.
    """
    spark = docs.sparkSession
    ship(spark)
    fitted = {r["word"]: r["weight"] for r in model.collect()}
    bias = fitted.pop(_BIAS, -np.inf)
    order = np.argsort(np.array(list(fitted), np.int64).view(np.uint64))
    vocabulary = np.array(list(fitted), np.int64).view(np.uint64)[order]
    weights = np.array(list(fitted.values()), np.float64)[order]
    added = [fresh_name(docs, n) for n in ("score", "predicted", "toxic_sentences")]
    schema = T.StructType(
        [*docs.schema.fields, *map(T.StructField, added, (T.DoubleType(), T.IntegerType(), SENTENCES))]
    )
    kind = pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_score_chunk(d, b, vocabulary, weights, bias, least) for _, d, b in byte_chunks(batch.column(at))]
            scores = np.concatenate([p[0] for p in parts] or [np.zeros(0)])
            columns = [
                pa.array(scores),
                pa.array((scores >= 0.5).astype(np.int32)),
                pa.array([b for p in parts for b in p[1]], kind),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *added])

    return docs.mapInArrow(run, schema)


def reject(docs: DataFrame, model: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that aren't predicted to be toxic, with their own columns."""
    scored = score(docs, model, text)
    return scored.where(F.col(scored.columns[-2]) == 0).select(*docs.columns)
