"""How two tokenizers cut the same texts: groups, links and how often ids are linked in the whole corpus."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwise.llm.common import byte_chunks, ship
from headwise.session import materialise, scratch_path

#: Bytes of text aligned at once; a longer text is a block by itself.
BLOCK_BYTES = 1 << 20
#: A pair is one number: B's id in the upper bits, A's in the lower.
_A_BITS = 32
#: Words whose ids a Python worker remembers; beyond that it starts anew.
REMEMBERED = 300_000

# How a byte-level BPE cuts texts into words: a fixed pattern.
_WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# Characters about which all regular expression libraries agree; a text with others is encoded whole.
_AGREED = regex.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*+")

_TEXTS = "array<struct<key: binary, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string, upto: long>>"
_BLOCKS = f"block long, pairs array<long>, weights array<long>, texts {_TEXTS}, at binary, times binary"
#: What is said about a text, and what about a text without tokens.
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable characters of Latin-1 stand for themselves, other bytes for the characters from 256 on.
    """
    own = [b for b in range(256) if chr(b).isprintable() and b != 32]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


class Cutter:
    """One tokenizer: ids of whole texts, and the bytes every id stands for."""

    tokens: list[bytes]

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _ready(self) -> None:
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def gives_back(self, ids: list[list[int]], texts: list[bytes]) -> bool:
        """Whether the tokens of every text are the text."""
        flat = list(chain.from_iterable(ids))
        ends = np.concatenate([[0], np.cumsum(self.lengths[flat])]).astype(np.int64)
        alike = ends[np.cumsum(list(map(len, ids)))] == np.cumsum(list(map(len, texts)))
        return bool(alike.all()) and self.joined(flat) == b"".join(texts)


class ByteLevel(Cutter):
    """A byte-level BPE of the tokenizers library, over a space and the text; special tokens are plain text.

    Such a tokenizer merges bytes within words only, so a text's ids are its words' ids one after another, and each
    different word is encoded once. Whether it cuts into words as the pattern does is
    tried on the tokenizer; if not, texts are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        entries, alphabet = self._tokenizer.get_vocab(with_added_tokens=True), byte_alphabet()
        self.tokens = [b""] * (max(entries.values()) + 1)
        for entry, id in entries.items():
            self.tokens[id] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        self._ready()
        self._known: dict[str, list[int]] = {}
        sample = "I'll  say: \n\n 'naïve' x2,3 -- they've 10\t%  of it’s <|endoftext|>... "
        self._letters = {b: c for c, b in alphabet.items()}
        self._by_word = self._whole([sample])[0] == [i for word in _WORDS.findall(sample) for i in self._word(word)]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> list[int]:
        spelt = word.encode().decode("latin-1").translate(self._letters)
        return [t.id for t in self._tokenizer.model.tokenize(spelt)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        if len(self._known) > REMEMBERED:
            self._known = {}
        known, spaced = self._known, [" " + t for t in texts]
        words = [_WORDS.findall(t) if self._by_word and _AGREED.fullmatch(t) else None for t in spaced]
        known.update({w: self._word(w) for w in {w for own in words if own for w in own if w not in known}})
        return [
            self._whole([t])[0] if own is None else list(chain.from_iterable(map(known.__getitem__, own)))
            for t, own in zip(spaced, words)
        ]


class Pieces(Cutter):
    """A SentencePiece model over the text, to which it adds a space itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.tokens = [
            bytes([int(name[3:5], 16)]) if self._model.is_byte(i) else name.replace("▁", " ").encode()
            for i, name in enumerate(names)
        ]
        self._ready()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@lru_cache
def cutters(path_a: str, path_b: str) -> tuple[Cutter, Cutter]:
    """Both tokenizers, loaded once per Python worker."""
    return tuple(Pieces(p) if p.endswith(".model") else ByteLevel(p) for p in (path_a, path_b))


@lru_cache
def _printed(count: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids in decimal as rows of bytes, how many bytes of a row count); a row has room for a mark."""
    width = len(str(count)) + 1
    rows = np.array([str(i).encode() for i in range(count)], f"S{width}").view(np.uint8).reshape(count, width)
    return rows, (rows != 0).sum(axis=1)


class Alignment:
    """Groups and links of a block of texts, one text after another.

    Both sides' tokens are laid out over the bytes of all texts. Both end at the last byte of every text, so no
    group or link reaches over texts.
    """

    def __init__(self, a: Cutter, b: Cutter, ids_a: list[list[int]], ids_b: list[list[int]]) -> None:
        self._sides = []
        for cutter, ids in ((a, ids_a), (b, ids_b)):
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
            self._sides.append((cutter, counts, flat, np.cumsum(cutter.lengths[flat])))
        (_, self.n_a, _, ends_a), (_, self.n_b, _, ends_b) = self._sides
        size = int(ends_a[-1]) if len(ends_a) else 0
        self._closed = np.zeros((2, size + 1), bool)  # whether a token of the side ends at this byte
        self._closed[0, ends_a] = self._closed[1, ends_b] = True
        self._before = np.cumsum(self._closed, axis=1) - self._closed  # tokens of the side that end before
        both = self._closed[0] & self._closed[1]
        self._group = np.cumsum(both) - both  # the group that this byte's token belongs to
        self._common = np.flatnonzero(both)
        last = np.cumsum(self.n_a) - 1
        self._text_ends = np.where(last >= 0, ends_a[np.maximum(last, 0)], 0) if size else last * 0
        self.n_groups = self._per_text(self._common)

    def _per_text(self, ends: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(ends, self._text_ends, "right"), prepend=0)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(A's id, B's id) of all overlapping token occurrences, text by text: one for each stretch
        between neighbouring ends of either side, since two tokens overlap in one stretch."""
        stretch = np.flatnonzero(self._closed[0] | self._closed[1])
        self.n_links = self._per_text(stretch)
        return tuple(ids[before[stretch]] for (_, _, ids, _), before in zip(self._sides, self._before))

    def group_digests(self) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2,b3` per text; empty text where there are no tokens."""
        total = int(self.n_a.sum() + self.n_b.sum())
        parts = []
        started = np.concatenate([[0], self._before[1][self._common] + 1])  # B's tokens before each group
        passed = self._before[0][self._common] + 1  # A's tokens up to the end of each group
        width = max(_printed(len(c.tokens))[0].shape[1] for c, *_ in self._sides)
        cells, lengths = np.zeros((total, width), np.uint8), np.zeros(total, np.int64)
        for (cutter, _, ids, ends), beside, mark in zip(self._sides, (started, passed), b"|;"):
            group = self._group[ends]
            place = np.arange(len(ids)) + beside[group]
            printed, digits = _printed(len(cutter.tokens))
            own, many = printed[ids], digits[ids]
            own[np.arange(len(ids)), many] = np.where(self._closed.all(axis=0)[ends], mark, ord(","))
            cells[place, : own.shape[1]] = own
            lengths[place] = many + 1
        flat = cells[np.arange(width) < lengths[:, None]].tobytes()
        upto = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(self.n_a + self.n_b)].tolist()
        for low, high in zip([0, *upto], upto):
            parts.append(hashlib.sha256(flat[low : high - 1]).hexdigest() if high > low else "")
        return parts


def aligned_block(texts: list[str], copies: np.ndarray, a: Cutter, b: Cutter) -> dict:
    """A block's texts (none empty) and links: different pairs, their weighted counts, and each text's own pairs.

    `at` and `times` (32-bit numbers) say for one text after another which of the block's pairs it
    has and how often, up to the text's `upto`.
    """
    found = [a.encode(texts), b.encode(texts)]
    spaced = [b" " + text.encode() for text in texts]
    for side, ids in zip((a, b), found):
        if not side.gives_back(ids, spaced):
            for n, whole in enumerate(spaced):
                if side.joined(ids[n]) != whole:
                    found[0][n] = found[1][n] = []
                    spaced[n] = b""
    aligned = Alignment(a, b, *found)
    link_a, link_b = aligned.links()
    pairs, which = np.unique((link_b << _A_BITS) | link_a, return_inverse=True)
    text = np.repeat(np.arange(len(texts)), aligned.n_links)
    own, times = np.unique(text * max(len(pairs), 1) + which, return_counts=True)
    owner, at = np.divmod(own, max(len(pairs), 1))
    weights = np.zeros(len(pairs), np.int64)
    np.add.at(weights, at, times * copies[owner])
    upto = np.searchsorted(owner, np.arange(len(texts)), "right")
    measures = (aligned.n_a, aligned.n_b, aligned.n_groups, aligned.n_links)
    lines = zip(*(m.tolist() for m in measures), aligned.group_digests(), upto.tolist())
    return {"pairs": pairs, "weights": weights, "lines": list(lines), "at": at.astype("<u4"), "times": times.astype("<u4")}


def _blocks(distinct: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per block of different texts (columns key, text, copies), under a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = cutters(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ("key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "upto")
        for batch in batches:
            keys, texts, copies = batch.columns
            for first, _, bounds in byte_chunks(texts, BLOCK_BYTES):
                many = len(bounds) - 1
                part = texts.slice(first, many).to_pylist()
                block = aligned_block(part, copies.slice(first, many).to_numpy(), a, b)
                own = keys.slice(first, many).to_pylist()
                lines = [dict(zip(names, (key, *line))) for key, line in zip(own, block["lines"])]
                types = [*[(n, pa.int64()) for n in names]]
                types[0], types[5] = (names[0], pa.binary()), (names[5], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        *(pa.array([block[c]], kind) for c, kind in zip(("pairs", "weights"), kinds)),
                        pa.array([lines], pa.list_(pa.struct(types))),
                        *(pa.array([block[c].tobytes()], pa.binary()) for c in ("at", "times")),
                    ],
                    ["block", "pairs", "weights", "texts", "at", "times"],
                )
                number += 1

    return distinct.select("key", "text", "copies").mapInArrow(run, _BLOCKS)


def _measured(block: pa.Table, answers: pa.Table) -> pa.Table:
    """Every text of one block with the sums over its links; `answers` has each of its pairs once."""
    order = np.argsort(answers.column("pair").to_numpy())
    count = answers.column("n").to_numpy()[order]
    best = answers.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
    at, times = (np.frombuffer(block.column(c)[0].as_py(), "<u4").astype(np.int64) for c in ("at", "times"))
    texts = pa.concat_arrays(block.column("texts").chunks).flatten()
    upto = texts.field("upto").to_numpy()
    sums = []
    for value in (best, count):
        running = np.concatenate([[0], np.cumsum(value[at] * times)])
        sums.append(pa.array(np.diff(running[upto], prepend=0)))
    names = ("key", "n_a", "n_b", "n_groups", "n_links")
    return pa.Table.from_arrays(
        [*(texts.field(n) for n in names), *sums, texts.field("groups_sha256")],
        [*names, "n_best", "count_sum", "groups_sha256"],
    )


class Aligned:
    """A corpus tokenised twice: `blocks` (one row per block of different texts) and `pairs`.

    `pairs` has id_a, id_b, n (links of the whole corpus that hold the pair) and best (whether
    no pair with the same B id has more), one row per pair that occurs.
    """

    def __init__(self, blocks: DataFrame, counts: DataFrame) -> None:
        self._blocks, self._counts = blocks, counts

    @property
    def pairs(self) -> DataFrame:
        ids = F.col("pair").bitwiseAND((1 << _A_BITS) - 1), F.shiftright("pair", _A_BITS)
        return self._counts.select(ids[0].alias("id_a"), ids[1].alias("id_b"), "n", "best")

    def measures(self) -> DataFrame:
        """One row per different text: `key` (SHA-256 of the text), the measures, groups_sha256.

        A pair's count reaches a block once, however many of its texts have the pair.
        """
        schema = "key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        asked = self._blocks.select(F.col("block").alias("of"), F.explode("pairs").alias("pair"))
        answers = asked.join(self._counts, "pair").select("of", "pair", "n", "best")
        blocks = self._blocks.select("block", "texts", "at", "times")
        return blocks.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_measured, schema)


def _key(text: str):
    return F.unhex(F.sha2(text, 256))


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, text: str = "text") -> Aligned:
    """Tokenise and align every different text once; a text's links count as often as it occurs.

    Texts are shuffled whole and grouped as they are, reduced to one row per text and map
    task before. Each is cut by both tokenizers (a file that ends in .model is a SentencePiece model, any
    other a byte-level one of the tokenizers library), and a block of about 1 MB of texts is
    aligned as arrays. A text is one task's work, however long.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = scratch_path(spark, "alignment")
    full = docs.select(F.col(text).alias("text")).where("text != ''")
    distinct = full.groupBy("text").agg(F.count("*").alias("copies")).withColumn("key", _key("text"))
    blocks = materialise(_blocks(distinct, tokenizer_a, tokenizer_b), f"{folder}/blocks")
    each = blocks.select(F.explode(F.arrays_zip("pairs", "weights")).alias("p")).select("p.pairs", "p.weights")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("weights").alias("n"))
    of_b = Window.partitionBy(F.shiftright("pair", _A_BITS))
    ranked = counts.withColumn("best", F.col("n") == F.max("n").over(of_b))
    return Aligned(blocks, materialise(ranked, f"{folder}/pairs"))


def compare_tokenizers(
    docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is given a space and the text, B the text. Their tokens' bytes must give back that space and text; where one doesn't,
    and for a NULL or empty text, there are no tokens: zeros, and an empty text for groups_sha256. Places
    where tokens of both end cut them into groups. Tokens that overlap in a byte are linked;
    a pair of ids counts as often as it is linked in all documents, copies included.
    n_best are links whose count is the highest of all pairs with their B id, count_sum adds up the counts of
    all links. Repeated rows and rows without an id stay. No documents give no rows.
    """
    measured = materialise(
        align(docs, tokenizer_a, tokenizer_b, text).measures(), scratch_path(docs.sparkSession, "alignment-measures")
    )
    full = F.col(text).isNotNull() & (F.col(text) != "")
    rows = docs.select(F.col(id).alias("id"), F.when(full, _key(text)).alias("key"))
    out = [*MEASURES[:4], "n_best", "count_sum", "groups_sha256"]
    zero = [F.lit(0).cast("long").alias(c) for c in MEASURES]
    known = rows.where("key IS NOT NULL").join(measured, "key").select(F.col("id").alias(id), *out)
    return known.unionAll(rows.where("key IS NULL").select(F.col("id").alias(id), *zero, F.lit("").alias("groups_sha256")))
