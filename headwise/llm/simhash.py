"""Near-duplicate documents by SimHash fingerprints within a few bits of each other."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwise.llm.common import fresh_name, ship
from headwise.llm.components import connected_components
from headwise.session import materialise, scratch_path

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, shingle: int, seed: int) -> list[int]:
    """XXH64 of every run of `shingle` words, A-Z lower-cased, joined by one space."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxh64_intdigest(joined, seed)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [
        xxh64_intdigest(joined[a:b], seed)
        for a, b in zip(starts[: 1 - shingle or None].tolist(), ends[shingle - 1 :].tolist())
    ]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document, the 64 bits that are set in over half of its hashes.

    `hashes` holds the documents' hashes one after another, `counts` how many each has.
    Eight bits are counted at once in the bytes of a 64-bit sum, over at most 255 hashes.
    """
    result = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return result
    each = counts[full]
    blocks = -(-each // 255)
    doc_start = np.cumsum(each) - each
    first_block = np.cumsum(blocks) - blocks
    within = np.arange(blocks.sum()) - np.repeat(first_block, blocks)
    starts = np.repeat(doc_start, blocks) + 255 * within
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, starts)
        lanes = sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(lanes, first_block, axis=0)
        set_bits = (2 * ones > each[:, None]).astype(np.uint64)
        shifts = (8 * np.arange(8) + bit).astype(np.uint64)
        result[full] |= np.bitwise_or.reduce(set_bits << shifts, axis=1)
    return result


def fingerprint_batch(texts: pa.Array, shingle: int, seed: int, limit: int = 1 << 19) -> np.ndarray:
    """Fingerprints of a batch, some hundred thousand hashes at a time."""
    done: list[np.ndarray] = []
    hashes: list[int] = []
    counts: list[int] = []

    def flush() -> None:
        done.append(majority_bits(np.array(hashes, np.uint64), np.array(counts, np.int64)))
        hashes.clear()
        counts.clear()

    for text in texts.cast(pa.large_string()).cast(pa.large_binary()):
        own = shingle_hashes(text.as_py() or b"", shingle, seed)
        hashes += own
        counts.append(len(own))
        if len(hashes) > limit:
            flush()
    flush()
    return np.concatenate(done)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """The columns of `docs` but its text, and `fingerprint` (long, the 64 bits as they are).

    A text without words, a NULL or an empty text has fingerprint zero; one with fewer words
    than a shingle is one shingle.
    """
    ship(docs.sparkSession)
    name = fresh_name(docs, "fingerprint")
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = fingerprint_batch(batch.column(batch.schema.get_field_index(text)), shingle, seed)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bits.view(np.int64))], [*kept, name])

    return docs.select(*kept, text).mapInArrow(run, schema)


def ball(fingerprint: Column, radius: int, segments: int = 2) -> Column:
    """Array of structs (point, flips): all 64-bit values within `radius` flipped bits.

    Flips are enumerated segment by segment, from fixed masks.
    """
    width = 64 // segments
    places = [range(s * width, (s + 1) * width) for s in range(segments)]
    masks = {0: 0}
    for flips in range(1, radius + 1):
        for bits in combinations(chain.from_iterable(places), flips):
            masks[sum(1 << b for b in bits)] = flips
    signed = [(m - (1 << 64) if m >> 63 else m, flips) for m, flips in masks.items()]
    table = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(flips).alias("flips")) for m, flips in signed])
    return F.transform(
        table, lambda m: F.struct(fingerprint.bitwiseXOR(m["mask"]).alias("point"), m["flips"].alias("flips"))
    )


def links(distinct_fingerprints: DataFrame, distance: int) -> DataFrame:
    """Edges (src, dst) that join all fingerprints within `distance` bits of each other.

    Multi-index hashing in which both sides enumerate small balls: a fingerprint enters
    the table under every value that flips few bits of one segment, and two fingerprints
    within `distance` bits always meet under a value in between (floor of half the distance
    from one, ceiling from the other). All that meet are joined to the smallest of them whose
    ball is the narrower one, and each such match is verified on all 64 bits. So no pairs
    of a crowded bucket are formed: a fingerprint gives 65 rows at distance 2, however many
    others are near it.
    """
    wide, narrow = -(-distance // 2), distance // 2
    rows = (
        distinct_fingerprints.select("fingerprint", F.explode(ball(F.col("fingerprint"), wide)).alias("b"))
        .select("fingerprint", "b.point", "b.flips")
    )
    near = F.when(F.col("flips") <= narrow, F.col("fingerprint"))
    meeting = rows.withColumn("least", F.min(near).over(Window.partitionBy("point")))
    return (
        meeting.where(F.col("least") != F.col("fingerprint"))
        .where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("least"))) <= distance)
        .select(F.col("fingerprint").alias("src"), F.col("least").alias("dst"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    distance: int = 2,
    seed: int = 42,
) -> DataFrame:
    """One row per document: id, `fingerprint` (long) and `component_id`.

    Documents are linked when their fingerprints differ in `distance` bits or fewer, and
    component_id is the smallest id that can be reached over links, the own id included.
    Equal fingerprints are one node of the graph, so copies cost one row. Rows with a NULL
    id are fingerprinted and linked, and never name a component unless it has no other id.
    Repeated rows stay. No documents give no rows.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "simhash")
    prints = materialise(
        fingerprints(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", shingle, seed),
        f"{folder}/prints",
    )
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min("id").alias("least_id")), f"{folder}/nodes")
    roots = connected_components(links(nodes.select("fingerprint"), distance))
    rooted = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialise(rooted.join(least, "root").select("fingerprint", "component_id"), f"{folder}/named")
    return prints.join(named, "fingerprint").select(F.col("id").alias(id), "fingerprint", "component_id")


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stand for their group: those whose id is its component_id.

    All columns stay. Of rows that repeat both id and fingerprint, one stays (the first by
    the hash of all columns). A row without an id can neither stand for a group nor be
    told from others, so it stays.
    """
    folder = scratch_path(docs.sparkSession, "representatives")
    classes = materialise(near_duplicates(docs, id, text, **options), f"{folder}/classes").where(
        F.col(id).isNotNull()
    )
    repeated = materialise(
        classes.groupBy(id).agg(F.count("*").alias("n")).where("n > 1").select(id), f"{folder}/repeated"
    )
    gone = materialise(
        classes.where(F.col(id) != F.col("component_id")).select(id).unionAll(repeated).distinct(), f"{folder}/gone"
    )
    row = fresh_name(docs, "row")
    again = fingerprints(
        docs.join(repeated, id, "left_semi").select(
            F.col(id).alias("id"), F.struct(*docs.columns).alias(row), F.col(text).alias("text")
        ),
        "text",
        options.get("shingle", 3),
        options.get("seed", 42),
    )
    order = Window.partitionBy("id", "fingerprint").orderBy(F.xxhash64(row))
    first = again.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    standing = classes.where(F.col(id) == F.col("component_id")).select(F.col(id).alias("id"), "fingerprint").distinct()
    return docs.join(gone, id, "left_anti").select(*docs.columns).unionAll(
        first.join(standing, ["id", "fingerprint"], "left_semi").select(f"{row}.*")
    )
