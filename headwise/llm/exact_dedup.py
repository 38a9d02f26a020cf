"""Exact copies by a tree-merge of sorted digest runs; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.session import materialise, scratch_path

#: Runs at the leaves of the tree, and how many of them one merge takes in (2: a binomial tree).
RUNS, FAN_IN = 16, 2


def normalised(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


_KEYS = ("sha", "size", "check")


def _reduced(entries: DataFrame) -> DataFrame:
    """One entry per run and digest, with the best row and the number of copies.

    An entry's key is the digest with the length and a second hash of what was
    digested, so that rows are held to be equal only if all three agree.
    """
    return entries.groupBy("run", *_KEYS).agg(F.min("best").alias("best"), F.sum("copies").alias("copies"))


def _merged(runs: DataFrame, width: int) -> DataFrame:
    """Every run merged into the first of the `width` neighbours it stands among.

    Entries are dealt by ranges of (receiving run, digest), so the entries of a digest stand next to each
    other once each range is sorted; the reduction takes that partitioning and order as they
    are. A digest has one entry per run by then, so no range is heavy, whatever the group.
    """
    received = runs.withColumn("run", F.col("run") - F.pmod("run", F.lit(width)))
    return _reduced(received.repartitionByRange("run", "sha").sortWithinPartitions("run", *_KEYS))


def exact_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", runs: int = RUNS, fan_in: int = FAN_IN
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept and text_sha256 (hex).

    Texts are equal when they agree after white space is deleted; a NULL counts as empty.
    The row with the most code points stays, then the smallest id (a missing id comes
    last). Rows that repeat the id that stays are told apart by nothing, so they all count
    as kept. No documents give no rows.

    Digests are taken once, text is never shuffled. Each of `runs` leaf runs keeps one entry per
    digest, reduced before its shuffle, so a group of copies arrives in each run as one
    entry per map task. In round k of the tree, run r + 2^k goes to run r, if r is a multiple of 2^(k+1) (for
    the usual `fan_in` of 2): both are sorted by digest and merged, keeping the best verified row of each
    digest and adding up the copies, until run 0 holds all. A run is spread over ranges of
    digests, so none is ever one task's work. Every round is written, so a lost executor costs one round's tasks.
    """
    folder = scratch_path(docs.sparkSession, "exact")
    text_left = normalised(F.col(text))
    digests = materialise(
        docs.select(
            F.col(id).alias("id"),
            F.length(F.coalesce(F.col(text), F.lit(""))).alias("length"),
            text_left.alias("left"),
            F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"),
        ).select(
            "id",
            "run",
            "length",
            F.unhex(F.sha2("left", 256)).alias("sha"),
            F.octet_length("left").alias("size"),
            F.xxhash64("left").alias("check"),
        ),
        f"{folder}/digests",
    )
    best = F.struct((-F.col("length")).alias("rank"), F.col("id").isNull().alias("nameless"), "id")
    entries = digests.select("run", "sha", "size", "check", best.alias("best"), F.lit(1).cast("long").alias("copies"))
    merged = materialise(_reduced(entries).sortWithinPartitions("run", *_KEYS), f"{folder}/leaves")
    width = 1
    while width < runs:
        width *= fan_in
        merged = materialise(_merged(merged, width), f"{folder}/width={width}")
    found = merged.select(*_KEYS, F.col("best.id").alias("keep_id"), F.col("best.rank").alias("rank"), "copies")
    return digests.join(found, list(_KEYS)).select(
        F.col("id").alias(id),
        "keep_id",
        F.col("copies").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("length") == -F.col("rank"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
