"""Mixing sources to target weights; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwise.llm.common import fresh_name
from headwise.session import materialise, scratch_path

#: Weights dealt to the sources in code point order, and the most copies of a document.
WEIGHTS, MOST = (5, 2, 1), 3
#: Hex digits of the seeded hash that decide the extra copy: 52 bits, exact in a double.
_DIGITS = 13


def word_count(text: Column) -> Column:
    """Words in a text; a NULL has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size) of documents.

    Sources are weighted in code point order, NULL last, by `weights` again and again. They share
    the whole size by weight; a target above `most` times its source's size stops there
    and the excess goes to the others by weight, until none is above. That has a closed
    form: sources in order of size by weight are full up to some place, and all after it
    share what is left by weight, so one ordered pass over the sources is enough.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    alphabetic = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = totals.withColumn("nth", F.row_number().over(alphabetic) - 1).withColumn(
        "weight", F.element_at(cycle, (F.col("nth") % len(weights) + 1).cast("int"))
    )
    everything = Window.partitionBy()
    fullest = Window.orderBy(F.col("source_size") / F.col("weight"), "nth")
    later = fullest.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    earlier = fullest.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.lit(float(most)) * F.col("source_size")
    levels = weighed.select(
        "source",
        "source_size",
        "weight",
        F.row_number().over(fullest).alias("place"),
        cap.alias("cap"),
        (
            (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0)))
            / F.sum("weight").over(later)
        ).alias("level"),
    )
    # The level of the first source that does not fill up holds for it and all after it.
    own = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("place", "level"))
    return levels.withColumn("shared", F.min(own).over(everything)["level"]).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("shared") * F.col("weight"), "cap")).alias("target")
    )


def uniform(id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on nothing but the id and the seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _DIGITS), 16, 10).cast("long") / F.lit(float(16**_DIGITS))


def copies(rate: Column, id: Column, seed: int) -> Column:
    """floor(rate), and one more with a probability equal to the fraction."""
    whole = F.floor(rate)
    return (whole + F.when(uniform(id, seed) < rate - whole, 1).otherwise(0)).cast("long")


def plan(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: float = MOST,
    seed: int = 7,
) -> DataFrame:
    """Per document: its id, size, source_size, target and `copies`.

    A document without words has size 0, a source of such documents target 0 and no copies.
    Rows that repeat an id share their draw. Rows without an id share one too. No documents
    give no rows. Counting reads the text once; what is joined back is one row per source.
    """
    folder = scratch_path(docs.sparkSession, "mixing")
    sizes = materialise(
        docs.select(F.col(id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")),
        f"{folder}/sizes",
    )
    targets = materialise(source_targets(sizes, weights, most), f"{folder}/targets")
    return _with_copies(sizes, targets, most, seed).select(
        F.col("id").alias(id), "size", "source_size", "target", "copies"
    )


def _with_copies(sizes: DataFrame, targets: DataFrame, most: float, seed: int) -> DataFrame:
    named = targets.withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size")))
    return sizes.join(named, F.col("source").eqNullSafe(F.col("of_source"))).withColumn(
        "copies", copies(F.coalesce(rate, F.lit(0.0)), F.col("id"), seed)
    )


def mix(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: float = MOST,
    seed: int = 7,
) -> DataFrame:
    """The documents of the mix: every row as often as its plan says, all columns as they are."""
    folder = scratch_path(docs.sparkSession, "mixing")
    sizes = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    targets = materialise(source_targets(sizes, weights, most), f"{folder}/targets")
    row = fresh_name(docs, "row")
    rows = docs.select(F.struct(*docs.columns).alias(row), F.col(id).alias("id"), F.col(source).alias("source"))
    return (
        _with_copies(rows, targets, most, seed)
        .where("copies > 0")
        .select(row, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(f"{row}.*")
    )
