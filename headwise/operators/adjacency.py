"""The row just before each row of a group, without giving a hot group to one task.

A window partitioned by the group alone sends the whole group to one task. Here the
group is cut into time slots of `width` seconds and the window runs per (group, slot).
What a slot needs from earlier ones is brought in as context rows, in one of two ways:

* bounded (`max_gap` given): a predecessor further back than `max_gap` is of no
  interest, so rows in the last `max_gap` seconds of a slot also enter the next slot.
  One shuffle; the share of rows sent twice is `max_gap / width`.
* unbounded: the last row of every slot, found by a map-side combined aggregate, enters
  the next slot that has rows.

Both are exact. Context rows are dropped after the lag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SLOT, _CONTEXT = "__slot", "__context"


def with_previous(
    rows: DataFrame,
    group: Sequence[str],
    time: str,
    order: Sequence[str],
    carry: dict[str, str],
    width: int,
    max_gap: int | None = None,
    place: Sequence[str] = (),
) -> DataFrame:
    """Add `carry` = {new column: column of the previous row} by (`time`, *`order`).

    `time` is a non-null bigint in seconds. With `max_gap`, the new columns are exact
    wherever the previous row is at most `max_gap` seconds back; elsewhere they are
    NULL or name a row further back than that, so the caller must filter on the gap.

    With `place`, some columns of the group, rows are dealt by these and the slot alone: what the
    snapshots say of one place and time then travels together, and being much alike it packs well.
    """
    if not set(place) <= set(group):
        raise ValueError("place must be part of the group")
    if max_gap is not None and max_gap > width:
        raise ValueError("max_gap cannot exceed the slot width")
    slotted = (
        _with_tail_copies(rows, time, width, max_gap)
        if max_gap is not None
        else _with_last_rows(rows, group, time, order, width)
    )
    if place:
        slotted = slotted.repartition(*place, _SLOT)
    window = Window.partitionBy(*group, _SLOT).orderBy(time, *order)
    return (
        slotted.select(
            "*", *[F.lag(source).over(window).alias(name) for name, source in carry.items()]
        )
        .where(~F.col(_CONTEXT))
        .drop(_SLOT, _CONTEXT)
    )


def _slot(time: str, width: int) -> Column:
    return F.floor(F.col(time) / F.lit(width))


def _with_tail_copies(rows: DataFrame, time: str, width: int, max_gap: int) -> DataFrame:
    own = F.col("__own")
    in_tail = F.pmod(F.col(time), F.lit(width)) >= width - max_gap
    return (
        rows.withColumn("__own", _slot(time, width))
        .withColumn(_SLOT, F.explode(F.when(in_tail, F.array(own, own + 1)).otherwise(F.array(own))))
        .withColumn(_CONTEXT, F.col(_SLOT) != own)
        .drop("__own")
    )


def _with_last_rows(
    rows: DataFrame, group: Sequence[str], time: str, order: Sequence[str], width: int
) -> DataFrame:
    slotted = rows.withColumn(_SLOT, _slot(time, width))
    # All columns, though few are read: both branches of the union then ask the same of
    # `rows`, and Spark computes its last shuffle once.
    payload = [time, *order, *[c for c in rows.columns if c not in {time, *order, *group}]]
    # One row per (group, slot): the window below sees slots, never observations.
    last = slotted.groupBy(*group, _SLOT).agg(F.max(F.struct(*payload)).alias("__last"))
    by_slot = Window.partitionBy(*group).orderBy(_SLOT)
    context = (
        last.withColumn("__next", F.lead(_SLOT).over(by_slot))
        .where(F.col("__next").isNotNull())
        .select(*group, F.col("__next").alias(_SLOT), "__last.*")
        .withColumn(_CONTEXT, F.lit(True))
    )
    return slotted.withColumn(_CONTEXT, F.lit(False)).unionByName(context)
