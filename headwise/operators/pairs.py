"""Adjacent vehicle pairs and the thresholds they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.config import ScheduledConfig
from headwise.operators.adjacency import with_previous

# Where a scheduled headway came from: fixed values.
FROM_TRIP_PAIR = "trip_pair"
FROM_MEDIAN = "route_stop_median"
FROM_DEFAULT = "default"

# Slots per group window. Twelve caps per slot send 1/12 of the rows twice.
_CAPS_PER_SLOT = 12
_DEFAULT_SLOT_SECONDS = 7200


def observed_headways(updates: DataFrame, max_gap: int | None = None) -> DataFrame:
    """Gap to the previous vehicle per snapshot, route and stop.

    `updates` comes from `counted_updates`. Copies of one observation follow each
    other at a gap of zero, so a row standing for n > 1 yields the first copy with its
    true predecessor and one row for the n - 1 self-pairs. With `max_gap` only gaps up
    to it are returned, otherwise every row is, the first of a group with NULLs.
    """
    width = _DEFAULT_SLOT_SECONDS if max_gap is None else max(max_gap * _CAPS_PER_SLOT, 1)
    linked = with_previous(
        updates,
        group=["logged_at", "route_id", "stop_id"],
        time="arrival_time",
        order=["trip_id", "stop_sequence"],
        carry={"prev_trip_id": "trip_id", "prev_arrival_time": "arrival_time"},
        width=width,
        max_gap=max_gap,
        place=["route_id", "stop_id"],
    )
    n = F.col("observations")
    already_self = F.coalesce(
        (F.col("prev_trip_id") == F.col("trip_id"))
        & (F.col("prev_arrival_time") == F.col("arrival_time")),
        F.lit(False),
    )

    def link(trip: Column | str, arrival: Column | str, count: Column) -> Column:
        return F.struct(
            F.col(trip).alias("prev_trip_id"),
            F.col(arrival).alias("prev_arrival_time"),
            count.alias("observations"),
        )

    links = (
        F.when((n == 1) | already_self, F.array(link("prev_trip_id", "prev_arrival_time", n)))
        .otherwise(
            F.array(
                link("prev_trip_id", "prev_arrival_time", F.lit(1).cast("bigint")),
                link("trip_id", "arrival_time", n - 1),
            )
        )
    )
    kept = ["logged_at", "route_id", "stop_id", "trip_id", "stop_sequence", "arrival_time"]
    headways = (
        linked.select(*kept, F.explode(links).alias("link"))
        .select(*kept, "link.*")
        .withColumn("headway_seconds", F.col("arrival_time") - F.col("prev_arrival_time"))
    )
    return headways if max_gap is None else headways.where(F.col("headway_seconds").between(0, max_gap))


def candidate_pairs(updates: DataFrame, config: ScheduledConfig, carry: list[str] | None = None) -> DataFrame:
    """Neighbours in one capture, snapshot, route, direction and stop, within the cap.

    `updates` comes from `distinct_updates` and `with_direction`. Every name in `carry`
    is brought along twice, as `lead_<name>` and `trailing_<name>`. The cap is the upper
    clip bound of the threshold, so nothing that could pass is lost. A vehicle whose
    predecessor in the order is itself is dropped here, after the lag.
    """
    carry = ["trip_id", "arrival_time", *(carry or [])]
    cap = config.candidate_cap_seconds
    linked = with_previous(
        updates,
        group=["logged_at", "source_db", "route_id", "stop_id", "direction_id"],  # sorted by a number first
        time="arrival_time",
        order=["trip_id", "stop_sequence"],
        carry={f"lead_{name}": name for name in carry},
        width=max(cap * _CAPS_PER_SLOT, 1),
        max_gap=cap,
        place=["route_id", "stop_id", "direction_id"],
    ).withColumnsRenamed({name: f"trailing_{name}" for name in carry})
    gap = F.col("trailing_arrival_time") - F.col("lead_arrival_time")
    return linked.withColumn("actual_headway_seconds", gap).where(
        F.col("lead_trip_id").isNotNull()
        & (F.col("trailing_trip_id") != F.col("lead_trip_id"))
        & F.col("actual_headway_seconds").between(0, cap)
    )


def with_stop_facts(updates: DataFrame, facts: DataFrame) -> DataFrame:
    """Scheduled arrival and terminal flag of each observation, before the pairing.

    One join here replaces the four lookups that each finished pair would need. `facts` comes from
    `facts_by_trip`: observations that are dealt by trip are joined where they are.
    """
    fact = F.element_at("stops", F.col("stop_id"))
    return (
        updates.join(facts, "trip_id", "left")
        .withColumns(
            {
                "scheduled_arrival_seconds": fact["scheduled_arrival_seconds"],
                "is_terminal": F.coalesce(fact["is_terminal"], F.lit(False)),
            }
        )
        .drop("stops")
    )


STOP_FACTS = ["scheduled_arrival_seconds", "is_terminal"]


def drop_terminal_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with neither vehicle at a terminal of its own trip."""
    return pairs.where(~F.col("lead_is_terminal") & ~F.col("trailing_is_terminal")).drop(
        "lead_is_terminal", "trailing_is_terminal"
    )


def pair_headway(pairs: DataFrame, config: ScheduledConfig) -> DataFrame:
    """Scheduled headway of the two trips at the stop, NULL unless 0 < gap <= max."""
    gap = F.abs(F.col("trailing_scheduled_arrival_seconds") - F.col("lead_scheduled_arrival_seconds"))
    valid = (gap > 0) & (gap <= config.max_scheduled_headway_seconds)
    return pairs.withColumn("scheduled_headway_seconds", F.when(valid, gap.cast("double")))


def resolve_headway(pairs: DataFrame, fallback: DataFrame, config: ScheduledConfig) -> DataFrame:
    """Pair headway, else the route/direction/stop median, else the default."""
    own, median = F.col("scheduled_headway_seconds"), F.col("fallback_headway_seconds")
    source = (
        F.when(own.isNotNull(), FROM_TRIP_PAIR).when(median.isNotNull(), FROM_MEDIAN).otherwise(FROM_DEFAULT)
    )
    default = F.lit(config.fallback_headway_seconds)
    return pairs.join(fallback, ["route_id", "direction_id", "stop_id"], "left").withColumns(
        {"headway_source": source, "scheduled_headway_seconds": F.coalesce(own, median, default)}
    )


def keep_bunched(pairs: DataFrame, config: ScheduledConfig) -> DataFrame:
    """Pairs no further apart than their clipped share of the scheduled headway."""
    share = F.col("scheduled_headway_seconds") * F.lit(config.threshold_ratio)
    threshold = F.greatest(
        F.least(share, F.lit(config.max_bunch_seconds)), F.lit(config.min_bunch_seconds)
    )
    return pairs.withColumn("bunch_threshold_seconds", threshold).where(
        F.col("actual_headway_seconds") <= F.col("bunch_threshold_seconds")
    )
