"""What the detectors need from the published timetable."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwise.functions import clock_seconds, to_number
from headwise.operators.ranking import one_per_key

STOP_GROUP = ["service_id", "route_id", "direction_id", "stop_id"]


def parse_stop_times(stop_times: DataFrame) -> DataFrame:
    """Typed stop times; rows without a readable clock time are dropped."""
    return stop_times.select(
        "trip_id",
        "stop_id",
        "stop_sequence",
        clock_seconds(F.col("arrival_time")).alias("scheduled_arrival_seconds"),
        to_number(F.col("stop_sequence")).alias("stop_sequence_num"),
    ).where(F.col("scheduled_arrival_seconds").isNotNull())


def trip_dimension(trips: DataFrame) -> DataFrame:
    """One (direction_id, trip_headsign, route_id) per trip."""
    return one_per_key(trips.select("trip_id", "route_id", "direction_id", "trip_headsign"), "trip_id")


def trip_terminal_stops(timed: DataFrame) -> DataFrame:
    """First and last timed stop of every trip, one row per distinct stop."""
    place = F.struct("stop_sequence_num", "scheduled_arrival_seconds", "stop_id")
    ends = (
        timed.dropna(subset=["trip_id", "stop_id", "stop_sequence_num"])
        .groupBy("trip_id")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
    )
    stops = F.array_distinct(F.array("first.stop_id", "last.stop_id"))
    return ends.select("trip_id", F.explode(stops).alias("stop_id"))


def trip_stop_schedule(timed: DataFrame) -> DataFrame:
    """One scheduled arrival per (trip, stop): that of the lowest sequence, then time."""
    sequence = F.coalesce("stop_sequence_num", F.lit(float("inf")))
    return (
        timed.dropna(subset=["trip_id", "stop_id"])
        .groupBy("trip_id", "stop_id")
        .agg(F.min(F.struct(sequence.alias("seq"), "scheduled_arrival_seconds")).alias("__first"))
        .select("trip_id", "stop_id", "__first.scheduled_arrival_seconds")
    )


def stop_facts(timed: DataFrame) -> DataFrame:
    """Scheduled arrival and terminal flag, one row per (trip, stop).

    The same as `trip_stop_schedule` with `trip_terminal_stops` joined to it, from one
    scan: each stop's lowest and highest place in the trip is enough to tell the ends. Stop times are
    dealt by trip, which serves the stops, the ends and `facts_by_trip`.
    """
    place = F.when(
        F.col("stop_sequence_num").isNotNull(),
        F.struct("stop_sequence_num", "scheduled_arrival_seconds", "stop_id"),
    )
    trip = Window.partitionBy("trip_id")
    return (
        timed.dropna(subset=["trip_id", "stop_id"])
        .repartition("trip_id")
        .groupBy("trip_id", "stop_id")
        .agg(
            F.min(place).alias("low"),
            F.max(place).alias("high"),
            F.min("scheduled_arrival_seconds").alias("earliest"),
        )
        .select(
            "trip_id",
            "stop_id",
            F.coalesce("low.scheduled_arrival_seconds", "earliest").alias("scheduled_arrival_seconds"),
            F.coalesce(
                (F.col("low") == F.min("low").over(trip)) | (F.col("high") == F.max("high").over(trip)),
                F.lit(False),
            ).alias("is_terminal"),
        )
    )


def facts_by_trip(facts: DataFrame) -> DataFrame:
    """The facts of all stops of a trip in one row, by stop_id; `facts` comes from `stop_facts`."""
    stop = F.struct("stop_id", F.struct("scheduled_arrival_seconds", "is_terminal"))
    return facts.groupBy("trip_id").agg(F.map_from_entries(F.collect_list(stop)).alias("stops"))


def scheduled_gaps(timed: DataFrame, trips: DataFrame, max_gap_seconds: float) -> DataFrame:
    """Gaps between successive scheduled arrivals, kept where 0 < gap <= max.

    Equal times give gaps of zero, which are not valid, so the window may run over the
    distinct times. That also bounds its groups by the seconds of a service day.
    """
    arrivals = (
        timed.where(F.col("stop_id").isNotNull())
        .join(trips.select("trip_id", "service_id", "route_id", "direction_id"), "trip_id")
        .select(*STOP_GROUP, "scheduled_arrival_seconds")
        .distinct()
    )
    window = Window.partitionBy(*STOP_GROUP).orderBy("scheduled_arrival_seconds")
    gap = F.col("scheduled_arrival_seconds") - F.lag("scheduled_arrival_seconds").over(window)
    return arrivals.withColumn("scheduled_gap_seconds", gap).where(
        (F.col("scheduled_gap_seconds") > 0) & (F.col("scheduled_gap_seconds") <= max_gap_seconds)
    )


def fallback_headways(gaps: DataFrame) -> DataFrame:
    """Exact median gap per route, direction and stop, across service ids."""
    return gaps.groupBy("route_id", "direction_id", "stop_id").agg(
        F.median("scheduled_gap_seconds").alias("fallback_headway_seconds")
    )
