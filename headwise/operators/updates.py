"""Real-time stop predictions: collapsing copies, trip bounds, direction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Text for a trip that the timetable does not list: a fixed value.
UNKNOWN_DIRECTION = "unknown"

_NO_STAMP = -(2**63)


def nonnull_updates(updates: DataFrame, *columns: str) -> DataFrame:
    """Rows with all of `columns`; unlike `dropna`, the condition reaches the file scan."""
    for column in columns:
        updates = updates.where(F.col(column).isNotNull())
    return updates


def distinct_updates(updates: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per (capture, snapshot, route, stop, trip, arrival, sequence).

    Rows that agree on these are neighbours in the headway order, so only the first of
    them has another vehicle before it. Collapsing them before the window, with a
    map-side combine, changes no pair and bounds a window group by the trips of a slot.
    The kept feed stamp is the lowest, NULL being lowest of all. `carry` names columns that follow from
    the trip and the stop. Looked up before, in a join by trip that shuffles, they leave the rows dealt
    by trip, and copies are collapsed where they are.
    """
    key = ["source_db", "logged_at", "route_id", "stop_id", "trip_id", "arrival_time", "stop_sequence", *carry]
    return (
        updates.groupBy(*key)
        .agg(F.min(F.coalesce("feed_timestamp", F.lit(_NO_STAMP))).alias("__stamp"))
        .withColumn("feed_timestamp", F.nullif("__stamp", F.lit(_NO_STAMP)))
        .drop("__stamp")
    )


def counted_updates(updates: DataFrame) -> DataFrame:
    """One row per (snapshot, route, stop, trip, arrival, sequence) and how many it stands for."""
    key = ["logged_at", "route_id", "stop_id", "trip_id", "arrival_time", "stop_sequence"]
    return updates.groupBy(*key).agg(F.count("*").alias("observations"))


def observed_span(updates: DataFrame) -> DataFrame:
    """From which to which stop_sequence each trip was observed."""
    span = F.struct(F.min("stop_sequence").alias("start"), F.max("stop_sequence").alias("finish"))
    return updates.groupBy("trip_id").agg(span.alias("span")).select("trip_id", "span.*")


def within_span(updates: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows strictly between the ends of their trip's span; a NULL sequence is never between."""
    ends = spans.withColumnRenamed("trip_id", "of_trip")
    between = (F.col("stop_sequence") > F.col("start")) & (F.col("stop_sequence") < F.col("finish"))
    return updates.join(ends, (F.col("trip_id") == F.col("of_trip")) & between, "left_semi")


def with_direction(updates: DataFrame, trips: DataFrame) -> DataFrame:
    """Direction and headsign of each trip; `trips` has one row per trip_id."""
    return updates.join(
        trips.select("trip_id", "direction_id", "trip_headsign"), "trip_id", "left"
    ).withColumns(
        {
            "direction_id": F.coalesce("direction_id", F.lit(UNKNOWN_DIRECTION)),
            "trip_headsign": F.coalesce("trip_headsign", F.lit("")),
        }
    )
