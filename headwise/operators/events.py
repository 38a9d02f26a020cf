"""From bunched observations to events: local time, labels, dedupe, collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwise.functions import blank_to_null, local_date, local_hour, local_text
from headwise.operators.ranking import one_per_key
from headwise.schemas import EVENTS

# One observation of one pair, whichever capture it was read from. Here and below trips come first: rows are sorted by
# these columns in order, and trips tell most of them apart.
OBSERVATION = [
    "lead_trip_id",
    "trailing_trip_id",
    "route_id",
    "direction_id",
    "stop_id",
    "logged_at",
    "feed_timestamp",
    "lead_arrival_time",
    "trailing_arrival_time",
]

# One pair at one stop on one day. Labels follow from these and are joined later.
EVENT = ["lead_trip_id", "trailing_trip_id", "event_date", "route_id", "direction_id", "stop_id"]


def localise(pairs: DataFrame, zone: str) -> DataFrame:
    """Date and hour of the trailing arrival in the agency's time zone."""
    arrival = F.col("trailing_arrival_time")
    return pairs.withColumns({"event_date": local_date(arrival, zone), "event_hour": local_hour(arrival, zone)})


def with_local_text(pairs: DataFrame, zone: str) -> DataFrame:
    """Readable local times of both arrivals and of the snapshot."""
    return pairs.withColumns(
        {
            "lead_arrival_local": local_text(F.col("lead_arrival_time"), zone),
            "trailing_arrival_local": local_text(F.col("trailing_arrival_time"), zone),
            "snapshot_local": local_text(F.col("feed_timestamp"), zone),
        }
    )


def route_labels(routes: DataFrame) -> DataFrame:
    """Short name or id as label; description or long name appended as name."""
    label = F.coalesce(blank_to_null(F.col("route_short_name")), F.col("route_id"))
    detail = F.coalesce(blank_to_null(F.col("route_desc")), blank_to_null(F.col("route_long_name")))
    named = one_per_key(
        routes.select("route_id", "route_short_name", "route_long_name", "route_desc"), "route_id"
    )
    return named.select(
        "route_id", label.alias("route_label"), F.concat_ws(" - ", label, detail).alias("route_name")
    )


def stop_places(stops: DataFrame) -> DataFrame:
    return one_per_key(stops.select("stop_id", "stop_name", "stop_lat", "stop_lon"), "stop_id")


def with_labels(df: DataFrame, labels: DataFrame, places: DataFrame) -> DataFrame:
    """Route label and name, stop name and position; works on pairs and on events.

    `labels` comes from `route_labels`, `places` from `stop_places`.
    """
    return (
        df.join(labels, "route_id", "left")
        .join(places, "stop_id", "left")
        .withColumns(
            {
                "route_label": F.coalesce("route_label", "route_id"),
                "route_name": F.coalesce("route_name", "route_id"),
                **{c: F.coalesce(c, F.lit("")) for c in ("stop_name", "stop_lat", "stop_lon")},
            }
        )
    )


def with_headsigns(df: DataFrame, trips: DataFrame) -> DataFrame:
    """Headsign of both trips; `trips` has one row per trip_id."""
    for side in ("lead", "trailing"):
        signs = trips.select(
            F.col("trip_id").alias(f"{side}_trip_id"), F.col("trip_headsign").alias(f"{side}_headsign")
        )
        df = df.join(signs, f"{side}_trip_id", "left").withColumn(
            f"{side}_headsign", F.coalesce(f"{side}_headsign", F.lit(""))
        )
    return df


def co_locate_events(pairs: DataFrame) -> DataFrame:
    """One shuffle that both the dedupe and the collapse can use as it is.

    A group is one pair at one stop on one day. Each capture contributes an observation
    once (`distinct_updates`), so a group is bounded by captures times snapshots a day.
    """
    return pairs.repartition(*EVENT)


def dedupe_observations(pairs: DataFrame) -> DataFrame:
    """Each observation once, from the capture that sorts first.

    Rows are sorted by their event first: the collapse finds them in the order it needs.
    """
    rest = [c for c in OBSERVATION if c not in EVENT]
    window = Window.partitionBy(*EVENT, *rest).orderBy("source_db")
    return pairs.withColumn("__copy", F.row_number().over(window)).where("__copy = 1").drop("__copy")


def collapse_observations(pairs: DataFrame, zone: str) -> DataFrame:
    """Events: all sightings of one pair at one stop on one day.

    Extremes of time are taken on epoch seconds and formatted afterwards. The scheduled
    headway, its source and the threshold follow from the two trips, the stop, the route
    and the direction, so they are the same in every row of an event and their minimum
    is also their median. The sets hold the snapshots and captures of one day at most.

    Sightings are summed up in windows over an event, which pass over sorted rows once, and the first row of each event
    stays: most events have a row or two, and a hash aggregate of lists and medians would sort its many groups twice.
    """
    event = Window.partitionBy(*EVENT)
    first_row = F.struct("source_db", "logged_at", "trailing_arrival_time")
    summed = {
        "__seen_from": F.min("feed_timestamp"),
        "__seen_to": F.max("feed_timestamp"),
        "__arrival_from": F.min("trailing_arrival_time"),
        "__arrival_to": F.max("trailing_arrival_time"),
        "event_hour": F.min_by("event_hour", first_row),
        "min_actual_headway_seconds": F.min("actual_headway_seconds"),
        "median_actual_headway_seconds": F.median("actual_headway_seconds"),
        "scheduled_headway_seconds": F.min("scheduled_headway_seconds"),
        "bunch_threshold_seconds": F.min("bunch_threshold_seconds"),
        "__snapshots": F.collect_set("logged_at"),
        "__sources": F.collect_set("source_db"),
        "headway_source": F.min("headway_source"),
    }
    rows = pairs.select(
        *EVENT, "logged_at", *[value.over(event).alias(name) for name, value in summed.items()]
    ).withColumn("__nth", F.row_number().over(event.orderBy("logged_at")))
    spans = {
        "first_seen": "__seen_from",
        "last_seen": "__seen_to",
        "first_predicted_arrival": "__arrival_from",
        "last_predicted_arrival": "__arrival_to",
    }
    return (
        rows.where("__nth = 1")
        .withColumns(
            {
                "snapshots_flagged": F.size("__snapshots").cast("bigint"),
                "source_files": F.array_join(F.array_sort("__sources"), ", "),
                **{name: local_text(F.col(c), zone) for name, c in spans.items()},
            }
        )
        .drop("logged_at", "__nth", "__snapshots", "__sources", *spans.values())
    )


def event_table(events: DataFrame) -> DataFrame:
    """The 25 columns of the event table, in order."""
    return events.select(*EVENTS.fieldNames())
