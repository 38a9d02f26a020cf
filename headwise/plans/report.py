"""Report tables over the event table: totals, hotspots, per-route where and when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.functions import minutes
from headwise.operators.ranking import top_n, top_n_per

# Fixed sizes of the report's tables.
TOP_ROUTE_DIRECTIONS = 20
TOP_STOPS = 25
TOP_ROUTE_DIRECTION_STOPS = 30
TOP_DATE_HOURS = 30
TOP_PER_ROUTE = 5

def _most() -> Column:
    return F.desc("events")


def _events() -> Column:
    return F.count("*").alias("events")


def _distinct(column: str, name: str) -> Column:
    return F.count_distinct(column).alias(name)


def event_totals(events: DataFrame) -> DataFrame:
    """Count, date range and affected routes and stops, in one row.

    Totals per (route, stop) come first, so the two distinct counts see those few rows
    rather than one expanded copy of every event each.
    """
    per_place = events.groupBy("route_label", "stop_id").agg(
        _events(), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date")
    )
    return per_place.agg(
        F.coalesce(F.sum("events"), F.lit(0).cast("bigint")).alias("events"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        _distinct("route_label", "routes"),
        _distinct("stop_id", "stops"),
    )


def top_route_directions(events: DataFrame, n: int = TOP_ROUTE_DIRECTIONS) -> DataFrame:
    key = ["route_label", "direction_id", "route_name"]
    table = events.groupBy(*key).agg(_events(), _distinct("stop_id", "stops"))
    return top_n(table, n, _most(), F.desc("stops"), *key)


def top_stops(events: DataFrame, n: int = TOP_STOPS) -> DataFrame:
    key = ["stop_id", "stop_name", "stop_lat", "stop_lon"]
    table = events.groupBy(*key).agg(_events(), _distinct("route_label", "routes"))
    return top_n(table, n, _most(), F.desc("routes"), *key)


def top_route_direction_stops(events: DataFrame, n: int = TOP_ROUTE_DIRECTION_STOPS) -> DataFrame:
    key = ["route_label", "direction_id", "stop_id", "stop_name"]
    return top_n(events.groupBy(*key).agg(_events()), n, _most(), *key)


def top_date_hours(events: DataFrame, n: int = TOP_DATE_HOURS) -> DataFrame:
    key = ["event_date", "event_hour"]
    table = events.groupBy(*key).agg(_events(), _distinct("route_label", "routes"))
    return top_n(table, n, _most(), *key)


def route_totals(events: DataFrame) -> DataFrame:
    key = ["route_label", "route_name"]
    return events.groupBy(*key).agg(_events(), _distinct("stop_id", "stops")).orderBy(_most(), *key)


def route_top_stops(events: DataFrame, n: int = TOP_PER_ROUTE) -> DataFrame:
    counts = events.groupBy("route_label", "stop_id", "stop_name").agg(_events())
    place = F.concat("stop_name", F.lit(" ["), "stop_id", F.lit("]"))
    ranked = top_n_per(counts, "route_label", n, _most(), "stop_id", "stop_name")
    return ranked.withColumn("place", place)


def route_top_hours(events: DataFrame, n: int = TOP_PER_ROUTE) -> DataFrame:
    counts = events.groupBy("route_label", "event_hour").agg(_events())
    return top_n_per(counts, "route_label", n, _most(), "event_hour")


def route_direction_split(events: DataFrame) -> DataFrame:
    key = ["route_label", "direction_id"]
    return events.groupBy(*key).agg(_events())


def _as_text(ranked: DataFrame, label: str, order: list, name: str) -> DataFrame:
    """`label (events=n); ...` per route, over a handful of ranked rows each."""
    entry = F.concat(F.col(label), F.lit(" (events="), F.col("events").cast("string"), F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct(*order, entry.alias("entry"))))
    return ranked.groupBy("route_label").agg(F.array_join(ordered["entry"], "; ").alias(name))


def route_breakdown(events: DataFrame) -> DataFrame:
    """Where, when and in which direction each route bunches, as text."""
    worst_first = (-F.col("events")).alias("minus")
    texts = [
        _as_text(route_top_stops(events), "place", ["rank"], "where_text"),
        _as_text(route_top_hours(events), "event_hour", ["rank"], "when_text"),
        _as_text(
            route_direction_split(events), "direction_id", [worst_first, "direction_id"], "direction_split"
        ),
    ]
    table = route_totals(events)
    for text in texts:
        table = table.join(text, "route_label", "left")
    return table.select("route_label", "route_name", "events", "stops", "where_text", "when_text", "direction_split")


def event_listing(events: DataFrame) -> DataFrame:
    """Every event, 20 columns, headways in minutes."""
    return events.select(
        "event_date",
        "event_hour",
        "route_label",
        "direction_id",
        "stop_id",
        "stop_name",
        "lead_trip_id",
        "trailing_trip_id",
        "lead_headsign",
        "trailing_headsign",
        "first_seen",
        "last_seen",
        "first_predicted_arrival",
        "last_predicted_arrival",
        minutes(F.col("min_actual_headway_seconds")).alias("min_actual_headway"),
        minutes(F.col("scheduled_headway_seconds")).alias("scheduled_headway"),
        minutes(F.col("bunch_threshold_seconds")).alias("threshold"),
        "snapshots_flagged",
        "headway_source",
        "source_files",
    )


def report_tables(events: DataFrame) -> dict[str, DataFrame]:
    """Every table of the report by name. Give an event table that has been written."""
    return {
        "event_totals": event_totals(events),
        "top_route_directions": top_route_directions(events),
        "top_stops": top_stops(events),
        "top_route_direction_stops": top_route_direction_stops(events),
        "top_date_hours": top_date_hours(events),
        "route_totals": route_totals(events),
        "route_top_stops": route_top_stops(events),
        "route_top_hours": route_top_hours(events),
        "route_direction_split": route_direction_split(events),
        "route_breakdown": route_breakdown(events),
        "event_listing": event_listing(events),
    }
