"""Fixed-threshold detection and its report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwise.config import FixedConfig
from headwise.functions import blank_to_null, label_or_id, utc_date, utc_hour
from headwise.operators.pairs import observed_headways
from headwise.operators.ranking import one_per_key, top_n, top_n_per
from headwise.operators.updates import (
    counted_updates,
    nonnull_updates,
    observed_span,
    within_span,
)
from headwise.sources.static import Names

# Fixed values of the report.
UNKNOWN_HEADSIGN = "Unknown Destination"
TOP_STOPS = 3
TOP_PATTERNS = 3
SAMPLE_SIZE = 4
SAMPLE_SEED = 101

EVENT_KEY = ["date", "route_id", "stop_id", "prev_trip_id", "trip_id"]


def observed_bounds(updates: DataFrame) -> DataFrame:
    """Bounds of every trip. Save them with `saved_lookup` before a large run."""
    return observed_span(nonnull_updates(updates, "arrival_time", "trip_id"))


def nonterminal_updates(updates: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Usable observations away from the observed ends of their trip, copies counted."""
    usable = nonnull_updates(updates, "arrival_time", "trip_id", "route_id", "stop_id", "logged_at")
    if bounds is None:
        bounds = observed_bounds(updates)
    return counted_updates(within_span(usable, bounds))


def with_headsign(df: DataFrame, trips: DataFrame | None) -> DataFrame:
    """Headsign of the trailing trip, or the default where none is published."""
    default = F.lit(UNKNOWN_HEADSIGN)
    if trips is None:
        return df.withColumn("headsign", default)
    signs = one_per_key(trips.select("trip_id", F.col("trip_headsign").alias("headsign")), "trip_id")
    return df.join(signs, "trip_id", "left").withColumn(
        "headsign", F.coalesce(blank_to_null(F.col("headsign")), default)
    )


def with_capture_time(df: DataFrame) -> DataFrame:
    """Date and hour of the capture, in UTC whatever the session's zone."""
    seconds = F.unix_seconds("logged_at")
    return df.withColumns({"date": utc_date(seconds), "hour_str": utc_hour(seconds)})


def bunched_observations(
    updates: DataFrame, config: FixedConfig = FixedConfig(), bounds: DataFrame | None = None
) -> DataFrame:
    """Pairs at most the threshold apart, one row per distinct sighting."""
    return observed_headways(nonterminal_updates(updates, bounds), max_gap=config.threshold_seconds)


def detect_fixed(
    updates: DataFrame,
    trips: DataFrame | None = None,
    config: FixedConfig = FixedConfig(),
    bounds: DataFrame | None = None,
) -> DataFrame:
    """One event per pair, stop and capture date.

    Hour follows from the earliest capture and headsign from the trip, so both are added
    to the collapsed events rather than to every sighting.
    """
    events = (
        bunched_observations(updates, config, bounds)
        .groupBy(utc_date(F.unix_seconds("logged_at")).alias("date"), *EVENT_KEY[1:])
        .agg(F.min("logged_at").alias("logged_at"), F.min("headway_seconds").alias("headway_seconds"))
    )
    return with_headsign(with_capture_time(events), trips).select(
        *EVENT_KEY, "logged_at", "headway_seconds", "hour_str", "headsign"
    )


def with_names(df: DataFrame, routes: DataFrame | None, stops: DataFrame | None) -> DataFrame:
    """Route and stop names, `ID-<id>` where none is published."""
    for key, names, source, name in (
        ("route_id", routes, "route_short_name", "route_name"),
        ("stop_id", stops, "stop_name", "stop_name"),
    ):
        if key not in df.columns:
            continue
        if names is None:
            df = df.withColumn(name, F.concat(F.lit("ID-"), key))
            continue
        lookup = one_per_key(names.select(key, F.col(source).alias(name)), key)
        df = df.join(lookup, key, "left").withColumn(name, label_or_id(F.col(name), F.col(key)))
    return df


def sample_log(events: DataFrame, n: int = SAMPLE_SIZE, seed: int = SAMPLE_SEED) -> DataFrame:
    """A stable sample of events in time order, drawn by a seeded hash of the event key."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *EVENT_KEY))
    return top_n(events, n, draw, *EVENT_KEY).orderBy("logged_at", *EVENT_KEY)


def route_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("route_id").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "route_id")


def route_top_stops(events: DataFrame, n: int = TOP_STOPS) -> DataFrame:
    counts = events.groupBy("route_id", "stop_id").agg(F.count("*").alias("events"))
    return top_n_per(counts, "route_id", n, F.desc("events"), "stop_id")


def route_top_patterns(events: DataFrame, n: int = TOP_PATTERNS) -> DataFrame:
    counts = events.groupBy("route_id", "headsign", "hour_str").agg(F.count("*").alias("events"))
    return top_n_per(counts, "route_id", n, F.desc("events"), "headsign", "hour_str")


def fixed_tables(events: DataFrame, names: Names = Names()) -> dict[str, DataFrame]:
    """The report over fixed-threshold events, by table name.

    `events` comes from `detect_fixed`; write it first, each table reads it. Without
    names, ids and default text stand in.
    """
    return {
        "sample_log": with_names(sample_log(events), names.routes, names.stops),
        "route_totals": with_names(route_totals(events), names.routes, None),
        "route_top_stops": with_names(route_top_stops(events), names.routes, names.stops),
        "route_top_patterns": with_names(route_top_patterns(events), names.routes, None),
    }
