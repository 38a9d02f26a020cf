"""Small tables for edge semantics."""

from datetime import datetime, timezone

from headwise.schemas import STOP_TIME_UPDATES
from headwise.sources.static import Timetable

T0 = 1_700_000_000  # 2023-11-14 22:13:20 UTC, 14:13:20 in Los Angeles
ZONE = "America/Los_Angeles"

_UPDATES = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STOP_TIME_UPDATES)


def updates(spark, rows):
    """Rows of (trip, sequence, stop, arrival seconds after T0) and optional overrides."""
    full = []
    for trip, sequence, stop, arrival, *rest in rows:
        extra = rest[0] if rest else {}
        at = extra.get("snapshot", 0)
        full.append(
            (
                trip,
                extra.get("route", "R"),
                sequence,
                stop,
                0,
                None if arrival is None else T0 + arrival,
                0,
                None,
                extra.get("feed", T0 + (at or 0)),
                None if at is None else datetime.fromtimestamp(T0 + at, timezone.utc),
                extra.get("source", "a"),
            )
        )
    return spark.createDataFrame(full, f"{_UPDATES}, source_db string")


def timetable(spark, trips=(), stop_times=(), routes=(), stops=(), zone=ZONE):
    return Timetable(
        zone=zone,
        routes=spark.createDataFrame(
            list(routes), "route_id string, route_short_name string, route_long_name string, route_desc string"
        ),
        stops=spark.createDataFrame(list(stops), "stop_id string, stop_name string, stop_lat string, stop_lon string"),
        trips=spark.createDataFrame(
            list(trips), "trip_id string, route_id string, direction_id string, service_id string, trip_headsign string"
        ),
        stop_times=spark.createDataFrame(
            list(stop_times), "trip_id string, stop_id string, stop_sequence string, arrival_time string"
        ),
    )


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
