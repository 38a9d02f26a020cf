"""Declared schemas. Real-time inputs are never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_text, _long, _double, _time = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()

VEHICLE_POSITIONS = _struct(
    vehicle_id=_text,
    trip_id=_text,
    route_id=_text,
    latitude=_double,
    longitude=_double,
    bearing=_double,
    speed=_double,
    vehicle_timestamp=_long,
    logged_at=_time,
)

STOP_TIME_UPDATES = _struct(
    trip_id=_text,
    route_id=_text,
    stop_sequence=_long,
    stop_id=_text,
    arrival_delay=_long,
    arrival_time=_long,
    departure_delay=_long,
    departure_time=_long,
    feed_timestamp=_long,
    logged_at=_time,
)

# One feed entity, laid out as the GTFS-realtime specification nests it.
_trip = _struct(trip_id=_text, route_id=_text)
_stop_event = _struct(delay=_long, time=_long)

VEHICLE = _struct(
    vehicle=_struct(id=_text),
    trip=_trip,
    position=_struct(latitude=_double, longitude=_double, bearing=_double, speed=_double),
    timestamp=_long,
)

TRIP_UPDATE = _struct(
    trip=_trip,
    timestamp=_long,
    stop_time_update=T.ArrayType(
        _struct(stop_sequence=_long, stop_id=_text, arrival=_stop_event, departure=_stop_event)
    ),
)

# A landed record holds one entity of a snapshot: `logged_at` is stamped once per
# polling cycle by whoever lands the file, `entity_index` is the place in the message.
FEED_ENTITY = _struct(logged_at=_time, entity_index=_long, vehicle=VEHICLE, trip_update=TRIP_UPDATE)

# A whole feed message in one record; `sources.feeds.entities` turns it into the above.
FEED_MESSAGE = T.StructType(
    [
        T.StructField("logged_at", _time),
        T.StructField("entity", T.ArrayType(_struct(vehicle=VEHICLE, trip_update=TRIP_UPDATE))),
    ]
)

EVENTS = _struct(
    event_date=_text,
    route_id=_text,
    route_label=_text,
    route_name=_text,
    direction_id=_text,
    stop_id=_text,
    stop_name=_text,
    stop_lat=_text,
    stop_lon=_text,
    lead_trip_id=_text,
    trailing_trip_id=_text,
    first_seen=_text,
    last_seen=_text,
    first_predicted_arrival=_text,
    last_predicted_arrival=_text,
    event_hour=_text,
    min_actual_headway_seconds=_long,
    median_actual_headway_seconds=_double,
    scheduled_headway_seconds=_double,
    bunch_threshold_seconds=_double,
    snapshots_flagged=_long,
    source_files=_text,
    headway_source=_text,
    lead_headsign=_text,
    trailing_headsign=_text,
)

EVENT_MINUTES = _struct(
    min_actual_headway_minutes=_double,
    scheduled_headway_minutes=_double,
    bunch_threshold_minutes=_double,
)
