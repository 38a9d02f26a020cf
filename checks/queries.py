"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from headwise.config import FixedConfig, ScheduledConfig
from headwise.operators import events as ev
from headwise.operators import pairs as pr
from headwise.operators import timetable as tt
from headwise.plans import fixed, marts, report, scheduled
from headwise.plans.ingest import ingest
from headwise.session import configure, materialise, scratch_path
from headwise.sources import captures, events, feeds, static, tables
from headwise.sources.delimited import write_delimited
from headwise.sources.static import Names
from headwise.streaming.ingest import ingest_feeds

CONFIG = ScheduledConfig()

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    _QUERIES[function.__name__] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- sources and ingest --------------------------------------------------------------


@_query
def static_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timetable written as text files and read back, one line per row of any table."""
    folder = scratch_path(spark, "timetable")
    published = views.timetable(spark, sf_dir)
    agency = published.routes.select(F.lit("agency").alias("agency_id"), F.lit(views.ZONE).alias("agency_timezone"))
    for name, frame in {
        "agency": agency,
        "routes": published.routes,
        "stops": published.stops,
        "trips": published.trips,
        "stop_times": published.stop_times,
    }.items():
        write_delimited(frame, f"{folder}/{name}.txt")
    read = static.read_static(spark, folder)
    zone = read.zone.split("/")

    def lines(name: str, frame: DataFrame, id: str, label: str, detail: str, extra: object) -> DataFrame:
        return frame.select(
            F.lit(name).alias("dimension"),
            F.col(id).alias("id"),
            F.col(label).alias("name"),
            F.col(detail).alias("detail"),
            extra.alias("extra"),
        )

    service = F.concat_ws("/", "route_id", "service_id")
    return (
        lines("routes", read.routes, "route_id", "route_short_name", "route_long_name", F.col("route_desc"))
        .unionAll(lines("stops", read.stops, "stop_id", "stop_name", "stop_lat", F.col("stop_lon")))
        .unionAll(lines("trips", read.trips, "trip_id", "trip_headsign", "direction_id", service))
        .unionAll(lines("stop_times", read.stop_times, "trip_id", "stop_id", "arrival_time", F.col("stop_sequence")))
        .unionAll(spark.createDataFrame([("agency", read.zone, *zone[:2], "")], "dimension string, id string, name string, detail string, extra string"))
    )


def _land_captures(spark: SparkSession, sf_dir: str) -> list[captures.Capture]:
    """Observations written as one folder per capture, and three captures that can't be read."""
    root = scratch_path(spark, "captures")
    observed = views.stop_time_updates(spark, sf_dir)
    (
        observed.withColumns({"capture": F.col("source_db"), "table": F.lit(tables.STOP_UPDATES.name)})
        .drop("source_db")
        .hint("rebalance", "capture")
        .write.partitionBy("capture", "table")
        .parquet(root)
    )
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(path(f"{root}/capture=*")):
        folder = status.getPath()
        files.rename(path(folder, "table=stop_time_updates"), path(folder, "stop_time_updates"))
        files.rename(folder, path(root, unquote(folder.getName().removeprefix("capture="))))
    files.mkdirs(path(f"{root}/capture_without_table"))
    some = observed.drop("source_db").limit(5)
    other = some.withColumn("arrival_time", F.col("arrival_time").cast("string")).drop("departure_time")
    other.write.parquet(f"{root}/capture_of_other_types/stop_time_updates")
    bad = f"{root}/capture_with_bad_file/stop_time_updates"
    some.write.parquet(bad)
    some.select("trip_id").coalesce(1).write.mode("append").text(bad)
    damaged = f"{root}/capture_with_damaged_file/stop_time_updates"
    observed.drop("source_db").orderBy("trip_id", "logged_at", "stop_sequence").limit(7).coalesce(1).write.parquet(damaged)
    for status in files.globStatus(path(f"{damaged}/*.parquet")):
        _overwrite_bytes(spark, files, status.getPath())
    return captures.examined(spark, captures.list_captures(spark, f"{root}/c*"))


def _overwrite_bytes(spark: SparkSession, files, place) -> None:
    """Spoil the beginning of a file's first page; its footer stays."""
    source = files.open(place)
    content = bytearray(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
    source.close()
    content[4:40] = bytes(255 for _ in range(36))
    sink = files.create(place, True)
    sink.write(content)
    sink.close()


@_query
def capture_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.read_captures(spark, _land_captures(spark, sf_dir))


@_query
def capture_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.capture_horizon(views.stop_time_updates(spark, sf_dir))


@_query
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted while the events of all captures are detected and written."""
    found = _land_captures(spark, sf_dir)
    counts = captures.PairCounts(found)
    detected = scheduled.detect_scheduled(
        captures.read_captures(spark, found), _index(spark, sf_dir), CONFIG, counts.watch
    )
    materialise(detected, scratch_path(spark, "events"))
    return counts.status(spark)


@_query
def flatten_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = views.vehicle_feed(views.vehicle_positions(spark, sf_dir))
    return feeds.flatten_vehicles(feed).drop("entity_index")


@_query
def flatten_trip_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = views.trip_update_feed(views.stop_time_updates(spark, sf_dir, dealt=True))
    return feeds.flatten_trip_updates(feed).drop(*feeds.STOP_ORDINALS[1:])


def _schema(spark: SparkSession, prefix: str) -> str:
    """A new schema with empty tables."""
    name = f"{prefix}_" + scratch_path(spark, "").rsplit("-", 1)[1]
    tables.ensure_tables(spark, name, scratch_path(spark, name))
    return name


def _insert_twice(spark: SparkSession, table: tables.ObservationTable, *batches: DataFrame) -> str:
    schema = _schema(spark, "ingest")
    for number, batch in enumerate(batches):
        tables.insert_new(spark, schema, table, batch, f"batch-{number}")
    return schema


def _position_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What is in the target already, and the whole view as the next batch."""
    rows = views.vehicle_positions(spark, sf_dir).join(
        spark.read.parquet(f"{sf_dir}/events.parquet").select(
            F.col("event_id").alias("entity_index"), "event_type"
        ),
        "entity_index",
    )
    return rows.where(F.col("event_type") != "view"), rows


def _landed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as nested entities, written once however many batches are taken from them."""
    feed = views.trip_update_feed(views.stop_time_updates(spark, sf_dir, dealt=True))
    return materialise(feed, scratch_path(spark, "feed"), "zstd")


def _update_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = feeds.flatten_trip_updates(_landed_feed(spark, sf_dir))
    return rows.where(F.col("arrival_delay") > 0), rows


@_query
def insert_new_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _insert_twice(spark, tables.VEHICLES, *_position_batches(spark, sf_dir))
    return tables.read_observations(spark, f"{schema}.{tables.VEHICLES.name}")


@_query
def insert_new_stop_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _insert_twice(spark, tables.STOP_UPDATES, *_update_batches(spark, sf_dir))
    return tables.read_observations(spark, f"{schema}.{tables.STOP_UPDATES.name}")


@_query
def compacted_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table after its dates have been compacted and its last batch has been replayed."""
    batches = _update_batches(spark, sf_dir)
    schema = _insert_twice(spark, tables.STOP_UPDATES, *batches)
    name = f"{schema}.{tables.STOP_UPDATES.name}"
    days = [row.key_date for row in spark.table(name).select("key_date").distinct().collect()]
    tables.compact(spark, schema, tables.STOP_UPDATES, days)
    tables.insert_new(spark, schema, tables.STOP_UPDATES, batches[1], "batch-1")
    return tables.read_observations(spark, name)


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batch cycles over both feeds; the summary of the second."""
    positions, updates = views.vehicle_positions(spark, sf_dir), views.stop_time_updates(spark, sf_dir, dealt=True)
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("entity_index"), "event_type")
    early = positions.join(kinds.where("event_type != 'view'"), "entity_index", "left_semi")

    def feed(vehicles: DataFrame, predictions: DataFrame) -> DataFrame:
        nested = views.vehicle_feed(vehicles), views.trip_update_feed(predictions)
        return nested[0].unionByName(nested[1], allowMissingColumns=True)

    schema = _schema(spark, "cycle")
    ingest(spark, feed(early, updates.where("arrival_delay > 0")), schema, "cycle-0")
    return ingest(spark, feed(positions, updates), schema, "cycle-1")


@_query
def ingest_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cycles(spark, sf_dir)


@_query
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cycles(spark, sf_dir).select("feed", "parsed_rows", "new_rows")


@_query
def latest_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.latest_rows(
        views.vehicle_positions(spark, sf_dir),
        ["vehicle_id", "trip_id", "latitude", "longitude", "logged_at"],
        feeds.ENTITY_ORDINALS,
    )


@_query
def latest_stop_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.latest_rows(
        views.stop_time_updates(spark, sf_dir),
        ["trip_id", "stop_id", "arrival_delay", "logged_at"],
        ["logged_at", "trip_id", "stop_sequence", "stop_id", "arrival_delay"],
    )


def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no landed entities, three for every fiftieth event."""
    number = F.col("event_id").cast("string")
    lines = [
        F.concat(F.lit('{"entity_index": '), number),
        F.concat(F.lit('{"entity_index": '), number, F.lit(', "vehicle": {"timestamp": "soon"}}')),
        F.concat(F.lit("["), number, F.lit("]")),
    ]
    events_ = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 50 = 7")
    return events_.select(F.explode(F.array(*lines)).alias("value"))


@_query
def newest_stored_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of a table filled by six batches, every second date compacted."""
    schema = _schema(spark, "newest")
    rows = feeds.flatten_trip_updates(_landed_feed(spark, sf_dir))
    for number in range(6):
        part = rows.where(F.pmod(F.floor(F.col("feed_timestamp") / 86_400), F.lit(6)) == number)
        tables.insert_new(spark, schema, tables.STOP_UPDATES, part, f"batch-{number}")
    name = f"{schema}.{tables.STOP_UPDATES.name}"
    days = [row.key_date for row in spark.table(name).select("key_date").distinct().collect()]
    tables.compact(spark, schema, tables.STOP_UPDATES, sorted(d for d in days if d is not None)[::2])
    order = ["trip_id", "stop_id", "feed_timestamp", "stop_sequence"]
    return tables.newest_rows(spark, name, ["trip_id", "stop_id", "arrival_delay", "logged_at"], order, 25, at_once=1)


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """Snapshots of both feeds landed as JSON lines, then followed by two streams, twice.

    Broken lines land with the first half of the vehicles. The vehicles' table is away at first: their feed fails,
    the table is put back, and the feed comes back by itself.
    """
    landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "checkpoint")
    nested = {
        tables.STOP_UPDATES.name: _landed_feed(spark, sf_dir),
        tables.VEHICLES.name: views.vehicle_feed(views.vehicle_positions(spark, sf_dir)),
    }
    schema = _schema(spark, "stream")
    away = f"{schema}.{tables.VEHICLES.name}"
    spark.sql(f"ALTER TABLE {away} RENAME TO {away}_away")
    broken = broken_lines(spark, sf_dir)
    broken.write.text(f"{landing}/{tables.VEHICLES.name}")

    def put_back(feed: str, cause: Exception) -> None:
        if not spark.catalog.tableExists(away):
            spark.sql(f"ALTER TABLE {away}_away RENAME TO {away}")

    early = F.pmod(F.unix_seconds("logged_at"), F.lit(86_400)) < 43_200
    for half in (early, ~early):  # a vehicle's key lasts a day, so its first row is in an earlier batch
        for name, feed in nested.items():
            landed = feed.where(half).repartitionByRange("logged_at").write.mode("append")
            landed = landed.option("compression", "gzip")  # plain, they take many times the tables' space
            landed.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{landing}/{name}")
        outcome = ingest_feeds(
            spark, {n: f"{landing}/{n}" for n in nested}, schema, checkpoint, put_back, files_per_batch=8, first_wait=0.1
        )
        assert all(o.error is None and o.batches for o in outcome.values()), outcome
        assert outcome[tables.VEHICLES.name].restarts == (half is early), outcome
    return schema


@_query
def stream_ingest_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_observations(spark, f"{_streamed(spark, sf_dir)}.{tables.STOP_UPDATES.name}")


@_query
def stream_ingest_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_observations(spark, f"{_streamed(spark, sf_dir)}.{tables.VEHICLES.name}")


@_query
def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the streams couldn't take in; every line of one file, so of one batch."""
    kept = tables.read_rejected(spark, f"{_streamed(spark, sf_dir)}.{tables.VEHICLES.name}")
    batches = F.count_distinct("batch_id").alias("batches")
    return kept.groupBy("line", "reason").agg(F.count("*").alias("times"), F.count("file").alias("with_file"), batches)


# --- fixed threshold -----------------------------------------------------------------


@_query
def trip_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed.observed_bounds(views.stop_time_updates(spark, sf_dir))


@_query
def nonterminal_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed.nonterminal_updates(views.stop_time_updates(spark, sf_dir))


@_query
def fixed_headways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.observed_headways(fixed.nonterminal_updates(views.stop_time_updates(spark, sf_dir)))


@_query
def fixed_bunched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fixed.bunched_observations(views.stop_time_updates(spark, sf_dir))
    timed = fixed.with_capture_time(pairs).withColumn("date", F.col("date").cast("string"))
    return fixed.with_headsign(timed, views.trips(spark, sf_dir))


def _fixed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fixed.detect_fixed(
        views.stop_time_updates(spark, sf_dir), views.trips(spark, sf_dir), FixedConfig()
    )
    return found.withColumn("date", F.col("date").cast("string"))


@_query
def fixed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed_events(spark, sf_dir)


@_query
def fixed_events_unnamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector without any published table."""
    found = fixed.detect_fixed(views.stop_time_updates(spark, sf_dir))
    return found.withColumn("date", F.col("date").cast("string"))


@_query
def fixed_route_totals_unnamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed.fixed_tables(fixed_events_unnamed(spark, sf_dir))["route_totals"]


def _fixed_report(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    named = Names(*[getattr(views, table)(spark, sf_dir) for table in ("routes", "stops", "trips")])
    return fixed.fixed_tables(_fixed_events(spark, sf_dir), named)


@_query
def fixed_route_totals_partly_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report with names from a published folder in which the routes' table is missing."""
    folder = scratch_path(spark, "names")
    write_delimited(views.stops(spark, sf_dir), f"{folder}/stops.txt")
    write_delimited(views.trips(spark, sf_dir), f"{folder}/trips.txt")
    names = static.read_names(spark, folder)
    assert set(names.problems) == {"routes"}, names.problems
    tables_ = fixed.fixed_tables(_fixed_events(spark, sf_dir), names)
    stops = tables_["route_top_stops"].groupBy("route_name").agg(F.min("stop_name").alias("first_stop"))
    return tables_["route_totals"].join(stops, "route_name")


@_query
def stop_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the detector knows of a trip's stop: its time, and whether it is a terminal."""
    return tt.stop_facts(_timed(spark, sf_dir))


@_query
def fixed_sample_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed_report(spark, sf_dir)["sample_log"]


@_query
def fixed_route_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed_report(spark, sf_dir)["route_totals"]


@_query
def fixed_route_top_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed_report(spark, sf_dir)["route_top_stops"].drop("route_name")


@_query
def fixed_route_top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed_report(spark, sf_dir)["route_top_patterns"].drop("route_name")


# --- timetable -----------------------------------------------------------------------


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.parse_stop_times(views.stop_times(spark, sf_dir))


@_query
def parsed_stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(spark, sf_dir)


@_query
def trip_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.trip_dimension(views.trips(spark, sf_dir))


@_query
def trip_terminal_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.trip_terminal_stops(_timed(spark, sf_dir))


@_query
def trip_stop_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.trip_stop_schedule(_timed(spark, sf_dir))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.scheduled_gaps(
        _timed(spark, sf_dir), views.trips(spark, sf_dir), CONFIG.max_scheduled_headway_seconds
    )


@_query
def scheduled_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir)


@_query
def fallback_headways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.fallback_headways(_gaps(spark, sf_dir))


# --- schedule-aware ------------------------------------------------------------------


_indexes: dict[tuple[str, str], scheduled.TimetableIndex] = {}


def _index(spark: SparkSession, sf_dir: str) -> scheduled.TimetableIndex:
    """The timetable's lookups, written once per application: the tables of a folder don't change in that time."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        index = scheduled.index_timetable(views.timetable(spark, sf_dir), CONFIG, scratch_path(spark, "index"))
        _indexes[key] = index
    return _indexes[key]


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, scheduled.TimetableIndex]:
    return views.stop_time_updates(spark, sf_dir), _index(spark, sf_dir)


@_query
def updates_with_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduled.directed_updates(views.stop_time_updates(spark, sf_dir), _index(spark, sf_dir).trips)


@_query
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    directed = updates_with_direction(spark, sf_dir)
    pairs = pr.candidate_pairs(directed, CONFIG, ["trip_headsign"])
    return pairs.withColumnsRenamed(
        {"lead_trip_headsign": "lead_headsign", "trailing_trip_headsign": "trailing_headsign"}
    )


_FACTS = ["lead_scheduled_arrival_seconds", "trailing_scheduled_arrival_seconds"]


@_query
def nonterminal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = scheduled.timed_pairs(*_inputs(spark, sf_dir), CONFIG)
    return pr.drop_terminal_pairs(pairs).drop(*_FACTS)


@_query
def pair_headway(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = scheduled.timed_pairs(*_inputs(spark, sf_dir), CONFIG)
    return pr.pair_headway(pr.drop_terminal_pairs(pairs), CONFIG)


@_query
def resolved_headway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduled.resolved_pairs(*_inputs(spark, sf_dir), CONFIG)


def _bunched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduled.bunched_pairs(*_inputs(spark, sf_dir), CONFIG)


@_query
def bunched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bunched(spark, sf_dir)


@_query
def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    pairs = ev.with_labels(_bunched(spark, sf_dir), index.labels, index.places)
    signed = ev.with_headsigns(pairs, index.trips)
    return ev.with_local_text(ev.localise(signed, index.zone), index.zone)


@_query
def deduped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.dedupe_observations(ev.localise(_bunched(spark, sf_dir), views.ZONE))


@_query
def bunching_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduled.detect_scheduled(*_inputs(spark, sf_dir), CONFIG)


@_query
def events_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events-csv")
    events.write_events(event_table(spark, sf_dir), path)
    return events.read_events(spark, path)


# --- report and chart tables ---------------------------------------------------------

_written: dict[tuple[str, str], DataFrame] = {}


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table, written once per application and read back by every table below.

    As with the index, a folder whose tables change while the application runs isn't noticed.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        found = scheduled.detect_scheduled(*_inputs(configure(spark), sf_dir), CONFIG)
        _written[key] = materialise(found, scratch_path(spark, "events"))
    return _written[key]


def _over_events(name: str, table: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(event_table(spark, sf_dir))

    run.__name__ = name
    _query(run)


for _name, _table in {
    "event_totals": report.event_totals,
    "top_route_directions": report.top_route_directions,
    "top_stops": report.top_stops,
    "top_route_direction_stops": report.top_route_direction_stops,
    "top_date_hours": report.top_date_hours,
    "route_totals": report.route_totals,
    "route_top_stops": report.route_top_stops,
    "route_top_hours": report.route_top_hours,
    "route_direction_split": report.route_direction_split,
    "route_breakdown": report.route_breakdown,
    "event_listing": report.event_listing,
    "mart_top_routes": marts.top_routes,
    "mart_top_route_directions": marts.top_route_directions,
    "mart_top_stops": marts.top_stops,
    "events_by_hour": marts.events_by_hour,
    "route_hour_matrix": marts.route_hour_matrix,
    "stop_locations": marts.stop_locations,
    "route_summary": marts.route_summary,
}.items():
    _over_events(_name, _table)
