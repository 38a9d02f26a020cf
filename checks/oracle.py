"""The registered queries once more, as SQL over the same tables."""

from __future__ import annotations

# Views and intermediate results by name; each may use the ones it lists.
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def _part(name: str, *uses: str):
    def add(sql: str) -> None:
        _PARTS[name] = (uses, sql)

    return add


def _with(sql: str, *uses: str) -> str:
    """Prefix `sql` with the named parts and whatever they use, in order of use."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for used in _PARTS[name][0]:
            visit(used)
        if name not in ordered:
            ordered.append(name)

    for name in uses:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({_PARTS[n][1]})" for n in ordered) + "\n" + sql


_part("stop_time_updates")("""
    SELECT CAST(l_orderkey AS VARCHAR) AS trip_id,
           CASE WHEN l_orderkey % 97 <> 0 THEN CAST(l_orderkey % 25 AS VARCHAR) END AS route_id,
           CASE WHEN l_orderkey % 89 <> 0 THEN CAST(l_linenumber AS BIGINT) END AS stop_sequence,
           CASE WHEN l_orderkey % 83 <> 0
                THEN CAST((l_orderkey % 25 * 3 + l_partkey % 7) % 40 AS VARCHAR) END AS stop_id,
           delay AS arrival_delay,
           CASE WHEN l_orderkey % 79 <> 0 THEN t + CAST(l_quantity * 60 AS BIGINT) + delay END AS arrival_time,
           delay AS departure_delay,
           t + CAST(l_quantity * 60 AS BIGINT) + delay + 30 AS departure_time,
           t + CAST(s * 20 AS BIGINT) AS feed_timestamp,
           make_timestamp((t + CAST(s * 20 AS BIGINT)) * 1000000) AS logged_at,
           capture || CAST(y AS VARCHAR) AS source_db
    FROM (SELECT *, CAST(epoch(date_trunc('month', l_shipdate)) AS BIGINT) + 28 * 86400 + 1800
                    + ((y * 12 + month(l_shipdate)) * 7 + 10) % 24 * 3600 AS t,
                 CAST(s * (l_linenumber % 3) * 20 AS BIGINT) AS delay
          FROM (SELECT *, year(l_shipdate) AS y FROM lineitem) li
          CROSS JOIN (VALUES (0, 'capture_'), (1, 'capture_'), (2, 'capture_'), (1, 'copy+of%'), (3, 'copy+of%'))
                     AS snapshots(s, capture)
          WHERE capture = 'capture_' OR l_orderkey % 25 % 3 = 0) shots
""")

_part("trips")("""
    SELECT CAST(o_orderkey % 25 AS VARCHAR) AS route_id,
           o_orderstatus AS service_id,
           CASE WHEN o_orderkey % 17 = 0 THEN 'unlisted-' ELSE '' END || CAST(o_orderkey AS VARCHAR) AS trip_id,
           o_orderpriority AS trip_headsign,
           CAST((o_orderkey // 5) % 2 AS VARCHAR) AS direction_id
    FROM orders
""")

_part("stop_times")("""
    SELECT CAST(l_orderkey AS VARCHAR) AS trip_id,
           CASE WHEN l_orderkey % 29 = 0 THEN 'bad'
                ELSE CAST(minute // 60 AS VARCHAR) || ':' || lpad(CAST(minute % 60 AS VARCHAR), 2, '0') || ':00'
           END AS arrival_time,
           CAST((l_orderkey % 25 * 3 + part % 7) % 40 AS VARCHAR) AS stop_id,
           CAST(l_linenumber AS VARCHAR) AS stop_sequence
    FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, l_orderkey * 7 % 1440 + l_linenumber * 5 AS minute
          FROM lineitem GROUP BY l_orderkey, l_linenumber) li
""")

_part("routes")("""
    SELECT CAST(n_nationkey AS VARCHAR) AS route_id,
           CASE n_nationkey WHEN 4 THEN '' ELSE n_name END AS route_short_name,
           'Line ' || n_name AS route_long_name,
           CASE WHEN n_nationkey IN (1, 4) THEN '' ELSE 'Nation ' || n_name END AS route_desc
    FROM nation
""")

_part("stops")("""
    SELECT CAST(p_partkey % 40 AS VARCHAR) AS stop_id,
           CASE WHEN p_partkey % 40 = 19 THEN '' WHEN p_partkey % 5 = 3 THEN '  ' || p_name || chr(10) || 'bay "B", '
                ELSE p_name END AS stop_name,
           CASE p_partkey % 40 WHEN 18 THEN 'n/a' ELSE printf('%.2f', 47.5 + p_partkey / 100.0) END AS stop_lat,
           printf('%.2f', -122.3 + p_partkey / 100.0) AS stop_lon
    FROM part
    WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_partkey % 40)
""")

_part("vehicle_positions")("""
    SELECT CASE WHEN event_id % 50 <> 0 THEN 'V' || CAST(user_id AS VARCHAR) END AS vehicle_id,
           CAST(event_id AS VARCHAR) AS trip_id,
           CAST(event_id % 5 AS VARCHAR) AS route_id,
           47 + value / 1000 AS latitude,
           -122 - value / 1000 AS longitude,
           CAST(event_id % 360 AS DOUBLE) AS bearing,
           value AS speed,
           CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS vehicle_timestamp,
           ts AS logged_at,
           event_id AS entity_index,
           event_type
    FROM events
""")

# --- fixed threshold ---------------------------------------------------------------

_part("bounds", "stop_time_updates")("""
    SELECT trip_id, min(stop_sequence) AS start, max(stop_sequence) AS finish
    FROM stop_time_updates WHERE arrival_time IS NOT NULL AND trip_id IS NOT NULL GROUP BY trip_id
""")

_part("nonterminal", "stop_time_updates", "bounds")("""
    SELECT u.* FROM stop_time_updates u
    WHERE arrival_time IS NOT NULL AND route_id IS NOT NULL AND stop_id IS NOT NULL AND logged_at IS NOT NULL
      AND EXISTS (SELECT 1 FROM bounds b WHERE b.trip_id = u.trip_id
                  AND u.stop_sequence > b.start AND u.stop_sequence < b.finish)
""")

_part("headways", "nonterminal")("""
    SELECT *, arrival_time - prev_arrival_time AS headway_seconds
    FROM (SELECT logged_at, route_id, stop_id, trip_id, stop_sequence, arrival_time,
                 lag(trip_id) OVER w AS prev_trip_id, lag(arrival_time) OVER w AS prev_arrival_time
          FROM nonterminal
          WINDOW w AS (PARTITION BY logged_at, route_id, stop_id ORDER BY arrival_time, trip_id, stop_sequence)) h
""")

_part("trip_dim", "trips")("""
    SELECT trip_id, first(route_id) AS route_id, first(direction_id) AS direction_id, first(trip_headsign) AS trip_headsign
    FROM (SELECT * FROM trips ORDER BY trip_id, route_id, direction_id, trip_headsign) t
    GROUP BY trip_id
""")

_part("fixed_bunched", "headways", "trip_dim")("""
    SELECT h.*, CAST(CAST(logged_at AS DATE) AS VARCHAR) AS date, strftime(logged_at, '%H:00') AS hour_str,
           CASE WHEN t.trip_headsign <> '' THEN t.trip_headsign ELSE 'Unknown Destination' END AS headsign
    FROM headways h LEFT JOIN trip_dim t ON t.trip_id = h.trip_id
    WHERE headway_seconds >= 0 AND headway_seconds <= 120
""")

_part("fixed_events", "fixed_bunched")("""
    SELECT date, route_id, stop_id, prev_trip_id, trip_id, min(logged_at) AS logged_at,
           min(headway_seconds) AS headway_seconds, arg_min(hour_str, logged_at) AS hour_str,
           arg_min(headsign, logged_at) AS headsign
    FROM fixed_bunched GROUP BY date, route_id, stop_id, prev_trip_id, trip_id
""")

# --- timetable ---------------------------------------------------------------------

_part("parsed_times", "stop_times")(r"""
    SELECT trip_id, stop_id, stop_sequence, TRY_CAST(stop_sequence AS DOUBLE) AS stop_sequence_num,
           CAST(regexp_extract(arrival_time, '^(\d+):(\d+):(\d+)$', 1) AS BIGINT) * 3600
             + CAST(regexp_extract(arrival_time, '^(\d+):(\d+):(\d+)$', 2) AS BIGINT) * 60
             + CAST(regexp_extract(arrival_time, '^(\d+):(\d+):(\d+)$', 3) AS BIGINT) AS scheduled_arrival_seconds
    FROM stop_times WHERE regexp_full_match(arrival_time, '\d+:\d+:\d+')
""")

_part("terminals", "parsed_times")("""
    SELECT DISTINCT trip_id, stop_id
    FROM (SELECT trip_id, stop_id,
                 row_number() OVER (PARTITION BY trip_id ORDER BY stop_sequence_num, scheduled_arrival_seconds, stop_id) AS up,
                 row_number() OVER (PARTITION BY trip_id ORDER BY stop_sequence_num DESC, scheduled_arrival_seconds DESC, stop_id DESC) AS down
          FROM parsed_times WHERE stop_sequence_num IS NOT NULL) r
    WHERE up = 1 OR down = 1
""")

_part("schedule", "parsed_times")("""
    SELECT trip_id, stop_id, scheduled_arrival_seconds FROM parsed_times
    QUALIFY row_number() OVER (PARTITION BY trip_id, stop_id ORDER BY stop_sequence_num NULLS LAST, scheduled_arrival_seconds) = 1
""")

_part("gaps", "parsed_times", "trips")("""
    SELECT * FROM (
        SELECT service_id, route_id, direction_id, stop_id, scheduled_arrival_seconds,
               scheduled_arrival_seconds - lag(scheduled_arrival_seconds) OVER (
                   PARTITION BY service_id, route_id, direction_id, stop_id
                   ORDER BY scheduled_arrival_seconds) AS scheduled_gap_seconds
        FROM parsed_times JOIN trips USING (trip_id)) g
    WHERE scheduled_gap_seconds > 0 AND scheduled_gap_seconds <= 14400
""")

_part("fallbacks", "gaps")("""
    SELECT route_id, direction_id, stop_id, median(scheduled_gap_seconds) AS fallback_headway_seconds
    FROM gaps GROUP BY route_id, direction_id, stop_id
""")

# --- schedule-aware ----------------------------------------------------------------

_part("directed", "stop_time_updates", "trip_dim")("""
    SELECT u.*, coalesce(t.direction_id, 'unknown') AS direction_id, coalesce(t.trip_headsign, '') AS trip_headsign
    FROM stop_time_updates u LEFT JOIN trip_dim t ON t.trip_id = u.trip_id
    WHERE u.arrival_time IS NOT NULL AND u.trip_id IS NOT NULL AND u.route_id IS NOT NULL AND u.stop_id IS NOT NULL
""")

_part("candidates", "directed")("""
    SELECT trip_id AS trailing_trip_id, lead_trip_id, route_id, direction_id, stop_id, stop_sequence,
           lead_arrival_time, arrival_time AS trailing_arrival_time,
           arrival_time - lead_arrival_time AS actual_headway_seconds, feed_timestamp, logged_at,
           lead_headsign, trip_headsign AS trailing_headsign, source_db
    FROM (SELECT *, lag(trip_id) OVER w AS lead_trip_id, lag(arrival_time) OVER w AS lead_arrival_time,
                 lag(trip_headsign) OVER w AS lead_headsign
          FROM directed
          WINDOW w AS (PARTITION BY source_db, logged_at, route_id, stop_id, direction_id
                       ORDER BY arrival_time, trip_id, stop_sequence, feed_timestamp)) p
    WHERE lead_trip_id <> trip_id AND arrival_time - lead_arrival_time <= 600
""")

_part("nonterminal_pairs", "candidates", "terminals")("""
    SELECT * FROM candidates c
    WHERE NOT EXISTS (SELECT 1 FROM terminals t
                      WHERE t.stop_id = c.stop_id AND t.trip_id IN (c.lead_trip_id, c.trailing_trip_id))
""")

_part("pair_headways", "nonterminal_pairs", "schedule")("""
    SELECT p.*, a.scheduled_arrival_seconds AS lead_scheduled_arrival_seconds,
           b.scheduled_arrival_seconds AS trailing_scheduled_arrival_seconds,
           CASE WHEN abs(b.scheduled_arrival_seconds - a.scheduled_arrival_seconds) BETWEEN 1 AND 14400
                THEN CAST(abs(b.scheduled_arrival_seconds - a.scheduled_arrival_seconds) AS DOUBLE)
           END AS scheduled_headway_seconds
    FROM nonterminal_pairs p
    LEFT JOIN schedule a ON a.trip_id = p.lead_trip_id AND a.stop_id = p.stop_id
    LEFT JOIN schedule b ON b.trip_id = p.trailing_trip_id AND b.stop_id = p.stop_id
""")

_part("resolved", "pair_headways", "fallbacks")("""
    SELECT p.* REPLACE (coalesce(p.scheduled_headway_seconds, f.fallback_headway_seconds, 1800.0) AS scheduled_headway_seconds),
           f.fallback_headway_seconds,
           CASE WHEN p.scheduled_headway_seconds IS NOT NULL THEN 'trip_pair'
                WHEN f.fallback_headway_seconds IS NOT NULL THEN 'route_stop_median' ELSE 'default' END AS headway_source
    FROM pair_headways p LEFT JOIN fallbacks f
      ON f.route_id = p.route_id AND f.direction_id = p.direction_id AND f.stop_id = p.stop_id
""")

_part("bunched", "resolved")("""
    SELECT * FROM (SELECT *, CASE WHEN scheduled_headway_seconds / 4 < 120 THEN 120.0
                                  WHEN scheduled_headway_seconds / 4 > 600 THEN 600.0
                                  ELSE scheduled_headway_seconds / 4 END AS bunch_threshold_seconds FROM resolved) r
    WHERE actual_headway_seconds <= bunch_threshold_seconds
""")


def _local(epoch: str) -> str:
    return f"timezone('America/Los_Angeles', to_timestamp({epoch}))"


def _text(epoch: str) -> str:
    """Local time with PDT or PST, told apart by the offset from UTC."""
    local = _local(epoch)
    return (
        f"strftime({local}, '%Y-%m-%d %H:%M:%S') || "
        f"CASE CAST(epoch({local}) AS BIGINT) - ({epoch}) WHEN -25200 THEN ' PDT' ELSE ' PST' END"
    )


_part("labelled", "bunched", "routes", "stops")(f"""
    SELECT b.*, coalesce(nullif(r.route_short_name, ''), b.route_id) AS route_label,
           CASE WHEN r.route_id IS NULL THEN b.route_id
                WHEN r.route_desc <> '' THEN coalesce(nullif(r.route_short_name, ''), r.route_id) || ' - ' || r.route_desc
                WHEN r.route_long_name <> '' THEN coalesce(nullif(r.route_short_name, ''), r.route_id) || ' - ' || r.route_long_name
                ELSE coalesce(nullif(r.route_short_name, ''), r.route_id) END AS route_name,
           coalesce(s.stop_name, '') AS stop_name, coalesce(s.stop_lat, '') AS stop_lat, coalesce(s.stop_lon, '') AS stop_lon,
           strftime({_local('b.trailing_arrival_time')}, '%Y-%m-%d') AS event_date,
           strftime({_local('b.trailing_arrival_time')}, '%H:00') AS event_hour,
           {_text('b.lead_arrival_time')} AS lead_arrival_local,
           {_text('b.trailing_arrival_time')} AS trailing_arrival_local,
           {_text('b.feed_timestamp')} AS snapshot_local
    FROM bunched b LEFT JOIN routes r ON r.route_id = b.route_id LEFT JOIN stops s ON s.stop_id = b.stop_id
""")

_part("deduped", "labelled")("""
    SELECT * FROM labelled
    QUALIFY row_number() OVER (PARTITION BY route_id, direction_id, stop_id, lead_trip_id, trailing_trip_id, logged_at,
                                            feed_timestamp, lead_arrival_time, trailing_arrival_time ORDER BY source_db) = 1
""")

_part("bunching_events", "deduped")(f"""
    SELECT event_date, route_id, route_label, route_name, direction_id, stop_id, stop_name, stop_lat, stop_lon,
           lead_trip_id, trailing_trip_id,
           {_text('min(feed_timestamp)')} AS first_seen, {_text('max(feed_timestamp)')} AS last_seen,
           {_text('min(trailing_arrival_time)')} AS first_predicted_arrival,
           {_text('max(trailing_arrival_time)')} AS last_predicted_arrival,
           first(event_hour ORDER BY source_db, logged_at, trailing_arrival_time) AS event_hour,
           min(actual_headway_seconds) AS min_actual_headway_seconds,
           median(actual_headway_seconds) AS median_actual_headway_seconds,
           median(scheduled_headway_seconds) AS scheduled_headway_seconds,
           median(bunch_threshold_seconds) AS bunch_threshold_seconds,
           count(DISTINCT logged_at) AS snapshots_flagged,
           string_agg(DISTINCT source_db, ', ' ORDER BY source_db) AS source_files,
           string_agg(DISTINCT headway_source, ', ' ORDER BY headway_source) AS headway_source,
           first(lead_headsign) AS lead_headsign, first(trailing_headsign) AS trailing_headsign
    FROM deduped
    GROUP BY event_date, route_id, route_label, route_name, direction_id, stop_id, stop_name, stop_lat, stop_lon,
             lead_trip_id, trailing_trip_id
""")

# --- ingest ------------------------------------------------------------------------

_POSITION = "vehicle_id, trip_id, route_id, latitude, longitude, bearing, speed, vehicle_timestamp, logged_at"
_UPDATE = (
    "trip_id, route_id, stop_sequence, stop_id, arrival_delay, arrival_time, "
    "departure_delay, departure_time, feed_timestamp, logged_at"
)
_FIRST_POSITION = (
    "QUALIFY row_number() OVER (PARTITION BY vehicle_id, vehicle_timestamp ORDER BY logged_at, entity_index) = 1"
)
_FIRST_UPDATE = """QUALIFY row_number() OVER (PARTITION BY trip_id, stop_id, feed_timestamp
    ORDER BY logged_at, stop_sequence, arrival_delay, arrival_time, departure_delay, departure_time) = 1"""

_part("vehicle_target", "vehicle_positions")(
    f"SELECT * FROM vehicle_positions WHERE event_type <> 'view' {_FIRST_POSITION}"
)
_part("vehicle_batch", "vehicle_positions")(f"SELECT * FROM vehicle_positions {_FIRST_POSITION}")
_part("new_vehicles", "vehicle_target", "vehicle_batch")("""
    SELECT * FROM vehicle_batch b WHERE NOT EXISTS (
        SELECT 1 FROM vehicle_target t WHERE t.vehicle_id = b.vehicle_id AND t.vehicle_timestamp = b.vehicle_timestamp)
""")
_part("update_target", "stop_time_updates")(
    f"SELECT * FROM stop_time_updates WHERE arrival_delay > 0 {_FIRST_UPDATE}"
)
_part("update_batch", "stop_time_updates")(f"SELECT * FROM stop_time_updates {_FIRST_UPDATE}")
_part("new_updates", "update_target", "update_batch")("""
    SELECT * FROM update_batch b WHERE NOT EXISTS (
        SELECT 1 FROM update_target t
        WHERE t.trip_id = b.trip_id AND t.stop_id = b.stop_id AND t.feed_timestamp = b.feed_timestamp)
""")

_TOP_STOPS = """
    SELECT q.*, CASE WHEN s.stop_name <> '' THEN s.stop_name ELSE 'ID-' || q.stop_id END AS stop_name
    FROM (SELECT route_id, stop_id, count(*) AS events,
                 CAST(row_number() OVER (PARTITION BY route_id ORDER BY count(*) DESC, stop_id) AS INTEGER) AS rank
          FROM fixed_events GROUP BY route_id, stop_id QUALIFY rank <= 3) q
    LEFT JOIN stops s ON s.stop_id = q.stop_id
"""

_CANDIDATE = (
    "trailing_trip_id, lead_trip_id, route_id, direction_id, stop_id, stop_sequence, lead_arrival_time, "
    "trailing_arrival_time, actual_headway_seconds, feed_timestamp, logged_at, source_db"
)
_RESOLVED = (
    f"{_CANDIDATE}, lead_scheduled_arrival_seconds, trailing_scheduled_arrival_seconds, "
    "scheduled_headway_seconds, fallback_headway_seconds, headway_source"
)


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # Sources and ingest
    sql["static_dimensions"] = _with(
        """
        SELECT 'routes' AS dimension, route_id AS id, route_short_name AS name, route_long_name AS detail, route_desc AS extra FROM routes
        UNION ALL SELECT 'stops', stop_id, stop_name,
            CASE stop_lat WHEN 'n/a' THEN '' ELSE stop_lat END, stop_lon FROM stops
        UNION ALL SELECT 'trips', trip_id, trip_headsign, direction_id, route_id || '/' || service_id FROM trips
        UNION ALL SELECT 'stop_times', trip_id, stop_id, arrival_time, stop_sequence FROM stop_times
        UNION ALL SELECT 'agency', 'America/Los_Angeles', 'America', 'Los_Angeles', ''
        """,
        "routes", "stops", "trips", "stop_times",
    )
    sql["capture_scan"] = _with(f"SELECT {_UPDATE}, source_db FROM stop_time_updates", "stop_time_updates")
    sql["flatten_vehicles"] = _with(f"SELECT {_POSITION} FROM vehicle_positions", "vehicle_positions")
    sql["flatten_trip_updates"] = _with(f"SELECT {_UPDATE} FROM stop_time_updates", "stop_time_updates")
    sql["insert_new_vehicles"] = _with(
        f"SELECT {_POSITION} FROM vehicle_target UNION ALL SELECT {_POSITION} FROM new_vehicles", "new_vehicles"
    )
    sql["insert_new_stop_updates"] = _with(
        f"SELECT {_UPDATE} FROM update_target UNION ALL SELECT {_UPDATE} FROM new_updates", "new_updates"
    )
    sql["stream_ingest_updates"] = _with(f"SELECT {_UPDATE} FROM update_batch", "update_batch")
    sql["rejected_lines"] = """
        SELECT unnest(['{"entity_index": ' || event_id, '{"entity_index": ' || event_id || ', "vehicle": {"timestamp": "soon"}}',
                       '[' || event_id || ']']) AS line,
               unnest(['no JSON', 'not as declared: vehicle', 'no object as declared']) AS reason,
               1::BIGINT AS times, 1::BIGINT AS with_file, 1::BIGINT AS batches
        FROM events WHERE event_id % 50 = 7
    """
    sql["latest_positions"] = _with(
        """SELECT vehicle_id, trip_id, latitude, longitude, logged_at FROM vehicle_positions
           ORDER BY logged_at DESC, entity_index DESC LIMIT 2""",
        "vehicle_positions",
    )
    sql["latest_stop_updates"] = _with(
        """SELECT trip_id, stop_id, arrival_delay, logged_at FROM stop_time_updates
           ORDER BY logged_at DESC, trip_id DESC, stop_sequence DESC, stop_id DESC, arrival_delay DESC LIMIT 2""",
        "stop_time_updates",
    )
    sql["ingest_summary"] = _with(
        """
        SELECT 'vehicle_positions' AS feed, (SELECT count(*) FROM vehicle_positions) AS parsed_rows,
               (SELECT count(*) FROM new_vehicles) AS new_rows
        UNION ALL
        SELECT 'stop_time_updates', (SELECT count(*) FROM stop_time_updates), (SELECT count(*) FROM new_updates)
        """,
        "new_vehicles", "new_updates",
    )
    sql["ingest_cycle"] = _with(
        """
        SELECT 'vehicle_positions' AS feed, (SELECT count(*) FROM vehicle_positions) AS parsed_rows,
               (SELECT count(*) FROM vehicle_batch) AS unique_rows, (SELECT count(*) FROM new_vehicles) AS new_rows,
               CAST(NULL AS VARCHAR) AS error
        UNION ALL
        SELECT 'stop_time_updates', (SELECT count(*) FROM stop_time_updates), (SELECT count(*) FROM update_batch),
               (SELECT count(*) FROM new_updates), NULL
        """,
        "vehicle_batch", "update_batch", "new_vehicles", "new_updates",
    )
    sql["newest_stored_updates"] = _with(
        """SELECT trip_id, stop_id, arrival_delay, logged_at FROM update_batch
           ORDER BY logged_at DESC, trip_id DESC, stop_id DESC, feed_timestamp DESC, stop_sequence DESC LIMIT 25""",
        "update_batch",
    )
    sql["compacted_updates"] = sql["insert_new_stop_updates"]
    sql["stream_ingest_vehicles"] = _with(
        f"""SELECT {_POSITION} FROM vehicle_positions
            QUALIFY row_number() OVER (PARTITION BY vehicle_id, vehicle_timestamp,
                CASE WHEN vehicle_id IS NULL THEN epoch(logged_at) % 86400 < 43200 END
                ORDER BY logged_at, entity_index) = 1""",
        "vehicle_positions",
    )
    sql["capture_horizon"] = _with(
        """
        SELECT source_db, min(logged_at) AS start_t, max(logged_at) AS end_t FROM stop_time_updates GROUP BY source_db
        UNION ALL SELECT NULL, min(logged_at), max(logged_at) FROM stop_time_updates
        """,
        "stop_time_updates",
    )
    sql["source_status"] = _with(
        """
        SELECT source_db, CASE WHEN n > 0 THEN 'ok: ' || format('{:,}', n) || ' candidate pairs'
                               ELSE 'ok: no candidate pairs' END AS status
        FROM (SELECT source_db, (SELECT count(*) FROM candidates c WHERE c.source_db = u.source_db) AS n
              FROM (SELECT DISTINCT source_db FROM stop_time_updates) u) counted
        UNION ALL SELECT 'capture_without_table', 'skipped: no stop_time_updates table'
        UNION ALL SELECT 'capture_of_other_types', 'error: arrival_time is string, not bigint; no column departure_time'
        UNION ALL SELECT 'capture_with_damaged_file', 'error: damaged, 7 rows of 1 files cannot be read'
        UNION ALL SELECT 'capture_with_bad_file',
            'error: a file cannot be read as Parquet, or files disagree on their columns'
        """,
        "candidates",
    )
    sql["events_export"] = _with(
        """
        SELECT *, min_actual_headway_seconds / 60.0 AS min_actual_headway_minutes,
               scheduled_headway_seconds / 60.0 AS scheduled_headway_minutes,
               bunch_threshold_seconds / 60.0 AS bunch_threshold_minutes FROM bunching_events
        """,
        "bunching_events",
    )

    # Fixed threshold
    sql["trip_bounds"] = _with("SELECT * FROM bounds", "bounds")
    sql["nonterminal_updates"] = _with(
        """SELECT logged_at, route_id, stop_id, trip_id, arrival_time, stop_sequence, count(*) AS observations
           FROM nonterminal GROUP BY ALL""",
        "nonterminal",
    )
    sql["fixed_headways"] = _with(
        """SELECT logged_at, route_id, stop_id, trip_id, stop_sequence, arrival_time, prev_trip_id, prev_arrival_time,
                  headway_seconds, count(*) AS observations FROM headways GROUP BY ALL""",
        "headways",
    )
    sql["fixed_bunched_pairs"] = _with(
        """SELECT logged_at, route_id, stop_id, trip_id, stop_sequence, arrival_time, prev_trip_id, prev_arrival_time,
                  headway_seconds, date, hour_str, headsign, count(*) AS observations FROM fixed_bunched GROUP BY ALL""",
        "fixed_bunched",
    )
    sql["fixed_events"] = _with("SELECT * FROM fixed_events", "fixed_events")
    sql["fixed_events_unnamed"] = _with(
        "SELECT * REPLACE ('Unknown Destination' AS headsign) FROM fixed_events", "fixed_events"
    )
    sql["fixed_route_totals_unnamed"] = _with(
        "SELECT route_id, 'ID-' || route_id AS route_name, count(*) AS events FROM fixed_events GROUP BY route_id",
        "fixed_events",
    )
    sql["fixed_sample_log"] = _with(
        """
        SELECT e.*, CASE WHEN r.route_short_name <> '' THEN r.route_short_name ELSE 'ID-' || e.route_id END AS route_name,
               CASE WHEN s.stop_name <> '' THEN s.stop_name ELSE 'ID-' || e.stop_id END AS stop_name
        FROM (SELECT * FROM fixed_events
              ORDER BY md5('101|' || date || '|' || route_id || '|' || stop_id || '|' || prev_trip_id || '|' || trip_id),
                       date, route_id, stop_id, prev_trip_id, trip_id LIMIT 4) e
        LEFT JOIN routes r ON r.route_id = e.route_id LEFT JOIN stops s ON s.stop_id = e.stop_id
        """,
        "fixed_events", "routes", "stops",
    )
    sql["fixed_route_totals"] = _with(
        """SELECT e.route_id, CASE WHEN r.route_short_name <> '' THEN r.route_short_name ELSE 'ID-' || e.route_id END AS route_name,
                  count(*) AS events
           FROM fixed_events e LEFT JOIN routes r ON r.route_id = e.route_id GROUP BY ALL""",
        "fixed_events", "routes",
    )
    sql["fixed_route_top_stops"] = _with(_TOP_STOPS, "fixed_events", "stops")
    sql["fixed_route_totals_partly_named"] = _with(
        f"""SELECT 'ID-' || e.route_id AS route_name, e.route_id, count(*) AS events, any_value(n.first_stop) AS first_stop
            FROM fixed_events e JOIN (
                SELECT route_id, min(stop_name) AS first_stop FROM ({_TOP_STOPS}) GROUP BY route_id
            ) n USING (route_id) GROUP BY e.route_id""",
        "fixed_events", "stops",
    )
    sql["fixed_route_top_patterns"] = _with(
        """SELECT route_id, headsign, hour_str, count(*) AS events,
                  CAST(row_number() OVER (PARTITION BY route_id ORDER BY count(*) DESC, headsign, hour_str) AS INTEGER) AS rank
           FROM fixed_events GROUP BY route_id, headsign, hour_str QUALIFY rank <= 3""",
        "fixed_events",
    )

    # Timetable
    sql["parsed_stop_times"] = _with("SELECT * FROM parsed_times", "parsed_times")
    sql["trip_dimension"] = _with("SELECT * FROM trip_dim", "trip_dim")
    sql["trip_terminal_stops"] = _with("SELECT * FROM terminals", "terminals")
    sql["trip_stop_schedule"] = _with("SELECT * FROM schedule", "schedule")
    sql["stop_facts"] = _with(
        """SELECT s.*, EXISTS (SELECT 1 FROM terminals t WHERE t.trip_id = s.trip_id AND t.stop_id = s.stop_id) AS is_terminal
           FROM schedule s""",
        "schedule", "terminals",
    )
    sql["scheduled_gaps"] = _with("SELECT * FROM gaps", "gaps")
    sql["fallback_headways"] = _with("SELECT * FROM fallbacks", "fallbacks")

    # Schedule-aware
    sql["updates_with_direction"] = _with(
        """SELECT source_db, logged_at, route_id, stop_id, trip_id, arrival_time, stop_sequence, direction_id, trip_headsign,
                  min(feed_timestamp) AS feed_timestamp FROM directed GROUP BY ALL""",
        "directed",
    )
    sql["candidate_pairs"] = _with(
        f"SELECT {_CANDIDATE}, lead_headsign, trailing_headsign FROM candidates", "candidates"
    )
    sql["nonterminal_pairs"] = _with(f"SELECT {_CANDIDATE} FROM nonterminal_pairs", "nonterminal_pairs")
    sql["pair_headway"] = _with(
        f"""SELECT {_CANDIDATE}, lead_scheduled_arrival_seconds, trailing_scheduled_arrival_seconds,
                   scheduled_headway_seconds FROM pair_headways""",
        "pair_headways",
    )
    sql["resolved_headway"] = _with(f"SELECT {_RESOLVED} FROM resolved", "resolved")
    sql["bunched_pairs"] = _with(f"SELECT {_RESOLVED}, bunch_threshold_seconds FROM bunched", "bunched")
    labels = (
        "lead_headsign, trailing_headsign, route_label, route_name, stop_name, stop_lat, stop_lon, event_date, "
        "event_hour, lead_arrival_local, trailing_arrival_local, snapshot_local"
    )
    sql["labelled_pairs"] = _with(f"SELECT {_RESOLVED}, bunch_threshold_seconds, {labels} FROM labelled", "labelled")
    sql["deduped_pairs"] = _with(
        f"SELECT {_RESOLVED}, bunch_threshold_seconds, event_date, event_hour FROM deduped", "deduped"
    )
    sql["bunching_events"] = _with("SELECT * FROM bunching_events", "bunching_events")

    # Report tables
    def over_events(query: str) -> str:
        return _with(query, "bunching_events")

    sql["event_totals"] = over_events("""
        SELECT count(*) AS events, min(event_date) AS first_date, max(event_date) AS last_date,
               count(DISTINCT route_label) AS routes, count(DISTINCT stop_id) AS stops FROM bunching_events""")
    sql["top_route_directions"] = over_events("""
        SELECT route_label, direction_id, route_name, count(*) AS events, count(DISTINCT stop_id) AS stops
        FROM bunching_events GROUP BY ALL
        ORDER BY events DESC, stops DESC, route_label, direction_id, route_name LIMIT 20""")
    sql["top_stops"] = over_events("""
        SELECT stop_id, stop_name, stop_lat, stop_lon, count(*) AS events, count(DISTINCT route_label) AS routes
        FROM bunching_events GROUP BY ALL
        ORDER BY events DESC, routes DESC, stop_id, stop_name, stop_lat, stop_lon LIMIT 25""")
    sql["top_route_direction_stops"] = over_events("""
        SELECT route_label, direction_id, stop_id, stop_name, count(*) AS events FROM bunching_events GROUP BY ALL
        ORDER BY events DESC, route_label, direction_id, stop_id, stop_name LIMIT 30""")
    sql["top_date_hours"] = over_events("""
        SELECT event_date, event_hour, count(*) AS events, count(DISTINCT route_label) AS routes
        FROM bunching_events GROUP BY ALL ORDER BY events DESC, event_date, event_hour LIMIT 30""")
    sql["route_totals"] = over_events("""
        SELECT route_label, route_name, count(*) AS events, count(DISTINCT stop_id) AS stops
        FROM bunching_events GROUP BY ALL""")
    sql["route_top_stops"] = over_events("""
        SELECT route_label, stop_id, stop_name, count(*) AS events, stop_name || ' [' || stop_id || ']' AS place,
               CAST(row_number() OVER (PARTITION BY route_label ORDER BY count(*) DESC, stop_id, stop_name) AS INTEGER) AS rank
        FROM bunching_events GROUP BY route_label, stop_id, stop_name QUALIFY rank <= 5""")
    sql["route_top_hours"] = over_events("""
        SELECT route_label, event_hour, count(*) AS events,
               CAST(row_number() OVER (PARTITION BY route_label ORDER BY count(*) DESC, event_hour) AS INTEGER) AS rank
        FROM bunching_events GROUP BY route_label, event_hour QUALIFY rank <= 5""")
    sql["route_direction_split"] = over_events("""
        SELECT route_label, direction_id, count(*) AS events FROM bunching_events GROUP BY ALL""")

    def listed(label: str, group: str, order: str, limit: int | None, name: str) -> str:
        kept = f"WHERE n <= {limit}" if limit else ""
        return f"""(SELECT route_label, string_agg(entry, '; ' ORDER BY n) AS {name}
            FROM (SELECT route_label, {label} || ' (events=' || CAST(count(*) AS VARCHAR) || ')' AS entry,
                         row_number() OVER (PARTITION BY route_label ORDER BY count(*) DESC, {order}) AS n
                  FROM bunching_events GROUP BY route_label, {group}) l {kept} GROUP BY route_label)"""

    sql["route_breakdown"] = over_events(f"""
        SELECT t.*, where_text, when_text, direction_split
        FROM (SELECT route_label, route_name, count(*) AS events, count(DISTINCT stop_id) AS stops
              FROM bunching_events GROUP BY ALL) t
        JOIN {listed("stop_name || ' [' || stop_id || ']'", "stop_id, stop_name", "stop_id, stop_name", 5, "where_text")} a USING (route_label)
        JOIN {listed("event_hour", "event_hour", "event_hour", 5, "when_text")} b USING (route_label)
        JOIN {listed("direction_id", "direction_id", "direction_id", None, "direction_split")} c USING (route_label)""")
    sql["event_listing"] = over_events("""
        SELECT event_date, event_hour, route_label, direction_id, stop_id, stop_name, lead_trip_id, trailing_trip_id,
               lead_headsign, trailing_headsign, first_seen, last_seen, first_predicted_arrival, last_predicted_arrival,
               min_actual_headway_seconds / 60.0 AS min_actual_headway, scheduled_headway_seconds / 60.0 AS scheduled_headway,
               bunch_threshold_seconds / 60.0 AS threshold, snapshots_flagged, headway_source, source_files
        FROM bunching_events""")

    # Chart tables
    sql["mart_top_routes"] = over_events("""
        SELECT route_label, count(*) AS events, count(DISTINCT stop_id) AS stops FROM bunching_events GROUP BY ALL
        ORDER BY events DESC, route_label LIMIT 15""")
    sql["mart_top_route_directions"] = over_events("""
        SELECT route_label || ' dir ' || direction_id AS route_direction, count(*) AS events FROM bunching_events GROUP BY ALL
        ORDER BY events DESC, route_direction LIMIT 15""")
    sql["mart_top_stops"] = over_events("""
        SELECT stop_id, stop_name, count(*) AS events, count(DISTINCT route_label) AS routes,
               stop_name || ' [' || stop_id || ']' AS stop_label
        FROM bunching_events WHERE stop_name <> '' GROUP BY stop_id, stop_name
        ORDER BY events DESC, stop_id, stop_name LIMIT 20""")
    sql["events_by_hour"] = over_events("""
        SELECT CAST(left(event_hour, 2) AS INTEGER) AS hour_num, count(*) AS events, count(DISTINCT route_label) AS routes
        FROM bunching_events GROUP BY ALL""")
    hours = ", ".join(
        f"count(*) FILTER (WHERE CAST(left(event_hour, 2) AS INTEGER) = {h}) AS h{h:02d}" for h in range(24)
    )
    sql["route_hour_matrix"] = over_events(f"""
        SELECT route_label, count(*) AS events, {hours} FROM bunching_events GROUP BY route_label
        ORDER BY events DESC, route_label LIMIT 15""")
    sql["stop_locations"] = over_events("""
        SELECT *, 80.0 + events / max(events) OVER () * 520.0 AS marker_size,
               row_number() OVER (ORDER BY events DESC, stop_id, stop_name, stop_lat_num, stop_lon_num) <= 10 AS labelled
        FROM (SELECT stop_id, stop_name, TRY_CAST(stop_lat AS DOUBLE) AS stop_lat_num, TRY_CAST(stop_lon AS DOUBLE) AS stop_lon_num,
                     count(*) AS events, count(DISTINCT route_label) AS routes
              FROM bunching_events
              WHERE stop_name <> '' AND TRY_CAST(stop_lat AS DOUBLE) IS NOT NULL AND TRY_CAST(stop_lon AS DOUBLE) IS NOT NULL
              GROUP BY ALL ORDER BY events DESC, stop_id, stop_name, stop_lat_num, stop_lon_num LIMIT 20) s""")
    sql["route_summary"] = over_events("""
        SELECT t.*, s.stop_id AS top_stop_id, s.stop_name AS top_stop_name, s.n AS top_stop_events,
               h.event_hour AS top_hour, h.n AS top_hour_events
        FROM (SELECT route_label, count(*) AS events, count(DISTINCT stop_id) AS stops FROM bunching_events GROUP BY ALL) t
        LEFT JOIN (SELECT route_label, stop_id, stop_name, count(*) AS n FROM bunching_events WHERE stop_name <> '' GROUP BY route_label, stop_id, stop_name
                   QUALIFY row_number() OVER (PARTITION BY route_label ORDER BY count(*) DESC, stop_id, stop_name) = 1) s USING (route_label)
        LEFT JOIN (SELECT route_label, event_hour, count(*) AS n FROM bunching_events GROUP BY route_label, event_hour
                   QUALIFY row_number() OVER (PARTITION BY route_label ORDER BY count(*) DESC, event_hour) = 1) h USING (route_label)""")
    return sql
