"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Observations and the published timetable are landed as Parquet first, as a feed recorder
would leave them; that, and the one-time saving of the timetable's lookups and of the
event table, is timed apart as `setup`. Every query then runs in full, its result going
to Spark's `noop` sink; the best of $BENCH_RUNS runs counts (an insert runs once, a second one would find nothing new).
$BENCH_COPIES repeats the observations.
"""

from __future__ import annotations

import itertools
import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from checks import views  # noqa: E402
from headwise.config import ScheduledConfig  # noqa: E402
from headwise.plans import fixed, marts, report, scheduled  # noqa: E402
from headwise.session import configure, materialise, saved_lookup, scratch_path  # noqa: E402
from headwise.sources import feeds, tables  # noqa: E402
from headwise.sources.static import Timetable  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
COPIES = int(os.environ.get("BENCH_COPIES", "1"))
CONFIG = ScheduledConfig()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("headwise-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.autoBroadcastJoinThreshold", "64m")  # sizing, as the README advises for a timetable
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def insert(spark: SparkSession, schema: str, batch: DataFrame, batch_id: str) -> DataFrame:
    """The whole insert: staged, compared with the target and written; its counts as a frame."""
    counts = tables.insert_new(spark, schema, tables.STOP_UPDATES, batch, batch_id)
    return spark.createDataFrame([tuple(counts.values())], list(counts))


def copied(updates: DataFrame) -> DataFrame:
    """The observations $BENCH_COPIES times, each copy as captures and days of its own."""
    if COPIES == 1:
        return updates
    more = updates.crossJoin(F.broadcast(updates.sparkSession.range(COPIES)))
    later = F.col("id") * (10 * 366 * 86_400)
    return more.withColumns(
        {
            "source_db": F.concat_ws("-", "source_db", "id"),
            "logged_at": F.timestamp_seconds(F.unix_seconds("logged_at") + later),
            **{c: F.col(c) + later for c in ("arrival_time", "departure_time", "feed_timestamp")},
        }
    ).drop("id")


def main() -> None:
    spark = session()
    base = scratch_path(spark, "bench")
    setup: dict[str, float] = {}

    def timed(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        started = time.time()
        result = make()
        setup[name] = round(time.time() - started, 3)
        return result

    updates = timed(
        "land_observations",
        lambda: materialise(
            copied(views.stop_time_updates(spark, SF_DIR)).repartition(4 * int(CPUS)), f"{base}/updates"
        ),
    )

    def land(name: str) -> DataFrame:
        frame = getattr(views, name)(spark, SF_DIR)
        return timed(f"land_{name}", lambda: materialise(frame, f"{base}/{name}"))

    timetable = Timetable(
        zone=views.ZONE, **{name: land(name) for name in ("routes", "stops", "trips", "stop_times")}
    )
    index = timed("save_timetable_lookups", lambda: scheduled.index_timetable(timetable, CONFIG, f"{base}/index"))
    bounds = timed("save_trip_bounds", lambda: saved_lookup(fixed.observed_bounds(updates), f"{base}/bounds"))
    events = timed(
        "save_events", lambda: materialise(scheduled.detect_scheduled(updates, index, CONFIG), f"{base}/events")
    )
    nested = timed("land_feed", lambda: materialise(views.trip_update_feed(updates), f"{base}/feed"))
    schema = "bench_" + base.rsplit("-", 1)[1]
    tables.ensure_tables(spark, schema, f"{base}/{schema}")
    flat = feeds.flatten_trip_updates(nested)
    timed("save_target", lambda: insert(spark, schema, flat.where("arrival_delay > 0"), "before"))

    runs_of_insert = itertools.count()
    queries: dict[str, Callable[[], DataFrame]] = {
        "bunching_events": lambda: scheduled.detect_scheduled(updates, index, CONFIG),
        "bunching_events_unsaved_timetable": lambda: scheduled.detect_scheduled(updates, timetable, CONFIG),
        "fixed_events": lambda: fixed.detect_fixed(updates, timetable.trips, bounds=bounds),
        "fixed_events_unsaved_bounds": lambda: fixed.detect_fixed(updates, timetable.trips),
        "flatten_trip_updates": lambda: feeds.flatten_trip_updates(nested),
        "insert_new_stop_updates": lambda: insert(spark, schema, flat, f"run-{next(runs_of_insert)}"),
        "route_top_stops": lambda: report.route_top_stops(events),
        "route_breakdown": lambda: report.route_breakdown(events),
        "event_totals": lambda: report.event_totals(events),
        "route_hour_matrix": lambda: marts.route_hour_matrix(events),
        "route_summary": lambda: marts.route_summary(events),
    }
    seconds: dict[str, float] = {}
    for name, query in queries.items():
        runs = []
        for _ in range(1 if name.startswith("insert") else RUNS):  # the second would find nothing new
            started = time.time()
            query().write.format("noop").mode("overwrite").save()
            runs.append(time.time() - started)
        seconds[name] = round(min(runs), 3)

    rows = updates.count()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(CPUS),
                "observations": rows,
                "observations_per_second": {
                    name: round(rows / seconds[name]) for name in ("bunching_events", "fixed_events")
                },
                "setup": setup,
            }
        )
    )


if __name__ == "__main__":
    main()
