from pyspark.sql import functions as F

from headwise.config import FixedConfig
from headwise.operators.pairs import observed_headways
from headwise.plans import fixed
from tests.micro import rows, updates


def trip(name, arrivals, **extra):
    """A trip over stops A, B, C, ...; only the inner stops count."""
    return [(name, i + 1, "ABCDEF"[i], at, extra) for i, at in enumerate(arrivals)]


def pairs(spark, data, **config):
    return rows(
        fixed.bunched_observations(updates(spark, data), FixedConfig(**config)),
        "stop_id", "prev_trip_id", "trip_id", "headway_seconds", "observations",
    )


def test_terminals_go_before_the_lag(spark):
    # At B, trip `mid` ends: it must not stand between its neighbours.
    data = trip("x", [0, 100, 200]) + [("mid", 1, "Z", 50), ("mid", 2, "B", 130)] + trip("y", [60, 160, 260])
    assert pairs(spark, data) == [("B", "x", "y", 60, 1)]


def test_threshold_is_inclusive(spark):
    data = trip("x", [0, 100, 300]) + trip("y", [0, 220, 600]) + trip("z", [0, 341, 900])
    assert pairs(spark, data) == [("B", "x", "y", 120, 1)]
    assert pairs(spark, data, headway_threshold_minutes=0) == []


def test_ties_follow_trip_then_sequence(spark):
    data = trip("b", [0, 100, 300]) + trip("a", [0, 100, 300])
    assert pairs(spark, data) == [("B", "a", "b", 0, 1)]


def test_copies_pair_with_themselves_and_are_counted(spark):
    data = trip("x", [0, 100, 300]) + trip("y", [0, 110, 400]) * 3
    assert pairs(spark, data) == [("B", "x", "y", 10, 1), ("B", "y", "y", 0, 2)]


def test_a_trip_twice_at_a_stop_hides_its_predecessor(spark):
    data = trip("x", [0, 100, 300]) + [
        ("y", 1, "A", 0), ("y", 2, "B", 110), ("y", 3, "B", 150), ("y", 4, "D", 500),
    ]
    assert pairs(spark, data) == [("B", "x", "y", 10, 1), ("B", "y", "y", 40, 1)]


def test_null_keys_and_sequences_are_left_out(spark):
    data = trip("x", [0, 100, 300]) + trip("y", [0, 110, 400]) + [
        (None, 2, "B", 105), ("x", None, "B", 104), ("x", 2, None, 104), ("x", 2, "B", None),
        ("x", 2, "B", 104, {"route": None}), ("x", 2, "B", 104, {"snapshot": None, "feed": 1}),
    ]
    assert pairs(spark, data) == [("B", "x", "y", 10, 1)]


def test_events_collapse_snapshots(spark):
    data = []
    for at, gap in ((0, 50), (3600, 30), (20, 40)):
        data += trip("x", [0, 100, 300], snapshot=at) + trip("y", [0, 100 + gap, 500], snapshot=at)
    trips = spark.createDataFrame(
        [("y", "Downtown"), ("y", "Airport"), ("x", "")], "trip_id string, trip_headsign string"
    )
    found = rows(
        fixed.detect_fixed(updates(spark, data), trips),
        F.col("date").cast("string"), "stop_id", "prev_trip_id", "trip_id", "headway_seconds", "hour_str", "headsign",
    )
    assert found == [("2023-11-14", "B", "x", "y", 30, "22:00", "Airport")]


def test_headsign_default(spark):
    data = trip("x", [0, 100, 300]) + trip("y", [0, 110, 400])
    blank = spark.createDataFrame([("y", "")], "trip_id string, trip_headsign string")
    for trips in (None, blank):
        assert rows(fixed.detect_fixed(updates(spark, data), trips), "headsign") == [("Unknown Destination",)]


def test_uncapped_headways_cover_every_observation(spark):
    data = trip("x", [0, 100, 300]) + trip("y", [0, 9000, 9900]) + trip("z", [0, 50_000, 50_100])
    kept = fixed.nonterminal_updates(updates(spark, data))
    assert rows(observed_headways(kept), "trip_id", "prev_trip_id", "headway_seconds") == [
        ("x", None, None), ("y", "x", 8900), ("z", "y", 41_000),
    ]


def test_events_grow_with_the_threshold(spark):
    data = [row for i in range(30) for row in trip(f"t{i:02d}", [0, i * i * 3 % 1700, 5000])]
    seen = [set(pairs(spark, data, headway_threshold_minutes=m)) for m in (0.5, 2, 10)]
    assert seen[0] < seen[1] < seen[2]


def test_row_order_and_partitions_do_not_matter(spark):
    data = [row for i in range(30) for row in trip(f"t{i:02d}", [0, i * 7 % 90, 5000])]
    base = updates(spark, data)
    results = [
        sorted(map(tuple, fixed.detect_fixed(frame).collect()))
        for frame in (base, base.orderBy(F.rand(1)).repartition(7), base.coalesce(1))
    ]
    assert results[0] == results[1] == results[2]


def test_given_bounds_change_nothing(spark):
    frame = updates(spark, trip("x", [0, 100, 300]) + trip("y", [0, 110, 400]))
    given = fixed.detect_fixed(frame, bounds=fixed.observed_bounds(frame))
    assert given.collect() == fixed.detect_fixed(frame).collect()


def test_report_tables(spark):
    events = spark.createDataFrame(
        [("d", "1", s, "p", f"t{i}", "08:00" if i % 2 else "09:00", "H") for i, s in enumerate("aabbccd")]
        + [("d", "2", "a", "p", "t", "10:00", "H")],
        "date string, route_id string, stop_id string, prev_trip_id string, trip_id string, hour_str string, headsign string",
    )
    assert [tuple(r) for r in fixed.route_totals(events).collect()] == [("1", 7), ("2", 1)]
    assert rows(fixed.route_top_stops(events).where("route_id = '1'"), "rank", "stop_id", "events") == [
        (1, "a", 2), (2, "b", 2), (3, "c", 2),
    ]
    assert rows(fixed.route_top_patterns(events).where("route_id = '1'"), "rank", "hour_str", "events") == [
        (1, "09:00", 4), (2, "08:00", 3),
    ]
    sample = fixed.sample_log(events.withColumn("logged_at", F.col("hour_str")))
    assert sample.count() == 4
    assert [r.logged_at for r in sample.collect()] == sorted(r.logged_at for r in sample.collect())
    routes = spark.createDataFrame([("1", "One"), ("3", "")], "route_id string, route_short_name string")
    named = fixed.with_names(fixed.route_totals(events), routes, None)
    assert rows(named, "route_id", "route_name") == [("1", "One"), ("2", "ID-2")]
