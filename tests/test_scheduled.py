import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from headwise.config import ScheduledConfig
from headwise.plans.scheduled import bunched_pairs, detect_scheduled, directed_updates, index_timetable, resolved_pairs, timed_pairs
from tests.micro import T0, rows, timetable, updates

CONFIG = ScheduledConfig()


def plain(spark, trips="xyz", schedule=(), **extra):
    """Every trip runs on route R in direction 0."""
    return timetable(spark, trips=[(t, "R", "0", "S", f"to {t}") for t in trips], stop_times=schedule, **extra)


def candidates(spark, data, table=None, config=CONFIG):
    found = timed_pairs(updates(spark, data), index_timetable(table or plain(spark), config), config)
    return rows(found, "direction_id", "stop_id", "lead_trip_id", "trailing_trip_id", "actual_headway_seconds")


def test_cap_is_inclusive_and_neighbours_only(spark):
    data = [("x", 1, "A", 0), ("y", 2, "A", 600), ("z", 3, "A", 1201)]
    assert candidates(spark, data) == [("0", "A", "x", "y", 600)]


def test_self_pair_is_dropped_after_the_lag(spark):
    data = [("x", 1, "A", 0), ("y", 2, "A", 10), ("y", 5, "A", 20), ("z", 3, "A", 30)]
    assert candidates(spark, data) == [("0", "A", "x", "y", 10), ("0", "A", "y", "z", 10)]


def test_ties_follow_trip_id(spark):
    data = [("z", 1, "A", 50), ("x", 1, "A", 50), ("y", 1, "A", 50)]
    assert candidates(spark, data) == [("0", "A", "x", "y", 0), ("0", "A", "y", "z", 0)]


def test_copies_change_no_pair_and_the_lowest_place_is_kept(spark):
    data = [("x", 1, "A", 0)] * 50 + [("y", 4, "A", 10), ("y", 2, "A", 10, {"feed": T0 + 9}), ("y", 2, "A", 10)] * 20
    found = timed_pairs(updates(spark, data), index_timetable(plain(spark), CONFIG), CONFIG)
    assert rows(found, "lead_trip_id", "trailing_trip_id", "stop_sequence", "feed_timestamp") == [("x", "y", 2, T0)]


def test_nulls_in_required_columns(spark):
    data = [
        ("x", 1, "A", 0), (None, 1, "A", 1), ("y", 1, None, 2), ("y", 1, "A", None), ("y", 1, "A", 3, {"route": None}),
        ("z", None, "A", 9, {"feed": None}),
    ]
    assert candidates(spark, data) == [("0", "A", "x", "z", 9)]


def test_unknown_and_blank_directions_are_apart(spark):
    table = timetable(spark, trips=[("x", "R", "", "S", ""), ("y", "R", "", "S", "")])
    data = [("x", 1, "A", 0), ("u", 1, "A", 5), ("y", 1, "A", 10), ("v", 1, "A", 15)]
    assert candidates(spark, data, table) == [("", "A", "x", "y", 10), ("unknown", "A", "u", "v", 10)]


def test_captures_and_snapshots_are_paired_apart(spark):
    data = [("x", 1, "A", 0), ("y", 1, "A", 5, {"source": "b"}), ("z", 1, "A", 6, {"snapshot": 20})]
    assert candidates(spark, data) == []


def test_pairs_match_a_plain_loop(spark):
    pick = random.Random(7)
    data = [
        (f"t{pick.randrange(25):02d}", pick.randrange(1, 4), pick.choice("AAAB"), pick.randrange(0, 30_000),
         {"snapshot": pick.choice([0, 20]), "source": pick.choice("ab")})
        for _ in range(900)
    ]
    data += data[:300]
    table = plain(spark, trips=[f"t{i:02d}" for i in range(0, 25, 2)])
    groups = defaultdict(list)
    for t, s, stop, at, extra in data:
        direction = "0" if int(t[1:]) % 2 == 0 else "unknown"
        groups[extra["source"], extra["snapshot"], stop, direction].append((at, t, s))
    expected = []
    for (_, _, stop, direction), members in groups.items():
        members.sort()
        for lead, trail in zip(members, members[1:]):
            if lead[1] != trail[1] and trail[0] - lead[0] <= 600:
                expected.append((direction, stop, lead[1], trail[1], trail[0] - lead[0]))
    assert candidates(spark, data, table) == sorted(expected, key=repr)


def schedule(*entries):
    """Timed stops between two far terminals, so that none of them is one."""
    out = []
    for trip, stop, at in entries:
        out += [(trip, "first", "1", "0:00:01"), (trip, stop, "5", at), (trip, "last", "9", "99:00:00")]
    return out


def resolved(spark, data, times, config=CONFIG, **extra):
    index = index_timetable(plain(spark, schedule=times, **extra), config)
    return rows(
        resolved_pairs(updates(spark, data), index, config),
        "lead_trip_id", "trailing_trip_id", "scheduled_headway_seconds", "headway_source",
    )


PAIR = [("x", 5, "A", 0), ("y", 5, "A", 100)]


def test_headway_from_the_two_trips(spark):
    times = schedule(("x", "A", "8:20:00"), ("y", "A", "8:00:00"))
    assert resolved(spark, PAIR, times) == [("x", "y", 1200.0, "trip_pair")]


def test_headway_from_the_median(spark):
    same = schedule(("x", "A", "8:00:00"), ("y", "A", "8:00:00"), ("z", "A", "8:15:00"))
    assert resolved(spark, PAIR, same) == [("x", "y", 900.0, "route_stop_median")]
    far = schedule(("x", "A", "8:00:00"), ("y", "A", "12:00:01"), ("z", "A", "8:15:00"))
    assert resolved(spark, PAIR, far) == [("x", "y", (900 + 13501) / 2, "route_stop_median")]
    absent = schedule(("x", "A", "8:00:00"), ("z", "A", "8:15:00"))
    assert resolved(spark, PAIR, absent) == [("x", "y", 900.0, "route_stop_median")]


def test_headway_by_default(spark):
    assert resolved(spark, PAIR, schedule(("x", "A", "8:00:00"))) == [("x", "y", 1800.0, "default")]


def test_terminal_pairs_go_after_the_lag(spark):
    data = [("x", 5, "A", 0), ("y", 9, "A", 50), ("z", 5, "A", 100)]
    times = schedule(("x", "A", "8:00:00"), ("z", "A", "8:10:00")) + [("y", "B", "1", "8:00:00"), ("y", "A", "2", "8:30:00")]
    assert resolved(spark, data, times) == []
    kept = resolved(spark, data, times, ScheduledConfig(include_terminals=True))
    assert [pair[:2] for pair in kept] == [("x", "y"), ("y", "z")]


def threshold(spark, headway_minutes, gap, **config):
    times = schedule(("x", "A", "8:00:00"), ("y", "A", f"8:{headway_minutes:02d}:00"))
    config = ScheduledConfig(**config)
    index = index_timetable(plain(spark, schedule=times), config)
    data = [("x", 5, "A", 0), ("y", 5, "A", gap)]
    return [r[0] for r in rows(bunched_pairs(updates(spark, data), index, config), "bunch_threshold_seconds")]


def test_threshold_is_clipped_and_inclusive(spark):
    assert threshold(spark, 8, 120) == [120.0] and threshold(spark, 8, 121) == []
    assert threshold(spark, 20, 300) == [300.0] and threshold(spark, 20, 301) == []
    assert threshold(spark, 50, 600) == [600.0] and threshold(spark, 50, 0) == [600.0]
    assert threshold(spark, 50, 601) == []
    assert threshold(spark, 20, 301, threshold_ratio=0.5) == [600.0]


def events(spark, data, times=(), config=CONFIG, **extra):
    table = plain(spark, schedule=times, **extra)
    return detect_scheduled(updates(spark, data), table, config)


def test_snapshots_collapse_into_one_event(spark):
    data = []
    for at, gap in ((0, 90), (20, 70), (40, 110)):
        data += [("x", 5, "A", at, {"snapshot": at}), ("y", 5, "A", at + gap, {"snapshot": at})]
    found = events(spark, data).collect()
    assert len(found) == 1
    event = found[0].asDict()
    assert (event["first_seen"], event["last_seen"]) == ("2023-11-14 14:13:20 PST", "2023-11-14 14:14:00 PST")
    assert event["first_predicted_arrival"] == "2023-11-14 14:14:50 PST"
    assert event["last_predicted_arrival"] == "2023-11-14 14:15:50 PST"
    assert (event["min_actual_headway_seconds"], event["median_actual_headway_seconds"]) == (70, 90.0)
    assert (event["scheduled_headway_seconds"], event["bunch_threshold_seconds"]) == (1800.0, 450.0)
    assert (event["snapshots_flagged"], event["source_files"], event["headway_source"]) == (3, "a", "default")
    assert (event["lead_headsign"], event["trailing_headsign"]) == ("to x", "to y")
    assert (event["event_date"], event["event_hour"]) == ("2023-11-14", "14:00")


def test_one_observation_in_two_captures_counts_once(spark):
    one = [("x", 5, "A", 0), ("y", 5, "A", 90), ("x", 5, "A", 20, {"snapshot": 20}), ("y", 5, "A", 40, {"snapshot": 20})]
    other = [("x", 5, "A", 0, {"source": "b"}), ("y", 5, "A", 90, {"source": "b"})]
    late = [("x", 5, "A", 60, {"source": "c", "snapshot": 60}), ("y", 5, "A", 90, {"source": "c", "snapshot": 60})]
    assert rows(events(spark, one + other), "source_files", "median_actual_headway_seconds") == [("a", 55.0)]
    assert rows(events(spark, one + other + late), "source_files", "snapshots_flagged") == [("a, c", 3)]


def test_hour_is_that_of_the_first_row(spark):
    # 14:59 in one snapshot and 15:00 in the next; capture `b` sorts after `a`.
    at = 46 * 60
    data = [
        ("x", 5, "A", at, {"source": "b"}), ("y", 5, "A", at, {"source": "b"}),
        ("x", 5, "A", at + 60, {"snapshot": 20}), ("y", 5, "A", at + 60, {"snapshot": 20}),
    ]
    assert rows(events(spark, data), "event_hour", "source_files") == [("15:00", "a, b")]


def test_date_is_local_to_the_agency(spark):
    midnight = 35_200  # 2023-11-15 00:00:00 in Los Angeles
    data = [("x", 5, "A", midnight - 30), ("y", 5, "A", midnight - 1), ("z", 5, "A", midnight)]
    assert rows(events(spark, data), "trailing_trip_id", "event_date", "event_hour") == [
        ("y", "2023-11-14", "23:00"), ("z", "2023-11-15", "00:00"),
    ]


def test_labels(spark):
    routes = [("1", "", "Long", "Desc"), ("2", "Two", "Long", ""), ("3", "", "", ""), ("3", "B", "", "")]
    stops = [("A", "Main St", "47.1", "-122.2"), ("A", "Zed", "0", "0")]
    data = [
        (t, 5, "A" if r != "4" else "Q", at, {"route": r}) for r in "1234" for t, at in (("x", 0), ("y", 30))
    ]
    found = events(spark, data, routes=routes, stops=stops)
    assert rows(found, "route_id", "route_label", "route_name", "stop_name", "stop_lat") == [
        ("1", "1", "1 - Desc", "Main St", "47.1"),
        ("2", "Two", "Two - Long", "Main St", "47.1"),
        ("3", "3", "3", "Main St", "47.1"),
        ("4", "4", "4", "", ""),
    ]


def random_data():
    pick = random.Random(3)
    return [
        (f"t{pick.randrange(9)}", pick.randrange(1, 4), pick.choice("AB"), pick.randrange(0, 4000), {"snapshot": pick.choice([0, 20, 40])})
        for _ in range(400)
    ]


def test_collapsed_events_never_outnumber_pairs_and_ratio_only_adds(spark):
    data = updates(spark, random_data())
    table = plain(spark)
    sizes, before = [], set()
    for ratio in (0.1, 0.25, 0.5):
        config = ScheduledConfig(threshold_ratio=ratio)
        index = index_timetable(table, config)
        pairs = bunched_pairs(data, index, config)
        kept = set(rows(pairs, "logged_at", "stop_id", "lead_trip_id", "trailing_trip_id", "trailing_arrival_time"))
        assert before <= kept
        bounds = pairs.agg(F.min("bunch_threshold_seconds"), F.max("bunch_threshold_seconds")).first()
        assert 120 <= bounds[0] <= bounds[1] <= 600
        sizes.append((detect_scheduled(data, index, config).count(), pairs.count()))
        before = kept
    assert all(events_ <= pairs_ for events_, pairs_ in sizes)


def test_row_order_partitions_and_saved_lookups_do_not_matter(spark, scratch):
    base, table = updates(spark, random_data()), plain(spark, trips=[f"t{i}" for i in range(9)])
    index = index_timetable(table, CONFIG)
    expected = sorted(map(tuple, detect_scheduled(base, table).collect()))
    for frame, lookups in (
        (base.orderBy(F.rand(5)).repartition(9), index),
        (base.coalesce(1), index.saved(f"{scratch}/small")),
        (base, index_timetable(table, CONFIG, f"{scratch}/large")),
    ):
        assert sorted(map(tuple, detect_scheduled(frame, lookups).collect())) == expected


def test_direction_keeps_unlisted_trips(spark):
    directed = directed_updates(updates(spark, [("x", 1, "A", 0), ("u", 1, "A", 0)]), index_timetable(plain(spark)).trips)
    assert rows(directed, "trip_id", "direction_id", "trip_headsign") == [("u", "unknown", ""), ("x", "0", "to x")]


def test_an_index_for_other_headways_is_refused(spark):
    index = index_timetable(plain(spark), ScheduledConfig(max_scheduled_headway_minutes=60))
    with pytest.raises(ValueError, match="60"):
        detect_scheduled(updates(spark, [("x", 1, "A", 0)]), index, ScheduledConfig())
