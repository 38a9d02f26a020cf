from pyspark.sql import functions as F

from checks import views
from headwise.operators import timetable as tt
from tests.micro import rows, timetable


def timed(spark, stop_times):
    return tt.parse_stop_times(timetable(spark, stop_times=stop_times).stop_times)


def test_untimed_rows_are_dropped_and_hours_pass_24(spark):
    found = timed(spark, [("t", "A", "1", "bad"), ("t", "B", "2", None), ("t", "C", "x", "25:00:01")])
    assert rows(found, "stop_id", "scheduled_arrival_seconds", "stop_sequence_num") == [("C", 90001, None)]


def test_terminals_are_the_first_and_last_timed_stops(spark):
    data = [("t", "A", "1", "bad"), ("t", "B", "2", "8:00:00"), ("t", "C", "10", "8:20:00"), ("t", "D", "9", "8:10:00")]
    assert rows(tt.trip_terminal_stops(timed(spark, data)), "stop_id") == [("B",), ("C",)]


def test_loop_trip(spark):
    data = [("t", s, str(i), f"8:{i:02d}:00") for i, s in enumerate("ABCBA")]
    assert rows(tt.trip_terminal_stops(timed(spark, data)), "trip_id", "stop_id") == [("t", "A")]
    assert rows(tt.trip_stop_schedule(timed(spark, data)), "stop_id", "scheduled_arrival_seconds") == [
        ("A", 28800), ("B", 28860), ("C", 28920),
    ]
    assert rows(tt.stop_facts(timed(spark, data)), "stop_id", "scheduled_arrival_seconds", "is_terminal") == [
        ("A", 28800, True), ("B", 28860, False), ("C", 28920, False),
    ]


def test_schedule_without_a_readable_sequence(spark):
    data = [("t", "A", "", "8:05:00"), ("t", "A", "3", "8:09:00"), ("t", "B", "", "8:07:00"), ("t", "B", "?", "8:06:00")]
    expected = [("A", 29340), ("B", 29160)]
    assert rows(tt.trip_stop_schedule(timed(spark, data)), "stop_id", "scheduled_arrival_seconds") == expected
    facts = rows(tt.stop_facts(timed(spark, data)), "stop_id", "scheduled_arrival_seconds", "is_terminal")
    assert facts == [("A", 29340, True), ("B", 29160, False)]


def test_facts_equal_schedule_with_terminals(spark):
    parsed = tt.parse_stop_times(views.stop_times(spark, "/root/testdata/sf0.001"))
    columns = ["trip_id", "stop_id", "scheduled_arrival_seconds", "is_terminal"]
    joined = (
        tt.trip_stop_schedule(parsed)
        .join(tt.trip_terminal_stops(parsed).withColumn("is_terminal", F.lit(True)), ["trip_id", "stop_id"], "left")
        .na.fill(False)
    )
    assert rows(tt.stop_facts(parsed), *columns) == rows(joined, *columns)


def test_gaps_stay_within_a_service_and_the_median_spans_services(spark):
    trips = [(f"w{i}", "R", "0", "WEEK", "") for i in range(4)] + [(f"s{i}", "R", "0", "SUN", "") for i in range(2)]
    times = [("w0", "8:00:00"), ("w1", "8:10:00"), ("w2", "8:10:00"), ("w3", "8:30:00"), ("s0", "8:05:00"), ("s1", "9:05:00")]
    table = timetable(spark, trips=trips, stop_times=[(t, "A", "1", at) for t, at in times])
    gaps = tt.scheduled_gaps(tt.parse_stop_times(table.stop_times), table.trips, 14400)
    assert rows(gaps, "service_id", "scheduled_gap_seconds") == [("SUN", 3600), ("WEEK", 1200), ("WEEK", 600)]
    assert rows(tt.fallback_headways(gaps), "stop_id", "fallback_headway_seconds") == [("A", 1200.0)]


def test_gap_bounds(spark):
    trips = [(t, "R", "0", "S", "") for t in "abc"]
    times = [("a", "0:00:00"), ("b", "4:00:00"), ("c", "8:00:01")]
    table = timetable(spark, trips=trips, stop_times=[(t, "A", "1", at) for t, at in times])
    gaps = tt.scheduled_gaps(tt.parse_stop_times(table.stop_times), table.trips, 14400)
    assert rows(gaps, "scheduled_gap_seconds") == [(14400,)]


def test_lowest_values_win_for_a_repeated_trip(spark):
    table = timetable(spark, trips=[("t", "R", "1", "S", "b"), ("t", "R", "0", "S", "z"), ("u", "Q", "", "S", "")])
    assert rows(tt.trip_dimension(table.trips), "trip_id", "direction_id", "trip_headsign") == [
        ("t", "0", "z"), ("u", "", ""),
    ]
