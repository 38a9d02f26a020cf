"""Report and chart tables over a hand-made event table."""

import pytest

from headwise.plans import marts, report
from headwise.schemas import EVENTS
from headwise.sources.events import write_tables
from tests.micro import rows


def event(label, stop, hour="08:00", direction="0", date="2024-01-01", name=None, lat="47.5", lon="-122.5"):
    values = dict.fromkeys(EVENTS.fieldNames())
    values.update(
        event_date=date, route_id=label, route_label=label, route_name=f"{label} - x", direction_id=direction,
        stop_id=stop, stop_name=f"Stop {stop}" if name is None else name, stop_lat=lat, stop_lon=lon,
        event_hour=hour, min_actual_headway_seconds=90, scheduled_headway_seconds=1200.0, bunch_threshold_seconds=300.0,
    )
    return tuple(values.values())


@pytest.fixture(scope="module")
def events(spark):
    data = (
        [event("1", s, h) for s, h in (("a", "08:00"), ("b", "08:00"), ("b", "09:00"), ("a", "09:00"), ("c", "23:00"))]
        + [event("2", "a", direction="1", date="2024-01-03"), event("2", "n", name="", lat="", lon="")]
        + [event("3", "n", name="", lat="n/a")]
    )
    return spark.createDataFrame(data, EVENTS)


def test_totals(spark, events):
    assert rows(report.event_totals(events), "events", "first_date", "last_date", "routes", "stops") == [
        (8, "2024-01-01", "2024-01-03", 3, 4)
    ]
    assert rows(report.event_totals(events.limit(0)), "events", "first_date", "routes") == [(0, None, 0)]


def test_hotspots_break_ties_by_key(events):
    assert [tuple(r) for r in report.top_stops(events).select("stop_id", "stop_lat", "events", "routes").collect()] == [
        ("a", "47.5", 3, 2), ("b", "47.5", 2, 1), ("c", "47.5", 1, 1), ("n", "", 1, 1), ("n", "n/a", 1, 1),
    ]
    assert [r.route_label for r in report.top_route_directions(events, 2).collect()] == ["1", "2"]
    assert [tuple(r) for r in report.top_date_hours(events, 2).collect()] == [
        ("2024-01-01", "08:00", 4, 3), ("2024-01-01", "09:00", 2, 1),
    ]
    assert [tuple(r) for r in report.top_route_direction_stops(events, 1).collect()] == [("1", "0", "a", "Stop a", 2)]


def test_breakdown_text(events):
    found = report.route_breakdown(events)
    assert rows(found.where("route_label = '1'"), "events", "stops", "where_text", "when_text", "direction_split") == [
        (
            5, 3, "Stop a [a] (events=2); Stop b [b] (events=2); Stop c [c] (events=1)",
            "08:00 (events=2); 09:00 (events=2); 23:00 (events=1)", "0 (events=5)",
        )
    ]
    assert rows(found.where("route_label = '2'"), "direction_split") == [("0 (events=1); 1 (events=1)",)]


def test_per_route_tops(spark):
    data = [event("1", f"{i:02d}", f"{i:02d}:00") for i in range(9) for _ in range(i + 1)]
    frame = spark.createDataFrame(data, EVENTS)
    assert rows(report.route_top_stops(frame), "rank", "stop_id", "events")[0] == (1, "08", 9)
    assert report.route_top_stops(frame).count() == report.route_top_hours(frame).count() == 5


def test_listing_is_in_minutes(events):
    listed = report.event_listing(events)
    assert len(listed.columns) == 20
    assert rows(listed.limit(1), "min_actual_headway", "scheduled_headway", "threshold") == [(1.5, 20.0, 5.0)]


def test_unnamed_stops_are_in_no_stop_chart(events):
    assert {r.stop_id for r in marts.top_stops(events).collect()} == {"a", "b", "c"}
    assert {r.stop_id for r in marts.stop_locations(events).collect()} == {"a", "b", "c"}
    summary = marts.route_summary(events).collect()
    assert [tuple(r) for r in summary] == [
        ("1", 5, 3, "a", "Stop a", 2, "08:00", 2), ("2", 2, 2, "a", "Stop a", 1, "08:00", 2), ("3", 1, 1, None, None, None, "08:00", 1),
    ]


def test_hours_and_matrix(events):
    assert [tuple(r) for r in marts.events_by_hour(events).collect()] == [(8, 5, 3), (9, 2, 1), (23, 1, 1)]
    matrix = marts.route_hour_matrix(events, 2).collect()
    assert [(r.route_label, r.h00, r.h08, r.h09, r.h23, r.events) for r in matrix] == [("1", 0, 2, 2, 1, 5), ("2", 0, 2, 0, 0, 2)]
    assert len([c for c in marts.route_hour_matrix(events).columns if c.startswith("h")]) == 24


def test_marker_sizes_and_labels(spark):
    data = [event("1", f"{i:02d}", lat=f"{i}", lon="1e1") for i in range(12) for _ in range(i + 1)]
    chart = marts.stop_locations(spark.createDataFrame(data, EVENTS)).collect()
    assert (chart[0].stop_id, chart[0].marker_size, chart[0].stop_lon_num) == ("11", 600.0, 10.0)
    assert chart[5].marker_size == pytest.approx(80 + 7 / 12 * 520)
    assert [r.labelled for r in chart] == [True] * 10 + [False] * 2


def test_all_tables_are_written(spark, events, scratch):
    for frames in (report.report_tables(events), marts.chart_tables(events, 3, 3)):
        write_tables(frames, scratch)
        for name, frame in frames.items():
            assert spark.read.option("header", True).csv(f"{scratch}/{name}").count() == frame.count() > 0


def test_route_direction_labels(events):
    assert [tuple(r) for r in marts.top_route_directions(events, 2).collect()] == [("1 dir 0", 5), ("2 dir 0", 1)]
    assert [tuple(r) for r in marts.top_routes(events, 1).collect()] == [("1", 5, 3)]
