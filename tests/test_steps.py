"""Steps that must not come twice as tables grow: shuffles, sorts and aggregates over many small groups."""

import re

from checks import views
from headwise.operators import events as ev
from headwise.operators.timetable import facts_by_trip, parse_stop_times, stop_facts
from headwise.session import materialise
from tests.micro import T0

SF = "/root/testdata/sf0.001"
ZONE = "America/Los_Angeles"
PAIR = """lead_trip_id string, trailing_trip_id string, route_id string, direction_id string, stop_id string, source_db string,
    logged_at timestamp, feed_timestamp bigint, lead_arrival_time bigint, trailing_arrival_time bigint,
    actual_headway_seconds bigint, scheduled_headway_seconds double, bunch_threshold_seconds double, headway_source string"""


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sighting(at, source="a", lead="t1", feed=0, arrival=600, headway=60):
    arrives = T0 + arrival
    return (lead, "t2", "R", "0", None, source, at, feed, arrives - headway, arrives, headway, 600.0, 150.0, "default")


def collapsed(spark, scratch, rows):
    pairs = materialise(spark.createDataFrame(rows, PAIR), f"{scratch}/pairs")
    dealt = ev.co_locate_events(ev.localise(pairs, ZONE))
    return ev.collapse_observations(ev.dedupe_observations(dealt), ZONE)


def test_sightings_are_sorted_once_for_the_dedupe_and_the_collapse(spark, scratch):
    text = plan(collapsed(spark, scratch, [sighting(None)]))
    assert "Aggregate" not in text and len(re.findall(r"\bSort \[", text)) == 1
    assert len(re.findall("Exchange hash", text)) == 1


def test_events_sum_up_their_sightings(spark, scratch):
    from datetime import datetime

    early, late = datetime(2026, 1, 1, 12), datetime(2026, 1, 1, 13)
    rows = [
        sighting(early, "b", feed=5, headway=60),
        sighting(early, "a", feed=5, headway=60),  # the same sighting in another capture
        sighting(late, "b", feed=9, headway=90, arrival=640),
        sighting(None, "b", feed=None, headway=30, arrival=580),
        sighting(early, "c", lead=None, headway=20),
    ]
    found = {r.lead_trip_id: r for r in collapsed(spark, scratch, rows).collect()}
    assert set(found) == {"t1", None}
    one = found["t1"]
    assert (one.snapshots_flagged, one.source_files, one.min_actual_headway_seconds) == (2, "a, b", 30)
    assert (one.median_actual_headway_seconds, one.scheduled_headway_seconds, one.stop_id) == (60.0, 600.0, None)
    assert (one.first_seen[17:19], one.last_seen[17:19]) == ("05", "09")
    assert "logged_at" not in one.asDict() and found[None].source_files == "c"


def test_facts_of_a_trip_take_one_shuffle(spark, scratch):
    timed = materialise(parse_stop_times(views.stop_times(spark, SF)), f"{scratch}/timed")
    assert len(re.findall("Exchange", plan(facts_by_trip(stop_facts(timed))))) == 1
