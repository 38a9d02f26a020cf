"""The views reach what the registered queries are meant to show (FIXTURES.md)."""

import pytest

from checks import queries
from checks.compare import connect
from checks.oracle import _with

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def one():
    connection = connect(SF)
    return lambda sql, *parts: connection.execute(_with(sql, *parts)).fetchone()


def test_limits_cut(one):
    sizes = one(
        """SELECT count(DISTINCT (route_label, direction_id)), count(DISTINCT route_label), count(DISTINCT stop_id),
                  count(DISTINCT event_hour), count(DISTINCT (event_date, event_hour)) FROM bunching_events""",
        "bunching_events",
    )
    assert sizes[0] > 20 and sizes[1] > 15 and sizes[2] > 25 and sizes[3] >= 20 and sizes[4] > 30
    per_route = one(
        """SELECT max(stops), max(hours) FROM (SELECT count(DISTINCT stop_id) AS stops, count(DISTINCT event_hour) AS hours
           FROM bunching_events GROUP BY route_label)""",
        "bunching_events",
    )
    assert per_route[0] > 5 and per_route[1] > 5
    assert one("SELECT max(n) FROM (SELECT count(DISTINCT (headsign, hour_str)) AS n FROM fixed_events GROUP BY route_id)", "fixed_events")[0] > 3


def test_copies_captures_and_nulls_occur(one):
    assert one("SELECT count(*) FROM bunched", "bunched")[0] > one("SELECT count(*) FROM deduped", "deduped")[0]
    assert one("SELECT count(*) FROM bunching_events WHERE source_files LIKE '%,%'", "bunching_events")[0] > 0
    nulls = one(
        """SELECT count(*) - count(route_id), count(*) - count(stop_id), count(*) - count(arrival_time),
                  count(*) - count(stop_sequence) FROM stop_time_updates""",
        "stop_time_updates",
    )
    assert all(nulls)


def test_arrivals_cross_a_clock_change(one):
    names = one(
        """SELECT count(DISTINCT trailing_arrival_local[-3:]) FROM labelled
           WHERE event_date IN (SELECT event_date FROM labelled GROUP BY event_date
                                HAVING count(DISTINCT trailing_arrival_local[-3:]) = 2)""",
        "labelled",
    )
    assert names[0] == 2


def test_every_query_is_compared_on_whole_tables():
    assert len(queries.queries()) > 55
