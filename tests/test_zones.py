"""Results don't depend on the session's time zone, nor scratch data on one machine's folder."""

from types import SimpleNamespace

import pytest

from checks import views
from checks.queries import CONFIG
from headwise.operators import events as ev
from headwise.plans import fixed, scheduled
from headwise.session import materialise, scratch_path, shared_folder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    folder = scratch_path(spark, "zones")
    updates = materialise(views.stop_time_updates(spark, SF), f"{folder}/updates")
    return updates, scheduled.index_timetable(views.timetable(spark, SF), CONFIG, f"{folder}/index")


def test_detection_is_the_same_in_every_session_zone(spark, inputs):
    updates, index = inputs

    def found():
        pairs = scheduled.bunched_pairs(updates, index, CONFIG)
        text = ["event_date", "event_hour", "lead_arrival_local", "trailing_arrival_local", "snapshot_local"]
        local = ev.with_local_text(ev.localise(pairs, index.zone), index.zone).select("lead_trip_id", "stop_id", *text)
        events = scheduled.detect_scheduled(updates, index, CONFIG)
        plain = fixed.detect_fixed(updates).withColumn("logged_at", fixed.F.unix_seconds("logged_at"))
        return [sorted(map(str, frame.collect())) for frame in (local, events, plain)]

    results = []
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            results.append(found())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert all(results[0]) and results[0] == results[1] == results[2]


def test_scratch_data_go_where_all_executors_see_them():
    settings = {"spark.sql.warehouse.dir": "hdfs://shared/warehouse/"}
    assert shared_folder(SimpleNamespace(conf=settings)) == "hdfs://shared/warehouse/_scratch"
    settings["spark.checkpoint.dir"] = "hdfs://shared/here/"
    assert shared_folder(SimpleNamespace(conf=settings)) == "hdfs://shared/here"
