"""What the physical plans must and must not contain."""

import re

import pytest

from checks import queries as registry
from checks import views
from checks.queries import CONFIG, event_table
from headwise.operators.pairs import candidate_pairs
from headwise.plans import fixed, report
from headwise.plans.scheduled import bunched_pairs, detect_scheduled, directed_updates, index_timetable
from headwise.session import saved_lookup
from headwise.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"Exchange (?:hash|range|single)", text))


@pytest.fixture
def saved(spark, scratch):
    updates = saved_lookup(views.stop_time_updates(spark, SF), f"{scratch}/updates")
    return updates, index_timetable(views.timetable(spark, SF), CONFIG, f"{scratch}/index")


def test_observations_are_shuffled_twice_and_pairs_once(saved):
    updates, index = saved
    assert exchanges(plan(bunched_pairs(updates, index, CONFIG))) == 2
    text = plan(detect_scheduled(updates, index, CONFIG))
    assert exchanges(text) == 3
    assert "SortMergeJoin" not in text


def test_copies_are_combined_before_the_first_shuffle(saved):
    updates, index = saved
    text = plan(bunched_pairs(updates, index, CONFIG))
    below = text[text.rindex("Exchange hashpartitioning"):]
    assert "partial_min" in below and "HashAggregate" in below


def test_lookups_beyond_the_threshold_are_not_broadcast(spark, scratch):
    updates = saved_lookup(views.stop_time_updates(spark, SF), f"{scratch}/updates")
    index = index_timetable(views.timetable(spark, SF), CONFIG, f"{scratch}/index")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(bunched_pairs(updates, index, CONFIG))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in text and "SortMergeJoin" in text


def test_unused_columns_and_null_rows_stay_in_the_files(saved):
    updates, index = saved
    text = plan(candidate_pairs(directed_updates(updates, index.trips), CONFIG))
    scan = text[text.index("FileScan"):].splitlines()[0]
    schema = re.search(r"ReadSchema: struct<(.*)>", scan).group(1)
    assert "departure" not in schema and "arrival_delay" not in schema
    for column in ("arrival_time", "trip_id", "route_id", "stop_id"):
        assert f"IsNotNull({column})" in scan


def test_fixed_detection_shuffles(saved, scratch):
    updates, _ = saved
    bounds = saved_lookup(fixed.observed_bounds(updates), f"{scratch}/bounds")
    assert exchanges(plan(fixed.detect_fixed(updates, bounds=bounds))) == 3


def test_top_per_group_is_pruned_before_the_shuffle(spark):
    text = plan(report.route_top_stops(event_table(spark, SF)))
    assert "WindowGroupLimit" in text


def test_top_n_needs_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(report.top_stops(event_table(spark, SF)))


def test_first_per_key_is_pruned_before_the_shuffle(spark):
    rows = views.vehicle_positions(spark, SF)
    text = plan(tables.first_per_key(rows, tables.VEHICLES.key, tables.VEHICLES.order))
    assert "WindowGroupLimit" in text[text.index("Exchange"):]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_python_workers_and_no_cross_joins(spark, name):
    if name.startswith(("stream_ingest", "insert_new", "compacted", "ingest_")):
        pytest.skip("writes; the frame returned is the target table")
    text = plan(registry.queries()[name](spark, SF))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert forbidden not in text


def test_the_target_is_pruned_by_the_dates_of_the_batch(spark, scratch):
    name = "pruned_" + scratch.rsplit("-", 1)[1].replace("_", "x")
    tables.ensure_tables(spark, name, f"{scratch}/{name}")
    rows = views.stop_time_updates(spark, SF).select(*tables.STOP_UPDATES.schema.fieldNames())
    batch = saved_lookup(rows.withColumn("key_date", tables.STOP_UPDATES.key_date), f"{scratch}/batch")
    text = plan(tables.unseen(batch, spark.table(f"{name}.stop_time_updates"), tables.STOP_UPDATES.key))
    assert "dynamicpruningexpression(key_date" in text
