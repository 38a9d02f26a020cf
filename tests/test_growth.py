"""What must not be shuffled as tables grow."""

import re
import uuid

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from headwise.config import ScheduledConfig
from headwise.operators.adjacency import with_previous
from headwise.plans import fixed
from headwise.plans.scheduled import index_timetable, timed_pairs
from headwise.sources import tables
from tests.micro import T0, timetable, updates

CONFIG = ScheduledConfig()


def shuffled_by(df, column):
    text = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(rf"Exchange hashpartitioning\({column}#", text))


@pytest.fixture
def without_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def seen(spark, scratch):
    return updates(spark, [("a", 2, "S", 0), ("b", 2, "S", 60), ("b", 2, "S", 60), ("a", 1, "R", -60), ("a", 3, "Q", 60)])


def test_one_shuffle_by_trip_serves_both_lookups_and_the_copies(spark, seen, scratch, without_broadcasts):
    table = timetable(spark, [("a", "R", "0", "W", "X")], [("a", "S", "2", "08:00:00")])
    index = index_timetable(table, CONFIG, f"{scratch}/index")
    pairs = timed_pairs(seen, index, CONFIG)
    assert shuffled_by(pairs, "trip_id") == 3  # observations, trips, facts
    assert "source_db" not in "".join(re.findall(r"Exchange hashpartitioning\((.*)\)", pairs._jdf.queryExecution().executedPlan().toString()))
    assert [(r.lead_trip_id, r.trailing_trip_id) for r in pairs.collect()] == []  # directions differ: one trip is unlisted


def test_fixed_detection_counts_copies_where_the_bounds_were_joined(spark, seen, scratch, without_broadcasts):
    found = fixed.nonterminal_updates(seen)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hash", text)) == 2  # observations and bounds, by trip
    assert [(r.trip_id, r.stop_id, r.observations) for r in found.collect()] == [("a", "S", 1)]


def test_place_must_be_part_of_the_group(spark):
    frame = spark.createDataFrame([("g", 1, "k")], "g string, t bigint, k string")
    with pytest.raises(ValueError):
        with_previous(frame, ["g"], "t", ["k"], {"p": "t"}, 10, 5, place=["k"])


def batch(spark, *trips, at=0):
    rows = updates(spark, [(t, 1, "S", 0, {"feed": T0 + at}) for t in trips]).drop("source_db")
    return rows.selectExpr("*", "0L AS entity_index", "0L AS stop_index")


def test_a_new_batch_is_neither_compared_nor_joined(spark, scratch, monkeypatch):
    name = "s_" + uuid.uuid4().hex
    tables.ensure_tables(spark, name, f"{scratch}/{name}")
    compared, plain = [], DataFrame.exceptAll
    monkeypatch.setattr(DataFrame, "exceptAll", lambda self, other: compared.append(1) or plain(self, other))
    first = tables.insert_new(spark, name, tables.STOP_UPDATES, batch(spark, "a", "b"), "one")
    assert first["new"] == 2 and not compared
    again = tables.insert_new(spark, name, tables.STOP_UPDATES, batch(spark, "b", "a"), "one")
    assert again["new"] == 2 and compared  # a used id is still held against its rows
    with pytest.raises(ValueError):
        tables.insert_new(spark, name, tables.STOP_UPDATES, batch(spark, "c"), "one")
    target = spark.table(f"{name}.stop_time_updates")
    other = batch(spark, "a", at=10 * 86_400).withColumn("key_date", tables.STOP_UPDATES.key_date)
    assert tables.unseen(other, target, tables.STOP_UPDATES.key) is other
    assert tables.insert_new(spark, name, tables.STOP_UPDATES, batch(spark, "a", "c"), "two")["new"] == 1
