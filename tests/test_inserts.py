"""Inserts of batches about as large as what is stored, and the landed snapshots they are taken from."""

import re
import uuid

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from checks import views
from headwise.session import materialise
from headwise.sources import tables
from headwise.sources.feeds import flatten_trip_updates
from tests.micro import T0, updates

SF = "/root/testdata/sf0.001"
KEY, ORDER = tables.STOP_UPDATES.key, tables.STOP_UPDATES.order


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def batch(spark, *rows):
    """(trip, stop, feed second, place in the message) each."""
    made = [(t, 1, s, 0, {"feed": None if feed is None else T0 + feed}) for t, s, feed, _ in rows]
    frame = updates(spark, made).drop("source_db").coalesce(1)
    return frame.selectExpr("*", "0L AS entity_index", "0L AS stop_index")


@pytest.fixture
def schema(spark, scratch):
    name = "s_" + uuid.uuid4().hex
    tables.ensure_tables(spark, name, f"{scratch}/{name}")
    return name


def stored(spark, schema):
    kept = spark.table(f"{schema}.stop_time_updates").where("trip_id IS NOT NULL").collect()
    return sorted(((r.trip_id, r.stop_id, r.feed_timestamp) for r in kept), key=str)


def test_an_insert_shuffles_a_batch_once(spark, scratch, schema):
    rows = views.stop_time_updates(spark, SF).select(*tables.STOP_UPDATES.schema.fieldNames(), F.lit(0).alias("entity_index"), F.lit(0).alias("stop_index"))
    staged = materialise(rows.withColumn("key_date", tables.STOP_UPDATES.key_date), f"{scratch}/staged")
    near = tables._stored_keys(staged, spark.table(f"{schema}.stop_time_updates"), KEY)
    text = plan(tables.first_unseen(staged, near, KEY, ORDER, Observation(), F.count("*")))
    dealt = re.findall(r"Exchange (hash\w+|range\w+)\((\w+)", text)  # the batch by ranges; besides, its distinct dates
    assert [by for by, _ in dealt].count("rangepartitioning") == 1 and {column for _, column in dealt} == {"key_date"}
    assert "dynamicpruningexpression(key_date" in text
    assert len(re.findall("Join", text)) == 1  # stored keys with dates


@pytest.mark.parametrize("per_row", [4, -1])  # beside what is stored, and joined with it first
def test_first_unseen_rows_are_kept_and_counted(spark, schema, monkeypatch, per_row):
    monkeypatch.setattr(tables, "_STORED_PER_ROW", per_row)
    insert = lambda frame, id: tables.insert_new(spark, schema, tables.STOP_UPDATES, frame, id)
    first = insert(batch(spark, ("a", "S", 0, 0), ("a", "S", 0, 1), ("b", "S", 0, 2), (None, "S", 0, 3)), "one")
    assert first == {"parsed": 4, "unique": 3, "new": 3}
    again = insert(batch(spark, ("b", "S", 0, 0), ("c", "S", 0, 1), ("a", "S", None, 2), ("a", "S", 90_000, 3), (None, "S", 0, 4), (None, "S", 0, 5)), "two")
    assert again == {"parsed": 6, "unique": 5, "new": 4}  # a NULL in a key matches nothing stored
    assert stored(spark, schema) == sorted([("a", "S", T0), ("b", "S", T0), ("c", "S", T0), ("a", "S", None), ("a", "S", T0 + 90_000)], key=str)
    assert spark.table(f"{schema}.stop_time_updates").where("trip_id IS NULL").count() == 2


def test_an_empty_batch_adds_nothing(spark, schema):
    assert tables.insert_new(spark, schema, tables.STOP_UPDATES, batch(spark, ("a", "S", 0, 0)).limit(0), "none") == {"parsed": 0, "unique": 0, "new": 0}


def test_lines_are_dealt_by_trip_before_they_are_multiplied(spark):
    feed = views.trip_update_feed(views.stop_time_updates(spark, SF, dealt=True))
    text = plan(feed)
    assert len(re.findall("Exchange hashpartitioning", text)) == 1 and text.index("Generate") < text.index("Exchange hash")
    flat = flatten_trip_updates(feed).select(*tables.STOP_UPDATES.schema.fieldNames())
    seen = views.stop_time_updates(spark, SF).select(*tables.STOP_UPDATES.schema.fieldNames())
    assert flat.exceptAll(seen).isEmpty() and seen.exceptAll(flat).isEmpty()


def test_compaction_shuffles_rows_once(spark, schema, monkeypatch):
    for id in ("one", "two"):
        tables.insert_new(spark, schema, tables.STOP_UPDATES, batch(spark, (id, "S", 0, 0), (id, "S", 90_000, 1)), id)
    name, plans = f"{schema}.stop_time_updates", []
    days = [r.key_date for r in spark.table(name).select("key_date").distinct().collect()]
    kind = type(spark.table(name).write)
    insert = kind.insertInto
    monkeypatch.setattr(kind, "insertInto", lambda self, to, *a, **k: plans.append(plan(self._df)) or insert(self, to, *a, **k))
    assert tables.compact(spark, schema, tables.STOP_UPDATES, days) == 4
    written = next(text for text in plans if "Scan parquet" in text and "key_date" in text and "departure_time" in text)
    assert len(re.findall(r"Exchange (?:hash|range)", written)) == 1 and "Join" not in written
    assert len(stored(spark, schema)) == 4 and spark.table(name).select("batch_id").distinct().count() == 2
