import json
import os
import time
import uuid
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from headwise import session
from headwise.plans.ingest import ingest
from headwise.schemas import FEED_ENTITY, FEED_MESSAGE
from headwise.sources import feeds, tables
from headwise.streaming import ingest as streaming
from headwise.streaming.ingest import ingest_feeds, stream_ingest
from tests.micro import T0, rows


def at(seconds):
    return datetime.fromtimestamp(T0 + seconds, timezone.utc)


def trip(trip_id="t", stops=(("A", 1),), stamp=T0, route="R"):
    return {
        "trip_update": {
            "trip": {"trip_id": trip_id, "route_id": route},
            "timestamp": stamp,
            "stop_time_update": [
                {"stop_sequence": n, "stop_id": s, "arrival": {"time": T0 + n}} for s, n in stops
            ],
        }
    }


def vehicle(vehicle_id="v", stamp=T0, **position):
    return {
        "vehicle": {
            "vehicle": {"id": vehicle_id},
            "trip": {"trip_id": "t", "route_id": ""},
            "position": position,
            "timestamp": stamp,
        }
    }


def snapshot(*entities, logged=0):
    stamp = at(logged).strftime("%Y-%m-%dT%H:%M:%SZ")
    return [{"logged_at": stamp, "entity_index": i, **e} for i, e in enumerate(entities)]


def feed(spark, *records, scratch):
    path = f"{scratch}/{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(r),) for r in records], "value string").coalesce(1).write.text(path)
    return spark.read.schema(FEED_ENTITY).json(path)


@pytest.fixture
def schema(spark, scratch):
    name = "s_" + uuid.uuid4().hex
    tables.ensure_tables(spark, name, f"{scratch}/{name}")
    tables.ensure_tables(spark, name)
    return name


def test_vehicles_null_rules(spark, scratch):
    frame = feed(
        spark, *snapshot(vehicle("", 0, latitude=0.0, speed=3.5), trip(), vehicle("v", 7)), scratch=scratch
    )
    found = feeds.flatten_vehicles(frame)
    assert rows(found, "entity_index", "vehicle_id", "trip_id", "route_id", "latitude", "longitude", "speed", "vehicle_timestamp") == [
        (0, None, "t", None, 0.0, None, 3.5, None),
        (2, "v", "t", None, None, None, None, 7),
    ]


def test_trip_updates_one_row_per_stop(spark, scratch):
    bare = {"trip_update": {"trip": {"trip_id": ""}, "timestamp": 0, "stop_time_update": [{"stop_id": "", "departure": {"delay": 0}}]}}
    frame = feed(spark, *snapshot(trip(stops=(("A", 1), ("B", 2))), bare, trip("none", ()), vehicle()), scratch=scratch)
    found = feeds.flatten_trip_updates(frame)
    assert rows(
        found, "entity_index", "stop_index", "trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_delay", "feed_timestamp"
    ) == [
        (0, 0, "t", "A", 1, T0 + 1, None, T0),
        (0, 1, "t", "B", 2, T0 + 2, None, T0),
        (1, 0, None, None, None, None, 0, None),
    ]


def test_whole_messages_become_entities(spark):
    record = {"logged_at": at(0).strftime("%Y-%m-%dT%H:%M:%SZ"), "entity": [vehicle(), trip()]}
    messages = spark.read.schema(FEED_MESSAGE).json(spark.sparkContext.parallelize([json.dumps(record)]))
    entities = feeds.entities(messages)
    assert rows(feeds.flatten_trip_updates(entities), "entity_index", "trip_id", "logged_at") == [
        (1, "t", at(0).replace(tzinfo=None))
    ]


def stored(spark, schema, table=tables.STOP_UPDATES):
    name = f"{schema}.{table.name}"
    return rows(tables.read_observations(spark, name), *table.key, "logged_at")


def insert(spark, schema, frame, batch, table=tables.STOP_UPDATES, flatten=feeds.flatten_trip_updates):
    return tables.insert_new(spark, schema, table, flatten(frame), batch)


def test_first_wins_within_a_batch_and_against_the_target(spark, schema, scratch):
    first = feed(spark, *snapshot(trip(stops=(("A", 1), ("A", 7), ("B", 2)))), scratch=scratch)
    assert insert(spark, schema, first, "1") == {"parsed": 3, "unique": 2, "new": 2}
    assert insert(spark, schema, first, "2") == {"parsed": 3, "unique": 2, "new": 0}
    later = feed(spark, *snapshot(trip(), trip(stamp=T0 + 20), logged=20), scratch=scratch)
    assert insert(spark, schema, later, "3") == {"parsed": 2, "unique": 2, "new": 1}
    kept = tables.read_observations(spark, f"{schema}.stop_time_updates")
    assert rows(kept, "stop_id", "stop_sequence", "feed_timestamp") == [
        ("A", 1, T0), ("A", 1, T0 + 20), ("B", 2, T0),
    ]


def test_null_keys_are_one_per_batch_and_match_no_other(spark, schema, scratch):
    frame = feed(spark, *snapshot(vehicle("", 5), vehicle("", 5), vehicle("v", 0), vehicle("v", 5)), scratch=scratch)
    for batch in "12":
        insert(spark, schema, frame, batch, tables.VEHICLES, feeds.flatten_vehicles)
    assert [r[:2] for r in stored(spark, schema, tables.VEHICLES)] == [
        ("v", 5), ("v", None), ("v", None), (None, 5), (None, 5),
    ]


def test_a_replayed_batch_rewrites_itself(spark, schema, scratch):
    frame = feed(spark, *snapshot(trip(stops=(("A", 1), ("", 2)))), scratch=scratch)
    insert(spark, schema, frame, "1")
    before = stored(spark, schema)
    assert insert(spark, schema, frame, "1") == {"parsed": 2, "unique": 2, "new": 2}
    assert stored(spark, schema) == before


def test_keys_on_many_dates(spark, schema, scratch):
    frame = feed(spark, *snapshot(*[trip(stamp=T0 + 86_400 * day) for day in range(4)]), scratch=scratch)
    assert insert(spark, schema, frame, "1")["new"] == 4
    assert insert(spark, schema, frame, "2")["new"] == 0


def test_an_id_used_for_other_rows_is_refused(spark, schema, scratch):
    insert(spark, schema, feed(spark, *snapshot(trip()), scratch=scratch), "1")
    with pytest.raises(ValueError, match="other rows"):
        insert(spark, schema, feed(spark, *snapshot(trip("u")), scratch=scratch), "1")


def test_the_session_zone_does_not_move_a_key(spark, schema, scratch):
    frame = feed(spark, *snapshot(trip(stamp=T0)), scratch=scratch)
    try:
        for batch, zone in (("1", "UTC"), ("2", "America/Los_Angeles"), ("3", "Asia/Tokyo")):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert insert(spark, schema, frame, batch)["new"] == (batch == "1")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def many_batches(spark, schema, scratch):
    """Three batches on two dates, and the frames they came from."""
    frames = [
        feed(spark, *snapshot(trip(str(n), (("A", 1), ("", 2)), T0), trip(str(n), stamp=T0 + 86_400), logged=n), scratch=scratch)
        for n in range(3)
    ]
    for number, frame in enumerate(frames):
        insert(spark, schema, frame, str(number))
    return frames, [date(1970, 1, 1) + timedelta(days=T0 // 86_400 + d) for d in range(2)]


def partitions(spark, schema):
    return [r[0].split("/")[0] for r in spark.sql(f"SHOW PARTITIONS {schema}.stop_time_updates").collect()]


def test_compaction_leaves_one_partition_a_date_and_replays_add_nothing(spark, schema, scratch):
    frames, days = many_batches(spark, schema, scratch)
    before = stored(spark, schema)
    assert len(partitions(spark, schema)) == 6
    assert tables.compact(spark, schema, tables.STOP_UPDATES, days) == 6
    assert sorted(partitions(spark, schema)) == sorted(f"key_date={d}" for d in days)
    assert stored(spark, schema) == before
    for number, frame in enumerate(frames):
        assert insert(spark, schema, frame, str(number))["new"] == 0
    assert stored(spark, schema) == before
    assert insert(spark, schema, feed(spark, *snapshot(trip("late")), scratch=scratch), "late")["new"] == 1
    assert tables.compact(spark, schema, tables.STOP_UPDATES, days) == 2
    assert tables.compact(spark, schema, tables.STOP_UPDATES, days) == 0
    assert len(stored(spark, schema)) == len(before) + 1
    with pytest.raises(ValueError, match="other rows"):
        insert(spark, schema, feed(spark, *snapshot(trip("other")), scratch=scratch), "1")


STEPS = ["begun", "written", "listed", "dropped", "finished"]


@pytest.mark.parametrize("stopped_after", STEPS[:-1])
def test_readers_see_every_row_once_whatever_happens_to_a_compaction(spark, schema, scratch, stopped_after):
    """A read after every step, a run stopped after one of them, a late batch, a replay, the next run."""
    frames, days = many_batches(spark, schema, scratch)
    before, taken = stored(spark, schema), []
    for step, _ in tables.compaction_steps(spark, schema, tables.STOP_UPDATES, days):
        taken.append(step)
        assert stored(spark, schema) == before, step
        if step == stopped_after:
            break
    assert taken == STEPS[: STEPS.index(stopped_after) + 1]
    assert insert(spark, schema, frames[1], "1")["new"] in (0, 3)  # a replay, of a listed batch or one that isn't
    assert stored(spark, schema) == before
    insert(spark, schema, feed(spark, *snapshot(trip("late")), scratch=scratch), "late")
    after = stored(spark, schema)
    assert len(after) == len(before) + 1
    for step, _ in tables.compaction_steps(spark, schema, tables.STOP_UPDATES, days):
        assert stored(spark, schema) == after, step
    assert sorted(partitions(spark, schema)) == sorted(f"key_date={d}" for d in days)
    assert tables.compact(spark, schema, tables.STOP_UPDATES, days) == 0


def test_hidden_partitions_are_not_scanned(spark, schema, scratch):
    _, days = many_batches(spark, schema, scratch)
    steps = tables.compaction_steps(spark, schema, tables.STOP_UPDATES, days)
    while next(steps)[0] != "listed":
        pass
    frame = tables.read_observations(spark, f"{schema}.stop_time_updates")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "PartitionFilters: [" in plan and "batch_id" in plan.split("PartitionFilters")[1]
    read = {row[0].split("batch_id=")[1].split("/")[0] for row in frame.select(F.input_file_name()).distinct().collect()}
    assert read and all(batch.startswith("compacted-") for batch in read)


def test_nothing_is_left_in_scratch(spark, schema, scratch, monkeypatch):
    """After inserts, compaction and a failed insert."""
    monkeypatch.setattr(session, "shared_folder", lambda spark: f"{scratch}/shared")
    frames, days = many_batches(spark, schema, scratch)
    tables.compact(spark, schema, tables.STOP_UPDATES, days)
    with pytest.raises(ValueError):
        insert(spark, schema, feed(spark, *snapshot(trip("other")), scratch=scratch), "1")
    left = os.listdir(f"{scratch}/shared")
    assert [name for name in left if not name.startswith(".")] == []


def test_scratch_of_a_block_goes_with_it_and_orphans_are_swept_by_age(spark, scratch, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark: f"{scratch}/shared")
    with session.scratch(spark, "outer") as outer:
        inner = session.scratch_path(spark, "inner")
        assert inner.startswith(outer + "/inner-")
        assert session.materialise(spark.range(3), inner).count() == 3
    with pytest.raises(ZeroDivisionError), session.scratch(spark, "fails") as failed:
        session.materialise(spark.range(3), f"{failed}/rows").where(1 / 0)
    assert os.listdir(f"{scratch}/shared") == []
    old, new, foreign = (session.scratch_path(spark, n) for n in ("old", "new", "x"))
    foreign = f"{scratch}/shared/not-ours"
    for folder in (old, new, foreign):
        session.materialise(spark.range(1), f"{folder}/rows")
    for folder in (old, foreign):
        for where, _, files in os.walk(folder, topdown=False):
            for entry in [*(f"{where}/{f}" for f in files), where]:
                os.utime(entry, (T0, T0))
    os.utime(new, (T0, T0))  # something in it is young
    assert session.sweep_scratch(spark, 24) == [os.path.basename(old)]
    assert sorted(os.listdir(f"{scratch}/shared")) == sorted(map(os.path.basename, (new, foreign)))


def test_batch_cycle_reports_both_feeds(spark, schema, scratch):
    frame = feed(spark, *snapshot(vehicle(), vehicle(), trip()), scratch=scratch)
    assert rows(ingest(spark, frame, schema, "1"), "feed", "parsed_rows", "unique_rows", "new_rows", "error") == [
        ("stop_time_updates", 1, 1, 1, None), ("vehicle_positions", 2, 1, 1, None),
    ]


def land(folder, number, records):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"{number:03d}.json"
    path.write_text("\n".join(json.dumps(r) for r in records) + "\n")
    os.utime(path, (T0 + number, T0 + number))  # a stream takes the oldest files first


def test_stream_equals_batch_and_restarts_cleanly(spark, schema, tmp_path):
    landing = tmp_path / "landing"
    shots = [
        snapshot(trip(stops=(("A", 1), ("B", 2)), stamp=T0 + 20 * (i // 2)), trip("", stamp=T0), vehicle(), logged=20 * i)
        for i in range(4)
    ]
    for i, shot in enumerate(shots[:3]):
        land(landing, i, shot)
    run = lambda: ingest_feeds(
        spark, {"stop_time_updates": str(landing), "vehicle_positions": str(landing)}, schema, str(tmp_path / "ck"), files_per_batch=1
    )
    assert {n: (o.error, o.batches) for n, o in run().items()} == {
        "stop_time_updates": (None, 3), "vehicle_positions": (None, 3),
    }
    land(landing, 3, shots[3])
    run()
    run()
    batch = "b_" + uuid.uuid4().hex
    tables.ensure_tables(spark, batch, f"{tmp_path}/{batch}")
    for i in range(4):
        frame = spark.read.schema(FEED_ENTITY).json(str(landing / f"{i:03d}.json"))
        insert(spark, batch, frame, str(i))
        insert(spark, batch, frame, str(i), tables.VEHICLES, feeds.flatten_vehicles)
    for table in (tables.STOP_UPDATES, tables.VEHICLES):
        assert stored(spark, schema, table) == stored(spark, batch, table)
    assert len(stored(spark, schema)) == 8


def test_one_failing_feed_does_not_stop_the_other(spark, schema, tmp_path):
    land(tmp_path / "good", 0, snapshot(trip()))
    outcome = ingest_feeds(
        spark, {"vehicle_positions": str(tmp_path / "missing"), "stop_time_updates": str(tmp_path / "good")}, schema, str(tmp_path / "ck"),
        retries=2, first_wait=0.01,
    )
    assert outcome["vehicle_positions"].restarts == 2 and outcome["stop_time_updates"].restarts == 0
    assert outcome["stop_time_updates"].error is None and outcome["vehicle_positions"].error is not None
    assert len(stored(spark, schema)) == 1
    with pytest.raises(RuntimeError):
        ingest_feeds(spark, {"vehicle_positions": str(tmp_path / "missing")}, schema, str(tmp_path / "ck2"), retries=0)


def test_a_feed_that_fails_comes_back_and_loses_no_row(spark, schema, tmp_path):
    """It fails before, in and after its first batch; waits grow, and begin anew after a batch."""
    for n in range(3):
        land(tmp_path / "in", n, snapshot(vehicle(stamp=T0 + n), logged=n))
    name, times = f"{schema}.vehicle_positions", []
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}_away")

    def failure(feed, cause):
        times.append(time.monotonic())
        if len(times) == 2:
            spark.sql(f"ALTER TABLE {name}_away RENAME TO {name}")

    kept, calls = streaming.insert_new, []

    def insert_once_then_fail(*args):
        counts = kept(*args)
        calls.append(counts)
        if len(calls) == 2:
            raise OSError("lost after the rows were written")
        return counts

    streaming.insert_new = insert_once_then_fail
    try:
        outcome = ingest_feeds(
            spark, {"vehicle_positions": str(tmp_path / "in")}, schema, str(tmp_path / "ck"), failure,
            files_per_batch=1, retries=2, first_wait=0.5, poll_seconds=0.1,
        )["vehicle_positions"]
    finally:
        streaming.insert_new = kept
    assert (outcome.error, outcome.restarts, outcome.batches, outcome.new) == (None, 3, 3, 3) and len(times) == 3
    assert times[1] - times[0] >= 0.5
    assert [r[1] for r in stored(spark, schema, tables.VEHICLES)] == [T0, T0 + 1, T0 + 2]


def test_a_feed_is_given_up_after_failures_without_a_batch(spark, schema, tmp_path):
    land(tmp_path / "in", 0, snapshot(trip()))
    spark.sql(f"DROP TABLE {schema}.vehicle_positions")
    told = []
    outcome = ingest_feeds(
        spark, {"vehicle_positions": str(tmp_path / "in"), "stop_time_updates": str(tmp_path / "in")}, schema, str(tmp_path / "ck"),
        lambda name, cause: told.append(name), retries=1, first_wait=0.01,
    )
    assert told == ["vehicle_positions"] * 2 and outcome["vehicle_positions"].error is not None
    assert outcome["vehicle_positions"].restarts == 1 and outcome["stop_time_updates"].new == 1

def test_lines_that_cannot_be_parsed_are_counted(spark, schema, tmp_path):
    good = json.dumps(snapshot(trip())[0])
    (tmp_path / "in").mkdir()
    wrong = good.replace('"timestamp": ' + str(T0), '"timestamp": "soon"')
    (tmp_path / "in" / "a.json").write_text("\n".join([good, good[:40], wrong]) + "\n")
    outcome = ingest_feeds(spark, {"stop_time_updates": str(tmp_path / "in")}, schema, str(tmp_path / "ck"))
    found = outcome["stop_time_updates"]
    assert (found.error, found.rejected, found.parsed, found.new) == (None, 2, 1, 1)
    assert len(stored(spark, schema)) == 1
    kept = tables.read_rejected(spark, f"{schema}.stop_time_updates")
    assert kept.groupBy("batch_id").count().count() == 1
    assert sorted((r.line, r.file.rsplit("/", 1)[1], r.reason) for r in kept.collect()) == sorted(
        [(good[:40], "a.json", "no JSON"), (wrong, "a.json", "not as declared: trip_update")]
    )


def test_rejected_lines_of_a_replayed_batch_are_kept_once(spark, schema, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"logged_at"\n\n5\n[1]\n{"logged_at": "x", "entity_index": []}\n' + json.dumps(snapshot(trip())[0]) + "\n")
    kept = streaming.keep_rejected

    def keep_then_fail(*args):
        kept(*args)
        streaming.keep_rejected = kept
        raise OSError("lost after the lines were written")

    streaming.keep_rejected = keep_then_fail
    try:
        outcome = ingest_feeds(spark, {"stop_time_updates": str(tmp_path / "in")}, schema, str(tmp_path / "ck"), first_wait=0.01)
    finally:
        streaming.keep_rejected = kept
    found = outcome["stop_time_updates"]
    assert (found.restarts, found.rejected, found.new) == (1, 4, 1)
    assert rows(tables.read_rejected(spark, f"{schema}.stop_time_updates"), "line", "reason") == [
        ("5", "no object as declared"), ("[1]", "no object as declared"),
        ('{"logged_at"', "no JSON"), ('{"logged_at": "x", "entity_index": []}', "not as declared: logged_at, entity_index"),
    ]


def test_a_failure_is_reported_while_the_other_feed_runs_on(spark, schema, tmp_path):
    """In continuous mode, and with another schema's feeds in the same session."""
    other = "o_" + uuid.uuid4().hex
    tables.ensure_tables(spark, other, f"{tmp_path}/{other}")
    for name in ("good", "bad", "more"):
        land(tmp_path / name, 0, snapshot(trip(), vehicle()))
    beside = stream_ingest(spark, str(tmp_path / "more"), other, tables.VEHICLES, str(tmp_path / "ck-o"), continuous_seconds=1)
    told = {}

    def failure(name, cause):
        told[name] = {query.name for query in spark.streams.active}
        deadline = time.time() + 60
        while not stored(spark, schema) and time.time() < deadline:
            time.sleep(0.5)
        for query in spark.streams.active:
            query.stop()

    spark.sql(f"DROP TABLE {schema}.vehicle_positions")
    landing = {"stop_time_updates": str(tmp_path / "good"), "vehicle_positions": str(tmp_path / "bad")}
    outcome = ingest_feeds(spark, landing, schema, str(tmp_path / "ck"), on_failure=failure, continuous_seconds=1, retries=0)
    assert told == {"vehicle_positions": {f"ingest_{schema}_stop_time_updates", f"ingest_{other}_vehicle_positions"}}
    assert outcome["vehicle_positions"].error and not outcome["stop_time_updates"].error
    assert len(stored(spark, schema)) == 1
    beside.awaitTermination()


def test_latest_rows(spark):
    frame = spark.range(10).select("id", (F.col("id") % 3).alias("logged_at"))
    assert [tuple(r) for r in tables.latest_rows(frame, ["id"], ["logged_at", "id"]).collect()] == [(8,), (5,)]


def test_newest_rows_are_found_without_scanning_history(spark, schema, scratch):
    """Late rows of old dates count by their capture time; batches are compacted in between."""
    name, shots = f"{schema}.stop_time_updates", []
    for n in range(12):
        late = [trip(f"late{n}", stamp=T0 - 86_400 * 30)] if n == 7 else []
        shots.append(snapshot(trip(f"t{n}", (("A", 1), ("B", 2)), T0 + 86_400 * (n // 3)), *late, logged=100 * (n if n != 4 else 20)))
        insert(spark, schema, feed(spark, *shots[-1], scratch=scratch), f"b{n:02d}")
    order, columns = ["trip_id", "stop_id"], ["trip_id", "stop_id", "logged_at"]
    whole = tables.read_observations(spark, name)

    def expected(n):
        return [tuple(r) for r in whole.orderBy(*[F.desc(c) for c in ("logged_at", *order)]).limit(n).select(*columns).collect()]

    for n in (0, 1, 2, 3, 5, 13, 24, 25, 100):
        found = tables.newest_rows(spark, name, columns, order, n, at_once=1)
        assert [tuple(r) for r in found.collect()] == expected(n), n
    two = tables.newest_rows(spark, name, columns, order, 2, at_once=1)
    assert two.first().trip_id == "t4"
    read = tables.newest_rows(spark, name, ["trip_id"], order, 3, at_once=1)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [batch_id" in plan and "b00" not in plan and "b10" not in plan
    day = date(1970, 1, 1) + timedelta(days=T0 // 86_400)
    before = expected(25)
    tables.compact(spark, schema, tables.STOP_UPDATES, [day, day + timedelta(days=1), day - timedelta(days=30)])
    whole = tables.read_observations(spark, name)
    for n in (1, 3, 25):
        found = tables.newest_rows(spark, name, columns, order, n, at_once=2)
        assert [tuple(r) for r in found.collect()] == before[:n] == expected(n)
