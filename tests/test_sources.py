import pytest
from pyspark.sql import functions as F

from headwise.plans import fixed
from headwise.plans.scheduled import EVENT_ORDER
from headwise.schemas import EVENT_MINUTES, EVENTS, STOP_TIME_UPDATES
from headwise.sources import captures, events, static
from headwise.sources.delimited import has_broken_lines, read_delimited
from tests.micro import rows, updates


@pytest.fixture
def folder(tmp_path):
    files = {
        "agency": "agency_id,agency_timezone\nx,\ny,America/Los_Angeles\n",
        "routes": '﻿route_desc,route_id,agency,route_long_name,route_short_name\n"a ""b"", c",1,x,Long,NA\n,2,x,,Two\n',
        "stops": "stop_id,stop_name,stop_lat,stop_lon,zone\nA,Main,47.1,-122.2,z\nB,null,n/a,,z\n",
        "trips": "route_id,service_id,trip_id,trip_headsign,direction_id\n1,S,007,Home,0\n1,S,t,,\n",
        "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n007,8:00:00,,A,1\nt,,,B,2\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.txt").write_text(text, encoding="utf-8")
    return tmp_path


def test_static_cells_are_text_and_missing_values_follow_the_table(spark, folder):
    read = static.read_static(spark, str(folder))
    assert read.zone == "America/Los_Angeles"
    assert rows(read.routes, *static.COLUMNS["routes"]) == [("1", "", "Long", 'a "b", c'), ("2", "Two", "", "")]
    assert rows(read.stops, "stop_id", "stop_name", "stop_lat", "stop_lon") == [
        ("A", "Main", "47.1", "-122.2"), ("B", "", "", ""),
    ]
    assert rows(read.trips, "trip_id", "trip_headsign", "direction_id") == [("007", "Home", "0"), ("t", "", "")]
    assert rows(read.stop_times, "trip_id", "arrival_time") == [("007", "8:00:00"), ("t", None)]


def test_missing_columns_are_named(spark, folder):
    (folder / "trips.txt").write_text("trip_id,route_id,direction_id\nt,1,0\n")
    with pytest.raises(ValueError, match="trips.txt: no column service_id; no column trip_headsign"):
        static.read_static(spark, str(folder))


@pytest.mark.parametrize("zones", ["Mars/Olympus", ""])
def test_zone_is_validated(spark, folder, zones):
    (folder / "agency.txt").write_text(f"agency_timezone\n{zones}\n")
    with pytest.raises(ValueError):
        static.read_static(spark, str(folder))


@pytest.fixture
def capture_root(spark, tmp_path):
    for name, trips in (("day 1.db", "xy"), ("day 2.db", "z")):
        data = updates(spark, [(t, 1, "A", i * 10) for i, t in enumerate(trips)])
        data.drop("source_db").coalesce(1).write.parquet(str(tmp_path / name / "stop_time_updates"))
    (tmp_path / "day 3.db").mkdir()
    broken = tmp_path / "day 4.db" / "stop_time_updates"
    broken.mkdir(parents=True)
    (broken / "part.parquet").write_bytes(b"not parquet")
    spark.range(3).write.parquet(str(tmp_path / "day 5.db" / "stop_time_updates"))
    return tmp_path


def test_captures_are_read_together_and_bad_ones_are_reported(spark, capture_root):
    found = captures.list_captures(spark, f"{capture_root}/*.db")
    assert [c.name for c in found] == [f"day {i}.db" for i in range(1, 6)]
    data = captures.read_captures(spark, found)
    assert rows(data, "source_db", "trip_id") == [("day 1.db", "x"), ("day 1.db", "y"), ("day 2.db", "z")]
    assert set(data.columns) == {*STOP_TIME_UPDATES.fieldNames(), "source_db"}
    counts = captures.PairCounts(found)
    assert counts.watch(data.where("trip_id = 'y'")).count() == 1
    status = dict(counts.status(spark).collect())
    assert status["day 1.db"] == "ok: 1 candidate pairs"
    assert status["day 2.db"] == "ok: no candidate pairs"
    assert status["day 3.db"] == "skipped: no stop_time_updates table"
    assert status["day 4.db"] == captures.UNREADABLE
    assert status["day 5.db"].startswith("error: no column trip_id; no column route_id")


def test_pairs_of_thousands_of_captures_are_one_metric(spark):
    """The plan doesn't grow with the captures, and every one's count is exact."""
    pairs = spark.range(60_000).select(F.concat(F.lit("c"), F.floor(F.sqrt("id")).cast("string")).alias("source_db"))
    sizes = []
    for number, room in ((3, 50_000), (5000, 50_000), (5000, 40)):
        found = [captures.Capture(f"c{n}", "p") for n in range(number - 1)] + [captures.Capture("bad", "p", "error: no")]
        here = pairs.join(spark.createDataFrame([(c.name,) for c in found], "source_db string"), "source_db", "left_semi")
        counts = captures.PairCounts(found, room)
        watched = counts.watch(here)
        sizes.append(watched._jdf.queryExecution().analyzed().toString().count("approx_top_k"))
        watched.count()
        status = dict(counts.status(spark).collect())
        assert len(status) == number and status["bad"] == "error: no"
        for n in range(number - 1):
            expected = max(min((n + 1) ** 2, 60_000) - n * n, 0)
            assert status[f"c{n}"] == (f"ok: {expected:,} candidate pairs" if expected else captures.NO_PAIRS), n
    assert sizes[0] == sizes[1] < sizes[2]


def test_one_bad_file_or_type_costs_its_capture_only(spark, tmp_path):
    names = ["a+b", "50%", "plain", "bad second file", "text times"]
    for name in names:
        data = updates(spark, [("x", 1, "A", 0)]).drop("source_db").coalesce(1)
        if name == "text times":
            data = data.withColumn("arrival_time", F.col("arrival_time").cast("string"))
        data.write.parquet(str(tmp_path / name / "stop_time_updates"))
    (tmp_path / "bad second file" / "stop_time_updates" / "zz.parquet").write_bytes(b"not parquet")
    found = captures.list_captures(spark, f"{tmp_path}/*")
    assert {c.name: c.problem for c in found} == {
        "a+b": None, "50%": None, "plain": None, "bad second file": captures.UNREADABLE,
        "text times": "error: arrival_time is string, not bigint",
    }
    assert rows(captures.read_captures(spark, found), "source_db") == [("50%",), ("a+b",), ("plain",)]


def test_damage_inside_a_file_costs_its_capture_only(spark, tmp_path):
    """Row groups before the damage can be read, but a capture is taken whole or not at all."""
    rows_of = [("t%d" % (n // 50), n % 50, "A", n) for n in range(4000)]
    for name in ("sound", "spoilt", "short"):
        data = updates(spark, rows_of[: 10 if name == "short" else 4000]).drop("source_db").coalesce(1)
        data.write.option("parquet.block.size", 20_000).option("parquet.page.row.count.limit", 200).parquet(str(tmp_path / name / "stop_time_updates"))
    (spoilt,) = (tmp_path / "spoilt" / "stop_time_updates").glob("*.parquet")
    content = bytearray(spoilt.read_bytes())
    middle = len(content) // 2
    content[middle : middle + 3000] = bytes([255]) * 3000
    (spoilt.parent / ("." + spoilt.name + ".crc")).unlink()
    spoilt.write_bytes(content)
    listed = captures.list_captures(spark, f"{tmp_path}/*")
    assert all(c.problem is None for c in listed)
    found = {c.name: c for c in captures.examined(spark, listed)}
    assert found["sound"].problem is None and found["short"].problem is None
    assert found["spoilt"].problem.startswith("error: damaged, ") and "rows of 1 files" in found["spoilt"].problem
    counts = captures.read_captures(spark, list(found.values())).groupBy("source_db").count()
    assert rows(counts, "source_db", "count") == [("short", 10), ("sound", 4000)]
    assert captures.examined(spark, [found["spoilt"]]) == [found["spoilt"]]


def test_names_that_cannot_be_read_are_left_out(spark, folder):
    (folder / "trips.txt").unlink()
    (folder / "stops.txt").write_text("stop_id,zone\nA,z\n")
    names = static.read_names(spark, str(folder))
    assert names.trips is None and names.stops is None and set(names.problems) == {"trips", "stops"}
    assert rows(names.routes, "route_id", "route_short_name") == [("1", ""), ("2", "Two")]
    found = fixed.detect_fixed(updates(spark, [(t, n, "B", n) for t in "xy" for n in (1, 2, 3)]), names.trips)
    report = fixed.fixed_tables(found, names)
    assert set(report) == {"sample_log", "route_totals", "route_top_stops", "route_top_patterns"}
    assert {r.route_name for r in report["route_totals"].collect()} == {"ID-R"}
    assert {r.headsign for r in report["route_top_patterns"].collect()} == {"Unknown Destination"}

def test_no_capture_at_all(spark, tmp_path):
    assert captures.list_captures(spark, f"{tmp_path}/*.db") == []
    with pytest.raises(FileNotFoundError):
        captures.read_captures(spark, [])


def test_horizon_per_source_and_overall(spark):
    data = updates(spark, [("x", 1, "A", 0, {"snapshot": s, "source": "ab"[s > 30]}) for s in (0, 20, 40)])
    seconds = [F.unix_seconds(c).alias(c) for c in ("start_t", "end_t")]
    found = captures.capture_horizon(data).select("source_db", *seconds)
    base = 1_700_000_000
    assert rows(found, "source_db", "start_t", "end_t") == [
        ("a", base, base + 20), ("b", base + 40, base + 40), (None, base, base + 40),
    ]


@pytest.fixture
def event_frame(spark):
    base = ["2024-01-02", "1", "1", "1 - x", "0", "A", 'Main "St", 1', "n/a", "", "p", "q", *["t"] * 4, "08:00"]
    one = (*base, 90, 91.5, 1200.0, 300.0, 2, "a, b", "trip_pair", "", "Home")
    two = (*["2024-01-01", *base[1:6], "", *base[7:]], 60, 60.0, 480.0, 120.0, 1, "a", "default", "", "")
    return spark.createDataFrame([one, two], EVENTS)


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_events_survive_a_round_trip(spark, event_frame, scratch, format):
    events.write_events(event_frame, f"{scratch}/e", format)
    back = events.read_events(spark, f"{scratch}/e", format)
    assert back.columns == [*EVENTS.fieldNames(), *EVENT_MINUTES.fieldNames()]
    assert [f.dataType for f in back.schema] == [f.dataType for f in (*EVENTS, *EVENT_MINUTES)]
    assert rows(back, *EVENTS.fieldNames()) == rows(event_frame, *EVENTS.fieldNames())
    assert rows(back, "min_actual_headway_minutes", "bunch_threshold_minutes") == [(1.0, 2.0), (1.5, 5.0)]
    assert EVENT_ORDER[0] == "event_date"


AWKWARD = ["B\nC", "B\r\nC", "B\rC", " Main St ", "\tq\t", 'say "hi"', '"', '"\n"', "a,b", "\\", 'x\\"', "\n", "end\n", "é\u2028z", "\\n"]


def test_cells_come_back_as_they_were(spark, event_frame, scratch):
    """Line breaks, quotes and white space; files are read whole only if there are line breaks."""
    first = event_frame.where("stop_name = ''")
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f"{i:02d}").alias("trip")) for i, n in enumerate(AWKWARD)])
    each = first.withColumn("n", F.explode(names))
    named = each.withColumns({"stop_name": F.col("n.name"), "lead_trip_id": F.col("n.trip")}).select(*EVENTS.fieldNames()).repartition(3)
    for number, kept in enumerate((named, named.where(r"NOT stop_name RLIKE '[\\r\\n]'"))):
        events.write_events(kept, f"{scratch}/{number}")
        assert has_broken_lines(spark, f"{scratch}/{number}") == (number == 0)
        back = events.read_events(spark, f"{scratch}/{number}")
        assert rows(back, *EVENTS.fieldNames()) == rows(kept, *EVENTS.fieldNames())
    assert kept.count() == 9


def test_tables_come_back_as_they_were(spark, scratch):
    frame = spark.createDataFrame([(n, i) for i, n in enumerate(AWKWARD)], "place string, events int")
    events.write_tables({"stops": frame}, scratch)
    assert rows(read_delimited(spark, f"{scratch}/stops"), "place") == rows(frame, "place")


def test_published_cells_may_hold_line_breaks(spark, folder):
    (folder / "stops.txt").write_bytes('stop_id,stop_name,stop_lat,stop_lon\r\nA," Main ""St""\r\nNorth ",1,2\r\nB,Plain ,3,4\r\n'.encode())
    (folder / "routes.txt").write_text('route_id,route_short_name,route_long_name,route_desc\n1,"a\nb",x,\n2, c ,y,\n')
    read = static.read_static(spark, str(folder))
    assert rows(read.stops, "stop_id", "stop_name", "stop_lon") == [("A", ' Main "St"\nNorth ', "2"), ("B", "Plain ", "4")]
    assert rows(static.read_names(spark, str(folder)).routes, "route_id", "route_short_name") == [("1", "a\nb"), ("2", " c ")]


def test_event_files_without_chart_columns_are_refused(spark, event_frame, scratch):
    event_frame.drop("stop_lat", "event_hour").write.option("header", True).csv(f"{scratch}/e")
    with pytest.raises(ValueError, match="no column event_hour; no column stop_lat"):
        events.read_events(spark, f"{scratch}/e")
