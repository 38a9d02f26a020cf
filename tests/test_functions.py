import random
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from headwise.config import FixedConfig, ScheduledConfig
from headwise.functions import blank_to_null, clock, clock_seconds, label_or_id, local_text, to_number, zero_to_null


def values(spark, cells, kind, expression):
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, x {kind}")
    return [r[0] for r in frame.select("i", expression(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_clock_text(spark):
    cells = ["08:05:00", " 8:05:00", "25:10:00", "8:05", "a:b:c", "1:2:3:4", "08:05:0.5", "", None, "-1:00:00"]
    assert values(spark, cells, "string", clock_seconds) == [
        29100, 29100, 90600, None, None, None, None, None, None, -3600,
    ]


def test_lenient_numbers(spark):
    assert values(spark, ["7", " 7.5 ", "1e2", "n/a", "", "nan", None], "string", to_number) == [
        7.0, 7.5, 100.0, None, None, None, None,
    ]


def test_null_if(spark):
    assert values(spark, ["", " ", "a", None], "string", blank_to_null) == [None, " ", "a", None]
    assert values(spark, [0, 5, None], "bigint", zero_to_null) == [None, 5, None]


def test_label_or_id(spark):
    frame = spark.createDataFrame([("1", "A"), ("2", ""), ("3", None)], "id string, name string")
    assert [r[0] for r in frame.orderBy("id").select(label_or_id(F.col("name"), F.col("id"))).collect()] == [
        "A", "ID-2", "ID-3",
    ]


def test_local_text_in_the_repeated_autumn_hour(spark):
    # 2023-11-05: clocks go back from 02:00 PDT to 01:00 PST at 09:00 UTC.
    change = 1699174800
    assert values(spark, [change - 1800, change + 1800], "bigint", lambda c: local_text(c, "America/Los_Angeles")) == [
        "2023-11-05 01:30:00 PDT",
        "2023-11-05 01:30:00 PST",
    ]


@pytest.mark.parametrize(
    "wrong",
    [
        {"threshold_ratio": 0},
        {"min_bunch_minutes": -1},
        {"max_bunch_minutes": 0},
        {"min_bunch_minutes": 5, "max_bunch_minutes": 4},
    ],
)
def test_config_is_validated(wrong):
    with pytest.raises(ValueError):
        ScheduledConfig(**wrong)


def test_config_defaults():
    config = ScheduledConfig()
    assert (config.threshold_ratio, config.min_bunch_seconds, config.max_bunch_seconds) == (0.25, 120, 600)
    assert (config.fallback_headway_seconds, config.max_scheduled_headway_seconds) == (1800, 14400)
    assert FixedConfig().threshold_seconds == 120


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "America/Chihuahua", "Europe/Moscow", "Africa/Casablanca", "Australia/Lord_Howe", "Pacific/Apia", "UTC"])
def test_zone_names_are_those_of_the_instant(spark, zone):
    """Around every change of the zone, and at random instants in between."""
    changes = [start for start, _, _ in clock.transitions(zone) if start > 0 and start < 2_400_000_000]
    draw = random.Random(zone)
    instants = sorted({c + d for c in changes for d in (-1, 0, 1)} | {draw.randrange(2_400_000_000) for _ in range(300)})
    frame = spark.createDataFrame([(i,) for i in instants], "epoch long")
    found = {r.epoch: r.text for r in frame.select("epoch", clock.local_text(F.col("epoch"), zone).alias("text")).collect()}
    for instant in instants:
        moment = datetime.fromtimestamp(instant, timezone.utc).astimezone(ZoneInfo(zone))
        assert found[instant] == f"{moment:%Y-%m-%d %H:%M:%S} {moment.tzname()}"


def test_names_that_zones_no_longer_use(spark):
    rows = [("America/Chihuahua", 1_625_140_800, "2021-07-01 06:00:00 MDT"), ("Europe/Moscow", 1_246_449_600, "2009-07-01 16:00:00 MSD")]
    for zone, instant, text in rows:
        assert spark.range(1).select(clock.local_text(F.lit(instant), zone)).first()[0] == text
