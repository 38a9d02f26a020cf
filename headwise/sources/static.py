"""The published timetable, read as text."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwise.sources.delimited import read_delimited

# Columns read from each file: fixed values.
COLUMNS = {
    "agency": ["agency_timezone"],
    "routes": ["route_id", "route_short_name", "route_long_name", "route_desc"],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"],
    "trips": ["route_id", "service_id", "trip_id", "trip_headsign", "direction_id"],
    "stop_times": ["trip_id", "arrival_time", "stop_id", "stop_sequence"],
}

# Tables whose missing values become empty text.
FILLED = ("routes", "stops", "trips")

# Cell texts that mean "missing" when a CSV is loaded into pandas: fixed values.
MISSING = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


@dataclass(frozen=True)
class Timetable:
    """The static side of a schedule-aware run; every frame is lazy."""

    zone: str
    routes: DataFrame
    stops: DataFrame
    trips: DataFrame
    stop_times: DataFrame


# Types that may stand for a declared one, since Spark's readers widen them.
_NARROWER = {"bigint": {"int", "smallint", "tinyint"}, "double": {"float"}, "timestamp": {"timestamp_ntz"}}


def schema_problems(found: T.StructType, wanted: T.StructType | Iterable[str]) -> list[str]:
    """All that keeps a table with schema `found` from being read as `wanted`.

    `wanted` is a schema, or names alone where any type will do. No problems, empty list.
    """
    types = {f.name: f.dataType.simpleString() for f in found}
    declared = {f.name: f.dataType.simpleString() for f in wanted} if isinstance(wanted, T.StructType) else dict.fromkeys(wanted)
    problems = []
    for name, kind in declared.items():
        have = types.get(name)
        if have is None:
            problems.append(f"no column {name}")
        elif kind and have != kind and have not in _NARROWER.get(kind, ()):
            problems.append(f"{name} is {have}, not {kind}")
    return problems


def checked(frame: DataFrame, label: str, wanted: T.StructType | Iterable[str]) -> DataFrame:
    """The frame, unless it has problems; then one error with all of them."""
    if problems := schema_problems(frame.schema, wanted):
        raise ValueError(f"{label}: {'; '.join(problems)}")
    return frame


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One timetable file, wanted columns only, every cell text or NULL."""
    return _cells(_header(spark, folder, table), table, COLUMNS[table])


def _header(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return read_delimited(spark, f"{folder.rstrip('/')}/{table}.txt")


def _cells(raw: DataFrame, table: str, columns: list[str]) -> DataFrame:
    wanted = checked(raw, f"{table}.txt", columns)
    frame = wanted.select(*[F.when(~F.col(c).isin(MISSING), F.col(c)).alias(c) for c in columns])
    return frame.na.fill("") if table in FILLED else frame


def agency_timezone(agency: DataFrame) -> str:
    """The first zone named, checked against the zone database."""
    rows = agency.select("agency_timezone").dropna().limit(1).collect()
    if not rows:
        raise ValueError("agency.txt names no agency_timezone")
    zone = rows[0][0]
    try:
        ZoneInfo(zone)
    except Exception as error:
        raise ValueError(f"unknown time zone {zone!r}") from error
    return zone


def read_static(spark: SparkSession, folder: str) -> Timetable:
    return Timetable(
        zone=agency_timezone(read_table(spark, folder, "agency")),
        **{t: read_table(spark, folder, t) for t in ("routes", "stops", "trips", "stop_times")},
    )


# What the fixed-threshold report names things by: fixed values.
NAMES = {
    "routes": ["route_id", "route_short_name"],
    "stops": ["stop_id", "stop_name"],
    "trips": ["trip_id", "trip_headsign"],
}


@dataclass(frozen=True)
class Names:
    """Names for the fixed-threshold report, and why a table of them is not there."""

    routes: DataFrame | None = None
    stops: DataFrame | None = None
    trips: DataFrame | None = None
    problems: dict[str, str] = field(default_factory=dict)


def read_names(spark: SparkSession, folder: str) -> Names:
    """Whichever of the three tables can be read, two columns of each.

    A table that is missing, unreadable or without its columns is None and named in
    `problems`; the report then falls back to ids and default text.
    """
    frames, problems = {}, {}
    for table, columns in NAMES.items():
        try:
            frames[table] = _cells(_header(spark, folder, table), table, columns)
        except (AnalysisException, ValueError) as error:
            problems[table] = str(error).strip().splitlines()[0]
    return Names(**frames, problems=problems)
