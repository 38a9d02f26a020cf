"""Timetable clock text, epoch seconds and agency-local time, as column expressions."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_seconds(text: Column) -> Column:
    """`H:MM:SS` to seconds after midnight; hours may pass 24, anything else is NULL."""
    parts = F.split(text, ":")
    hours, mins, secs = (F.get(parts, i).try_cast("int").cast("bigint") for i in range(3))
    return F.when(F.size(parts) == 3, hours * 3600 + mins * 60 + secs)


def _utc(epoch: Column) -> Column:
    """Epoch seconds as a timestamp without a zone, so that no session setting has a say."""
    start = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return start + F.make_dt_interval(secs=epoch.cast("decimal(18,6)"))


def local_timestamp(epoch: Column, zone: str) -> Column:
    """Wall-clock timestamp in `zone`, without a zone of its own."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _utc(epoch))


def local_date(epoch: Column, zone: str) -> Column:
    """`YYYY-MM-DD` in `zone`."""
    return F.substring(local_timestamp(epoch, zone).cast("string"), 1, 10)


def local_hour(epoch: Column, zone: str) -> Column:
    """`HH:00` in `zone`."""
    return F.concat(F.substring(local_timestamp(epoch, zone).cast("string"), 12, 2), F.lit(":00"))


def utc_date(epoch: Column) -> Column:
    """The date of epoch seconds in UTC."""
    return F.date_from_unix_date(F.floor(epoch / 86_400).cast("int"))


def utc_hour(epoch: Column) -> Column:
    """`HH:00` of epoch seconds in UTC."""
    return F.concat(F.lpad(F.floor(F.pmod(epoch, F.lit(86_400)) / 3600).cast("string"), 2, "0"), F.lit(":00"))


#: The instants between which a zone's changes are looked for; beyond them its last or first rules hold.
_EARLIEST, _LATEST = (int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp()) for year in (1900, 2100))


@lru_cache(maxsize=None)
def transitions(zone: str) -> list[tuple[int, int, str]]:
    """(from which epoch second on, UTC offset in seconds, name) of every change of a zone, in order.

    Found by looking every ten days and halving the time between two unlike looks to the second.
    """
    info = ZoneInfo(zone)

    def state(epoch: int) -> tuple[int, str]:
        moment = datetime.fromtimestamp(epoch, timezone.utc).astimezone(info)
        return int(moment.utcoffset().total_seconds()), moment.tzname()

    found = [(_EARLIEST, *state(_EARLIEST))]
    for look in range(_EARLIEST, _LATEST, 10 * 86_400):
        now = state(look)
        while found[-1][1:] != now:  # more than one change since the look before
            low, high = max(found[-1][0], look - 10 * 86_400), look
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if state(middle) == found[-1][1:] else (low, middle)
            found.append((high, *state(high)))
    return found


@lru_cache(maxsize=None)
def _eras(zone: str) -> list[tuple[int, dict[int, str]]]:
    """(from which epoch second on, UTC offset to name): stretches of time in which an offset has one name."""
    eras: list[tuple[int, dict[int, str]]] = []
    for start, offset, name in transitions(zone):
        if not eras or eras[-1][1].get(offset, name) != name:
            eras.append((start, {}))
        eras[-1][1][offset] = name
    return eras


def local_text(epoch: Column, zone: str) -> Column:
    """`YYYY-MM-DD HH:MM:SS ABC`, ABC being the zone's name at that instant.

    The name follows from the era the instant is in and its UTC offset there.
    """
    local = local_timestamp(epoch, zone)
    eras = _eras(zone)

    def named(era: dict[int, str]) -> Column:
        name = F.lit("")
        for seconds, abbreviation in sorted(era.items()):
            name = F.when(local == _utc(epoch + seconds), F.lit(f" {abbreviation}")).otherwise(name)
        return name

    name = named(eras[0][1])
    for start, era in eras[1:]:
        name = F.when(epoch >= start, named(era)).otherwise(name)
    return F.concat(F.substring(local.cast("string"), 1, 19), name)


def hour_number(hour_text: Column) -> Column:
    """`HH:00` to the hour as an integer."""
    return F.substring(hour_text, 1, 2).cast("int")


def minutes(seconds: Column) -> Column:
    return seconds / F.lit(60.0)
