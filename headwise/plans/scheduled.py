"""Schedule-aware detection: from observations and a timetable to the event table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame

from headwise.config import ScheduledConfig
from headwise.operators.events import (
    co_locate_events,
    collapse_observations,
    dedupe_observations,
    event_table,
    localise,
    route_labels,
    stop_places,
    with_headsigns,
    with_labels,
)
from headwise.operators.pairs import (
    STOP_FACTS,
    candidate_pairs,
    drop_terminal_pairs,
    keep_bunched,
    pair_headway,
    resolve_headway,
    with_stop_facts,
)
from headwise.operators.timetable import (
    facts_by_trip,
    fallback_headways,
    parse_stop_times,
    scheduled_gaps,
    stop_facts,
    trip_dimension,
)
from headwise.operators.updates import distinct_updates, nonnull_updates, with_direction
from headwise.session import materialise, saved_lookup
from headwise.sources.static import Timetable

# The order of the event table when it is written.
EVENT_ORDER = [
    "event_date",
    "route_label",
    "direction_id",
    "first_predicted_arrival",
    "stop_id",
    "lead_trip_id",
    "trailing_trip_id",
]


@dataclass(frozen=True)
class TimetableIndex:
    """What detection looks up in a timetable, one row per key in every frame."""

    zone: str
    max_scheduled_headway_minutes: float
    trips: DataFrame
    facts: DataFrame
    fallbacks: DataFrame
    labels: DataFrame
    places: DataFrame

    def saved(self, folder: str) -> TimetableIndex:
        """Write the lookups once and use the files from then on.

        A timetable serves months of observations; written, its lookups are not derived
        again by every run, and Spark knows their sizes when it plans a join.
        """
        names = [f.name for f in fields(self) if f.name not in ("zone", "max_scheduled_headway_minutes")]
        return replace(
            self, **{name: saved_lookup(getattr(self, name), f"{folder.rstrip('/')}/{name}") for name in names}
        )


def index_timetable(
    timetable: Timetable, config: ScheduledConfig = ScheduledConfig(), folder: str | None = None
) -> TimetableIndex:
    """The lookups: as lazy frames, or written to `folder`, the stop times being read only once."""
    timed = parse_stop_times(timetable.stop_times)
    if folder:
        timed = materialise(timed, f"{folder.rstrip('/')}/stop_times")
    gaps = scheduled_gaps(timed, timetable.trips, config.max_scheduled_headway_seconds)
    index = TimetableIndex(
        zone=timetable.zone,
        max_scheduled_headway_minutes=config.max_scheduled_headway_minutes,
        trips=trip_dimension(timetable.trips),
        facts=facts_by_trip(stop_facts(timed)),
        fallbacks=fallback_headways(gaps),
        labels=route_labels(timetable.routes),
        places=stop_places(timetable.stops),
    )
    return index.saved(folder) if folder else index


def directed_updates(updates: DataFrame, trips: DataFrame) -> DataFrame:
    """Usable observations, each once per capture, with direction and headsign."""
    return distinct_updates(with_direction(_usable(updates), trips), ["direction_id", "trip_headsign"])


def _usable(updates: DataFrame) -> DataFrame:
    return nonnull_updates(updates, "arrival_time", "trip_id", "route_id", "stop_id")


Watch = Callable[[DataFrame], DataFrame]


def timed_pairs(
    updates: DataFrame, index: TimetableIndex, config: ScheduledConfig, watch: Watch | None = None
) -> DataFrame:
    """Candidate pairs that carry both vehicles' scheduled arrival and terminal flag."""
    directed = with_direction(_usable(updates), index.trips).drop("trip_headsign")
    known = distinct_updates(with_stop_facts(directed, index.facts), ["direction_id", *STOP_FACTS])
    pairs = candidate_pairs(known, config, STOP_FACTS)
    return watch(pairs) if watch else pairs


def resolved_pairs(
    updates: DataFrame, index: TimetableIndex, config: ScheduledConfig, watch: Watch | None = None
) -> DataFrame:
    """Candidate pairs away from terminals, with the headway they are held against."""
    if index.max_scheduled_headway_minutes != config.max_scheduled_headway_minutes:
        raise ValueError(
            f"the index keeps scheduled headways up to {index.max_scheduled_headway_minutes} minutes, "
            f"the configuration asks for {config.max_scheduled_headway_minutes}"
        )
    pairs = timed_pairs(updates, index, config, watch)
    if config.include_terminals:
        pairs = pairs.drop("lead_is_terminal", "trailing_is_terminal")
    else:
        pairs = drop_terminal_pairs(pairs)
    return resolve_headway(pair_headway(pairs, config), index.fallbacks, config)


def bunched_pairs(
    updates: DataFrame, index: TimetableIndex, config: ScheduledConfig, watch: Watch | None = None
) -> DataFrame:
    return keep_bunched(resolved_pairs(updates, index, config, watch), config)


def detect_scheduled(
    updates: DataFrame,
    timetable: Timetable | TimetableIndex,
    config: ScheduledConfig = ScheduledConfig(),
    watch: Watch | None = None,
) -> DataFrame:
    """The event table. Observations are shuffled twice, bunched pairs once.

    Headsigns, which are found by shuffling the events, are joined before the wide text of the labels.

    Give a saved `TimetableIndex` for anything large; one made with another
    `max_scheduled_headway_minutes` is refused. `watch` sees the candidate pairs as they
    pass (`captures.PairCounts`).
    """
    index = timetable if isinstance(timetable, TimetableIndex) else index_timetable(timetable, config)
    pairs = co_locate_events(localise(bunched_pairs(updates, index, config, watch), index.zone))
    events = collapse_observations(dedupe_observations(pairs), index.zone)
    return event_table(with_labels(with_headsigns(events, index.trips), index.labels, index.places))
