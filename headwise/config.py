"""Detection parameters, validated before any Spark job starts."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from math import isfinite


def _validate(config: object) -> None:
    """Raise one error that lists every number outside the range its field allows.

    A field's metadata says whether zero is allowed; no number may be negative or infinite.
    """
    wrong = []
    for entry in fields(config):
        value, zero = getattr(config, entry.name), entry.metadata.get("zero")
        if zero is not None and not (isfinite(value) and (value > 0 or (zero and value == 0))):
            wrong.append(f"{entry.name} is {value!r}, not {'zero or more' if zero else 'more than zero'}")
    if wrong:
        raise ValueError("; ".join(wrong))


@dataclass(frozen=True)
class FixedConfig:
    """One threshold for every route and stop."""

    headway_threshold_minutes: float = field(default=2, metadata={"zero": True})

    def __post_init__(self) -> None:
        _validate(self)

    @property
    def threshold_seconds(self) -> int:
        return int(self.headway_threshold_minutes * 60)


@dataclass(frozen=True)
class ScheduledConfig:
    """A threshold that follows the scheduled headway between two clip bounds."""

    threshold_ratio: float = field(default=0.25, metadata={"zero": False})
    min_bunch_minutes: float = field(default=2.0, metadata={"zero": True})
    max_bunch_minutes: float = field(default=10.0, metadata={"zero": False})
    fallback_headway_minutes: float = field(default=30.0, metadata={"zero": False})
    max_scheduled_headway_minutes: float = field(default=240.0, metadata={"zero": False})
    include_terminals: bool = False

    def __post_init__(self) -> None:
        _validate(self)
        if self.max_bunch_minutes < self.min_bunch_minutes:
            raise ValueError("the clip bounds are the wrong way round: min_bunch_minutes is above max_bunch_minutes")

    @property
    def min_bunch_seconds(self) -> float:
        return self.min_bunch_minutes * 60.0

    @property
    def max_bunch_seconds(self) -> float:
        return self.max_bunch_minutes * 60.0

    @property
    def candidate_cap_seconds(self) -> int:
        """Whole-second bound on a gap that could still pass the threshold."""
        return int(self.max_bunch_seconds)

    @property
    def fallback_headway_seconds(self) -> float:
        return self.fallback_headway_minutes * 60.0

    @property
    def max_scheduled_headway_seconds(self) -> float:
        return self.max_scheduled_headway_minutes * 60.0
