"""Bounds of valid rides."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Bounds:
    """Inclusive bounds; season None takes any season."""

    resort: tuple[int, int] = (1, 10)
    season: int | None = 2025
    skier: tuple[int, int] = (1, 100_000)
    lift: tuple[int, int] = (1, 40)
    time: tuple[int, int] = (1, 360)


DEFAULT = Bounds()
ANY_SEASON = Bounds(season=None)
BAD_IDS, BAD_BODY = "Invalid path parameters", "Invalid LiftRide data"
UNREADABLE = "Unreadable record"
