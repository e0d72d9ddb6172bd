"""Constants and parameter records of the weather and decision planes."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
RAINY_DAY_MM = 2.5
MIN_SPELL_DAYS = 5
PHYSICAL_MAX_RAIN_MM = 1000.0
SPIN_UP_DAYS = 30
LEADS = (7, 14, 21, 30)
TEMPERATURE_GAP = 3
AWC_MM = 150.0
RUNOFF_FRACTION = 0.15
HARGREAVES = 0.0023
RA_MM = 15.34
CROP_COEFFICIENT = 1.0
INITIAL_FILL = 0.5
FALLBACK_LATITUDE = 29.5
PROBABILITY_CLIP = 1e-4
PHASE_BINS = 12
MIN_BIN_ROWS = 10
PERSISTENCE_RUN = 3
HYSTERESIS_CYCLES = 2
SEED_SAFETY = 1.2
AUTO_ELIGIBLE = 0.85


@dataclass(frozen=True)
class Season:
    """A season inside one calendar year, both ends included."""

    start: tuple[int, int] = (6, 1)
    end: tuple[int, int] = (9, 30)

    def __post_init__(self) -> None:
        if self.start > self.end:
            raise ValueError("a season that wraps over the year's end matches no day")

    def days(self) -> int:
        return self.last() - self.first() + 1

    def first(self) -> int:
        """Day of a common year."""
        return _day(*self.start)

    def last(self) -> int:
        return _day(*self.end)


def _day(month: int, day: int) -> int:
    return sum((31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[: month - 1]) + day


JJAS = Season()
OND = Season((10, 1), (12, 31))


@dataclass(frozen=True)
class Thresholds:
    """Bounds of the condition predicates."""

    onset_delay: int = 21
    sowing_window: int = 30
    after_sowing_run: tuple[int, int] = (15, 20)
    terminal_doy: int = 250
    low_moisture: float = 0.35
    unseasonal_ratio: float = 3.0
    min_run: int = 5
