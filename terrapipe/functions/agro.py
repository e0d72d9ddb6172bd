"""Column functions of the weather plane."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import HARGREAVES, RA_MM, RAINY_DAY_MM, SPIN_UP_DAYS, Season


def nan_to_null(col: Column) -> Column:
    """NaN marks a missing value at the sources; inside, missing is null."""
    return F.when(~F.isnan(col), col)


def is_leap(date: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31))) == 366


def season_day(date: Column) -> Column:
    """Day of the year as in a common year."""
    return F.dayofyear(date) - (is_leap(date) & (F.month(date) > 2)).cast("int")


def in_season(date: Column, season: Season, spin_up: bool = False) -> Column:
    first = season.first() - (SPIN_UP_DAYS if spin_up else 0)
    return season_day(date).between(first, season.last())


def pentad(date: Column) -> Column:
    """Five-day period of the year from the raw day of the year."""
    return F.floor((F.dayofyear(date) - 1) / 5).cast("int")


def is_dry(rain: Column) -> Column:
    """Under the rainy-day threshold; a missing day is not dry."""
    return F.coalesce(rain < RAINY_DAY_MM, F.lit(False))


def season_phase(date: Column, season: Season) -> Column:
    """Angle of the day within the season of its own year."""
    start = F.make_date(F.year(date), F.lit(season.start[0]), F.lit(season.start[1]))
    return F.lit(2 * math.pi) * F.datediff(date, start) / F.lit(float(season.days()))


def radiation(latitude: Column, doy: Column) -> Column:
    """Radiation above the atmosphere in mm of evaporation a day."""
    phi = F.radians(latitude)
    angle = F.lit(2 * math.pi) * doy / F.lit(365.0)
    near = 1.0 + 0.033 * F.cos(angle)
    tilt = 0.409 * F.sin(angle - 1.39)
    sunset = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -F.tan(phi) * F.tan(tilt))))
    return RA_MM * near * (sunset * F.sin(phi) * F.sin(tilt) + F.cos(phi) * F.cos(tilt) * F.sin(sunset))


def et0(tmin: Column, tmax: Column, latitude: Column, doy: Column) -> Column:
    """Reference evapotranspiration from temperatures, not below 0; missing stays missing."""
    mean = (tmin + tmax) / 2.0
    spread = F.when((tmax - tmin).isNotNull(), F.sqrt(F.greatest(F.lit(0.0), tmax - tmin)))
    value = HARGREAVES * radiation(latitude, doy) * (mean + 17.8) * spread
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), value))


def clipped(p: Column, margin: float) -> Column:
    return F.when(p.isNotNull(), F.least(F.lit(1 - margin), F.greatest(F.lit(margin), p)))
