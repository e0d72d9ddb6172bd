"""The closed vocabulary of conditions: predicates on moisture states, phrases in prose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Thresholds

UNMAPPED = "unmapped"
#: Codes in order of priority, the first match wins.
CODES = (
    "dry_spell_after_sowing",
    "delayed_onset",
    "unseasonal_rain",
    "terminal_drought",
    "mid_season_dry_spell",
)
#: Only for these does a probability of a dry spell decide.
PROBABILITY_DRIVEN = ("dry_spell_after_sowing", "mid_season_dry_spell")

#: Phrases of each code, tried in this order.
PHRASES: dict[str, tuple[str, ...]] = {
    "dry_spell_after_sowing": (
        "dry spell after sowing", "after sowing", "normal onset.{0,60}dry spell", "poor germination", "crop stand",
        "re ?sowing", "gap filling", "establishment failure", "seedling mortality",
    ),
    "delayed_onset": (
        "delayed onset", "delay(ed)? (in |of )?(the )?(monsoon|onset)", "late onset", r"delay by \d+ ?weeks?",
        "onset.{0,20}delay", "monsoon.{0,20}(late|delayed)",
    ),
    "unseasonal_rain": (
        "unseasonal rain", "unusual rain", "untimely rain", "excess(ive)? rain", "heavy rain", "continuous rain",
        "high rainfall", "flood", "water ?logging", "hail ?storm", "cyclone", "cyclonic",
    ),
    "terminal_drought": (
        "terminal drought", "early withdrawal", "late season drought", "withdrawal of (the )?monsoon", "at maturity",
        "grain fill",
    ),
    "mid_season_dry_spell": (
        "mid ?season", "long dry spell", "dry spell", "rainless period", r"consecutive \d+ ?weeks", "break in monsoon",
        "monsoon break", "prolonged dry",
    ),
}


def predicates(thr: Thresholds | None = None) -> dict[str, Column]:
    """One boolean column for each code, over the columns of a moisture state."""
    thr = thr or Thresholds()
    run, dry_soil = F.col("consecutive_dry_days"), F.col("soil_moisture_fraction") < thr.low_moisture
    late = F.dayofyear("as_of") >= thr.terminal_doy
    found = {
        "dry_spell_after_sowing": F.col("days_since_sowing").between(0, thr.sowing_window)
        & run.between(*thr.after_sowing_run)
        & dry_soil,
        "delayed_onset": F.col("onset_delay_days") > thr.onset_delay,
        "unseasonal_rain": (F.col("rain_3d_normal_mm") > 0)
        & (F.col("rain_3d_mm") > thr.unseasonal_ratio * F.col("rain_3d_normal_mm")),
        "terminal_drought": late & (run >= thr.min_run) & dry_soil,
        "mid_season_dry_spell": ~late & (run >= thr.min_run) & dry_soil,
    }
    return {code: F.coalesce(found[code], F.lit(False)) for code in CODES}


def detected(thr: Thresholds | None = None) -> Column:
    """The first code whose predicate holds; null where none does."""
    out = None
    for code, holds in predicates(thr).items():
        out = F.when(holds, F.lit(code)) if out is None else out.when(holds, F.lit(code))
    return out


def explained(thr: Thresholds | None = None) -> Column:
    """All predicates as a map."""
    return F.create_map(*[x for code, holds in predicates(thr).items() for x in (F.lit(code), holds)])


def canonical(text: Column) -> Column:
    """Lower case, dashes and white space as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[\x{2010}-\x{2015}\-]+", " "), r"\s+", " "))


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is worked out once for a row, however many branches ask for it."""
    return F.transform(F.array(value), of)[0]


def _any(phrases: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in phrases)


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def normalized(text: Column) -> Column:
    """The code that the prose of a condition stands for; 'unmapped' where no phrase is found."""

    def code_of(plain: Column) -> Column:
        return F.coalesce(*[F.when(plain.rlike(_any(phrases)), F.lit(code)) for code, phrases in PHRASES.items()], F.lit(UNMAPPED))

    return F.when(_blank(text), F.lit(UNMAPPED)).otherwise(_once(canonical(text), code_of))


def deciding_phrase(text: Column) -> Column:
    """The first phrase that is found, in order of priority; null where none is."""

    def phrase_of(plain: Column) -> Column:
        first = lambda phrases: F.coalesce(*[F.when(plain.rlike(p), F.lit(p)) for p in phrases])
        return F.coalesce(*[F.when(plain.rlike(_any(phrases)), first(phrases)) for phrases in PHRASES.values()])

    return F.when(~_blank(text), _once(canonical(text), phrase_of))
