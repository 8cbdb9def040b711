"""Climb scoring, unit conversion and rounding as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A category needs a score strictly above its floor.
CATEGORY_FLOORS = (("HC", 80000.0), ("1", 64000.0), ("2", 32000.0), ("3", 16000.0), ("4", 8000.0))

# Unit factors.
FEET_PER_METRE = 3.28084
MILES_PER_KM = 0.621371
KM_PER_MILE = 1.60934

DEFAULT_MIN_SCORE = 6000.0


def average_grade(height_m: Column, length_km: Column) -> Column:
    """Percent. The order of operations is part of the result: it decides ties
    at the category floors and in the truncated score."""
    metres = length_km * F.lit(1000.0)
    return F.when(length_km > 0, F.try_divide(height_m, metres) * F.lit(100.0)).otherwise(F.lit(0.0))


def climb_score(length_km: Column, avg_grade: Column) -> Column:
    return F.when(avg_grade > 0, length_km * F.lit(1000.0) * avg_grade).otherwise(F.lit(0.0))


def climb_category(score: Column) -> Column:
    label = F.lit("N/A")
    for name, floor in reversed(CATEGORY_FLOORS):
        label = F.when(score > floor, name).otherwise(label)
    return label


def osm_links(way_ids: Column) -> Column:
    return F.transform(way_ids, osm_link)


def osm_link(way_id: Column) -> Column:
    text = way_id.cast("string")
    return F.concat(F.lit("["), text, F.lit("](https://www.openstreetmap.org/way/"), text, F.lit(")"))


def is_imperial(unit_system: str | None) -> bool:
    return unit_system == "imperial"


def height_units(metres: Column, unit_system: str) -> Column:
    return metres * F.lit(FEET_PER_METRE) if is_imperial(unit_system) else metres


def length_units(km: Column, unit_system: str) -> Column:
    return km * F.lit(MILES_PER_KM) if is_imperial(unit_system) else km


def radius_to_km(radius: float, unit_system: str) -> float:
    return radius * KM_PER_MILE if is_imperial(unit_system) else radius
