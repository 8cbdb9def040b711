"""Road attributes derived from a ``MAP<STRING,STRING>`` of tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that can name a street, in order of preference.
NAME_TAGS = ("name", "ref", "addr:street", "tiger:name_base", "unsigned_ref", "highway")

# Surface assumed for a highway class without a surface tag.
SURFACE_BY_HIGHWAY = {
    "asphalt": ("motorway", "trunk", "primary", "secondary", "tertiary", "residential"),
    "paved": ("unclassified", "service"),
    "unpaved": ("track", "path", "footway"),
}

# Meaning of the track grades.
TRACKTYPE_DEFINITIONS = {
    "grade1": "Solid: paved or heavily compacted hardcore surface",
    "grade2": "Mostly solid: unpaved track with through traffic, gravel/dirt with some soft areas",
    "grade3": "Even mixture of hard and soft materials, gravel/dirt with many soft areas",
    "grade4": "Mostly soft: soil/sand/grass with some hard material mixed in",
    "grade5": "Soft: soil/sand/grass, no hard material. Almost impossible for cars",
}

# Every character that Unicode counts as white space.
WHITE_SPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]
        + [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def first_filled(*values: Column) -> Column:
    """First value that is neither NULL nor ''."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def street_name(tags: Column) -> Column:
    """NULL without a naming tag; '' when the first filled one is blank."""
    return strip(first_filled(*[tags[t] for t in NAME_TAGS]))


def _untagged(tags: Column) -> Column:
    return tags.isNull() | (F.size(tags) == 0)


def surface(tags: Column) -> Column:
    highway = F.lower(strip(tags["highway"]))
    assumed = F.lit("unknown")
    for value, classes in SURFACE_BY_HIGHWAY.items():
        assumed = F.when(highway.isin(*classes), value).otherwise(assumed)
    return (
        F.when(_untagged(tags), "unknown")
        .when(tags["surface"].isNotNull(), F.lower(strip(tags["surface"])))
        .otherwise(assumed)
    )


def _is_track(tags: Column) -> Column:
    return F.coalesce(tags["highway"] == "track", F.lit(False))


def tracktype(tags: Column) -> Column:
    return (
        F.when(_untagged(tags), "unknown")
        .when(~_is_track(tags), "not_applicable")
        .otherwise(F.coalesce(F.lower(strip(tags["tracktype"])), F.lit("unspecified")))
    )


def tracktype_definition(tags: Column) -> Column:
    grade = F.lower(strip(tags["tracktype"]))
    graded = F.concat(F.lit("Unknown tracktype: "), grade)
    for value, meaning in TRACKTYPE_DEFINITIONS.items():
        graded = F.when(grade == value, meaning).otherwise(graded)
    return (
        F.when(_untagged(tags), "No tracktype information")
        .when(~_is_track(tags), "Not a track")
        .when(tags["tracktype"].isNull(), "Track with unspecified surface quality")
        .otherwise(graded)
    )
