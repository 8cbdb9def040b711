"""Places: location of climbs, addresses, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_climbs.functions.geo import coord_key, haversine_km
from spark_climbs.functions.tags import first_filled, strip

# Address keys in order of preference.
CITY_KEYS = ("city", "town", "village", "hamlet", "county")
STATE_KEYS = ("state", "province", "region")

# Centre and radius of a region that is not listed.
DEFAULT_BOUNDS = {"state": (39.0, -98.0, 400.0), "country": (0.0, 0.0, 1000.0)}

_UNKNOWN = "Unknown"


def city(address: Column) -> Column:
    return F.coalesce(first_filled(*[address[k] for k in CITY_KEYS]), F.lit(_UNKNOWN))


def state(address: Column) -> Column:
    return F.coalesce(first_filled(*[address[k] for k in STATE_KEYS]), F.lit(_UNKNOWN))


def attach_location(climbs: DataFrame, places: DataFrame, center: tuple[float, float] | DataFrame | None) -> DataFrame:
    """Add ``city``, ``state`` and ``center_km`` by the 3-decimal cell of the start. The centre is one place, or
    that of every climb's area in ``(area_id, center_lat, center_lon)``.

    Climbs of one cell share the start of the last of them in rank order. That is an
    aggregate joined back, not a window, so a crowded cell is combined map-side. A
    ``places`` row may carry ``error`` for a lookup that failed."""
    if center is None:
        return climbs.withColumns(
            {"city": F.lit("N/A"), "state": F.lit("N/A"), "center_km": F.lit(0.0)}
        )
    cell = ["lat_e3", "lon_e3"]
    located = climbs.withColumns(
        {"lat_e3": coord_key(F.col("start_lat"), 3), "lon_e3": coord_key(F.col("start_lon"), 3)}
    )
    per, at = cell, center
    if isinstance(center, DataFrame):
        per, at = ["area_id", *cell], (F.col("center_lat"), F.col("center_lon"))
        located = located.join(center.select("area_id", "center_lat", "center_lon"), "area_id")
    shared = located.groupBy(*per).agg(
        F.max_by(
            F.struct(F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon")),
            F.struct(-F.col("climb_score"), F.col("road_id")),
        ).alias("shared")
    )
    failed = F.col("error").isNotNull() if "error" in places.columns else F.lit(False)

    def or_failed(value: Column) -> Column:
        return F.when(failed, "Lookup Failed").otherwise(value)

    named = places.select(
        *cell, or_failed(city(F.col("address"))).alias("city"), or_failed(state(F.col("address"))).alias("state")
    )
    no_start = F.col("start_lat").isNull() | F.col("start_lon").isNull()
    distance = haversine_km(*at, F.col("shared.lat"), F.col("shared.lon"))
    return (
        located.join(shared, per, "left")
        .join(named, cell, "left")
        .withColumns(
            {
                "city": F.coalesce("city", F.lit(_UNKNOWN)),
                "state": F.coalesce("state", F.lit(_UNKNOWN)),
                "center_km": F.when(no_start, 0.0).otherwise(distance),
            }
        )
        .drop(*cell, "shared", "center_lat", "center_lon")
    )


def _squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def geocode_candidates(addresses: DataFrame) -> DataFrame:
    """Ranked lookup strings of ``(address_id, address, country)``: the whole address;
    the street without its house number; what follows the first comma."""
    address = F.col("address")
    street = _squeeze(F.substring_index(address, ",", 1))
    has_parts = address.contains(",")
    rest = F.substr(address, F.instr(address, ",") + 1)
    numbered = street.rlike(r"^\p{Nd}+ ")
    unnumbered = F.concat(F.regexp_replace(street, r"^\p{Nd}+ ", ""), F.lit(","), rest)
    with_country = F.coalesce(F.concat(F.lit(", "), F.nullif("country", F.lit(""))), F.lit(""))

    def tidy(text: Column) -> Column:
        return _squeeze(F.regexp_replace(F.concat(text, with_country), r"\s*,\s*", ", "))

    tries = F.array(
        F.struct(F.lit(0).alias("rank"), tidy(address).alias("query")),
        F.struct(F.lit(1).alias("rank"), F.when(has_parts & numbered, tidy(unnumbered)).alias("query")),
        F.struct(F.lit(2).alias("rank"), F.when(has_parts, tidy(rest)).alias("query")),
    )
    return addresses.select("address_id", F.inline(tries)).filter(F.col("query").isNotNull())


def geocode(addresses: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Coordinates of addresses by their best-ranked lookup string; NULL without a hit."""
    known = gazetteer.groupBy(_squeeze(F.regexp_replace("query", r"\s*,\s*", ", ")).alias("query")).agg(
        F.min(F.struct("lat", "lon", "address")).alias("hit")
    )
    best = (
        geocode_candidates(addresses)
        .join(known, "query")
        .groupBy("address_id")
        .agg(F.min(F.struct("rank", "hit")).alias("best"))
    )
    hit = F.col("best.hit")
    return addresses.select("address_id").join(best, "address_id", "left").select(
        "address_id",
        hit["lat"].alias("lat"),
        hit["lon"].alias("lon"),
        hit["address"].alias("formatted_address"),
        F.col("best.rank").alias("matched_by"),
    )


def _parts(text: Column, lengths: list[int]) -> Column:
    """Every distinct substring of one of the lengths, the empty one included."""
    length = F.length(text)

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(length - n + 1, F.lit(1)))
        return F.when(length >= n, F.transform(starts, lambda s: F.substr(text, s, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.array(F.lit("")), *[of(n) for n in lengths if n > 0]))


def resolve_region(names: DataFrame, bounds: DataFrame, kind: str) -> DataFrame:
    """Centre and radius of each distinct ``name``.

    An exact match wins; else the first listed region where either name contains the
    other; else the default of the kind. Containment is an equi-join on substrings
    of the (short) names, so no name is compared with every region."""
    listed = bounds.filter(F.col("kind") == kind).select(
        F.col("name").alias("listed_name"), "ord", F.struct("lat", "lon", "radius_km").alias("area")
    )
    wanted = names.select("name").distinct().withColumn("key", F.lower(strip(F.col("name"))))
    keys = wanted.select("key").distinct()
    # a few dozen lengths of names; only such parts can be a listed name, or hold a key
    lengths = [r[0] for r in listed.select(F.length("listed_name")).distinct().collect() if r[0] is not None]
    every = list(range(1, max(lengths, default=0) + 1))
    around = listed.select("listed_name", "ord", "area", F.explode(_parts(F.col("listed_name"), every)).alias("key"))
    inside = keys.select("key", F.explode(_parts(F.col("key"), lengths)).alias("listed_name")).join(listed, "listed_name")
    matches = keys.join(around, "key").unionByName(inside)
    best = matches.groupBy("key").agg(
        F.min_by(
            F.struct("listed_name", "area"), F.struct(F.col("listed_name") != F.col("key"), F.col("ord"))
        ).alias("best")
    )
    lat, lon, radius = DEFAULT_BOUNDS[kind]
    area = F.col("best.area")
    matched_by = (
        F.when(F.col("best").isNull(), "default").when(F.col("best.listed_name") == F.col("key"), "exact").otherwise("partial")
    )
    return wanted.join(best, "key", "left").select(
        "name",
        F.col("best.listed_name").alias("matched_name"),
        matched_by.alias("matched_by"),
        F.coalesce(area["lat"], F.lit(lat)).alias("lat"),
        F.coalesce(area["lon"], F.lit(lon)).alias("lon"),
        F.coalesce(area["radius_km"], F.lit(radius)).alias("radius_km"),
    )


def region_areas(regions: DataFrame) -> DataFrame:
    """Areas to analyse from ``resolve_region`` rows, by their names."""
    return regions.select(F.col("name").alias("area_id"), F.col("lat").alias("center_lat"), F.col("lon").alias("center_lon"), "radius_km")


def address_areas(found: DataFrame, radius_km: float | Column) -> DataFrame:
    """Areas of a radius around ``geocode`` rows, by their ids; addresses without a hit have none."""
    radius = radius_km if isinstance(radius_km, Column) else F.lit(float(radius_km))
    areas = found.select(F.col("address_id").alias("area_id"), F.col("lat").alias("center_lat"), F.col("lon").alias("center_lon"), radius.alias("radius_km"))
    return areas.filter("center_lat is not null and center_lon is not null")


# Fixed value: country names shown; states are listed in full.
SHOWN_COUNTRIES = 20


def suggest_regions(bounds: DataFrame, kind: str, n: int | None = None) -> DataFrame:
    """Listed names of a kind, alphabetically: all states, the first countries, or ``n``."""
    if n is None and kind == "country":
        n = SHOWN_COUNTRIES
    names = bounds.filter(F.col("kind") == kind).select("name").orderBy("name")
    return names if n is None else names.limit(n)
