"""Names derived from text: analyses, exports, elevation tiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NED_TILE_BASE_URL = "https://prd-tnm.s3.amazonaws.com/StagedProducts/Elevation/13/TIFF/current"


def analysis_base_id(address: Column, surface_filter: Column, radius_km: Column) -> Column:
    """``address_filter_radiuskm`` reduced to letters, digits, '_' and '-', 40 long. For
    display: long addresses cut off filter and radius, see ``analysis_key``."""
    radius = F.replace(radius_km.cast("string"), F.lit("."), F.lit(""))
    raw = F.concat(address, F.lit("_"), surface_filter, F.lit("_"), radius, F.lit("km"))
    return F.substring(F.regexp_replace(raw, r"[^\p{L}\p{N}_-]", ""), 1, 40)


def analysis_key(address: Column, surface_filter: Column, radius_km: Column) -> Column:
    """The base id with a hash of the whole address, filter and radius: different
    analyses never share it."""
    whole = F.md5(F.concat_ws("\n", address, surface_filter, radius_km.cast("string")))
    return F.concat(analysis_base_id(address, surface_filter, radius_km), F.lit("_"), F.substring(whole, 1, 16))


def export_name(area: Column, surface_filter: Column, scope: Column, radius_km: Column) -> Column:
    """File name (no extension) of an exported report. Places named by the user
    (state, country) only have spaces replaced; addresses are also cleaned and
    cut at 50 characters."""
    cleaned = F.rtrim(F.regexp_replace(area, r"[^\p{L}\p{N} _-]", ""))
    safe = F.when(scope == "address", F.substring(F.replace(cleaned, F.lit(" "), F.lit("_")), 1, 50)).otherwise(
        F.replace(area, F.lit(" "), F.lit("_"))
    )
    radius = F.rint(radius_km).cast("long").cast("string")
    return F.concat(
        F.lit("climbs_"), safe, F.lit("_"), surface_filter, F.lit("_"), scope, F.lit("_"), radius, F.lit("km")
    )


def shifted_tile_name(file_name: Column) -> Column:
    """Move a tile's northing from its upper to its lower edge and mark it renamed.
    NULL when the name holds no northing."""
    northing = F.regexp_extract(file_name, r"([ns]\d\d)", 1)
    degrees = F.try_to_number(F.substring(northing, 2, 2), F.lit("99")).cast("int")
    moved = (
        F.when(northing == "n00", F.lit("s01"))
        .when(northing.startswith("n"), F.concat(F.lit("n"), F.lpad((degrees - 1).cast("string"), 2, "0")))
        .otherwise(F.concat(F.lit("s"), F.format_string("%02d", degrees + 1)))
    )
    renamed = F.replace(file_name, northing, moved)
    stem = F.substring_index(renamed, ".", 1)
    rest = F.substr(renamed, F.length(stem) + 1)
    return F.when(northing != "", F.concat(stem, F.lit("_renamed"), rest))


def tile_key(line: Column) -> Column:
    return F.replace(F.trim(line), F.lit(".tif"), F.lit(""))


def tile_file(line: Column) -> Column:
    return F.concat(F.lit("USGS_13_"), tile_key(line), F.lit(".tif"))


def tile_url(line: Column, base_url: str = NED_TILE_BASE_URL) -> Column:
    return F.concat_ws("/", F.lit(base_url), tile_key(line), tile_file(line))


def url_file_name(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def converted_file_name(file_name: Column) -> Column:
    """Name of a file after conversion to GeoTIFF."""
    return F.when(
        file_name.contains("."),
        F.regexp_replace(file_name, r"(\.hgt\.zip|\.hgt|\.zip|\.[^.]*)$", ".tif"),
    ).otherwise(F.concat(file_name, F.lit(".tif")))


def repacked_tile_name(tile: Column) -> Column:
    return F.concat(tile, F.lit(".SRTMGL1.repacked.hgt.zip"))
