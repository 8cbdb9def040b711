"""Elevation tile inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_climbs.functions import text


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value")).filter(F.col("value") != "")


def read_tile_manifest(spark: SparkSession, path: str) -> DataFrame:
    return tile_inventory(_lines(spark, path))


def read_bad_tiles(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.col("value").alias("tile"))


def tile_inventory(lines: DataFrame, base_url: str = text.NED_TILE_BASE_URL) -> DataFrame:
    """Tile name, download URL and local file of every non-blank manifest line."""
    line = F.trim("value")
    return lines.filter(line != "").select(
        text.tile_key(line).alias("tile"),
        text.tile_url(line, base_url).alias("url"),
        text.tile_file(line).alias("file_name"),
    )


def flag_bad_tiles(tiles: DataFrame, bad: DataFrame) -> DataFrame:
    """Mark tiles on the bad list and name the repacked file that replaces them."""
    flagged = bad.select("tile", F.lit(True).alias("is_bad")).distinct()
    return tiles.join(flagged, "tile", "left").select(
        *tiles.columns,
        F.coalesce("is_bad", F.lit(False)).alias("is_bad"),
        F.when(F.col("is_bad"), text.repacked_tile_name(F.col("tile"))).alias("repacked_name"),
    )
