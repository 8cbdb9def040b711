"""Lookup tables a user supplies as Parquet, and report output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_climbs import schemas


def read_elevation_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ELEVATION).parquet(path)


def read_elevation_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ELEVATION_GRID).parquet(path)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PLACES).parquet(path)


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GAZETTEER).parquet(path)


def read_region_bounds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REGION_BOUNDS).parquet(path)


def list_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """File inventory. The content column is pruned, so no bytes are read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
        .select("path", F.substring_index("path", "/", -1).alias("file_name"), "length")
    )


def write_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """Export a ranked report. The sort of the report range-partitions it, so the
    part files are in rank order and no task sees more than its own range."""
    if fmt == "csv":
        report.write.mode("overwrite").csv(path, header=True)
    elif fmt == "parquet":
        report.write.mode("overwrite").option("compression", "zstd").parquet(path)
    else:
        raise ValueError(f"unknown report format: {fmt}")
