"""Stage tables of resumable analyses: saved chunks, chunk status, elevation cache."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spark_climbs import schemas
from spark_climbs.operators.elevation import KEY

STAGE_KEY = ["analysis_id", "chunk_index"]


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table, or no rows when nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_stage(df: DataFrame, path: str) -> None:
    """Save chunks. Only the partitions of the given chunks are replaced, so saving a
    chunk twice is harmless. Rebalancing packs small chunks and splits large ones."""
    (
        df.hint("rebalance", *STAGE_KEY)
        .write.partitionBy(*STAGE_KEY)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def read_stage(spark: SparkSession, path: str, schema: StructType, analysis_id: str) -> DataFrame:
    """Saved chunks of one analysis; other analyses are pruned by partition."""
    return read_table(spark, path, schema).filter(F.col("analysis_id") == analysis_id)


def write_status(status: DataFrame, path: str) -> None:
    status.select(*schemas.CHUNK_STATUS.names).write.mode("append").parquet(path)


def write_analysis(analysis: DataFrame, path: str) -> None:
    (
        analysis.select(*schemas.ANALYSIS.names)
        .write.partitionBy("analysis_id")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def append_elevation_cache(found: DataFrame, path: str) -> None:
    """Add elevations of coordinates that the cache does not hold yet."""
    cache = read_table(found.sparkSession, path, schemas.ELEVATION)
    new = (
        found.filter(F.col("elevation").isNotNull())
        .groupBy(*KEY)
        .agg(F.min("elevation").alias("elevation"))
        .join(cache.select(*KEY), KEY, "left_anti")
    )
    new.write.mode("append").parquet(path)
