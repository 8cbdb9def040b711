"""Resumable analyses over stage tables.

Everything lives under one base folder: ``segments`` (saved chunks), ``status``,
``analysis`` and ``elevation``. A run that dies leaves whole chunks behind and the
next one does the rest.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_climbs import schemas
from spark_climbs.functions.scoring import DEFAULT_MIN_SCORE
from spark_climbs.functions.text import analysis_key
from spark_climbs.materialize import materialize
from spark_climbs.operators.area import DEFAULT_CHUNK_KM, assign_chunks, chunk_grid
from spark_climbs.operators.elevation import KEY, distinct_coords, missing_elevations
from spark_climbs.operators.merge import merge_by_node_id
from spark_climbs.operators.roads import first_of_ways, segments_from_ways, surface_filter
from spark_climbs.plans.pipeline import climbs_from_segments, locate_and_report, long_nodes
from spark_climbs.sources.stages import (
    append_elevation_cache,
    read_stage,
    read_table,
    write_analysis,
    write_stage,
    write_status,
)

SEQ_PER_CHUNK = 1_000_000_000_000
DONE = ("ok", "empty")

SEGMENTS = T.StructType(
    [
        T.StructField("analysis_id", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("way_ids", T.ArrayType(T.LongType())),
        T.StructField("street_name", T.StringType()),
        T.StructField("surface", T.StringType()),
        T.StructField("tracktype", T.StringType()),
        T.StructField("tracktype_definition", T.StringType()),
        T.StructField("nodes", T.ArrayType(schemas.NODE)),
    ]
)


def remaining_chunks(chunks: DataFrame, status: DataFrame) -> DataFrame:
    """Chunks without a finished status."""
    done = status.filter(F.col("status").isin(*DONE)).select("analysis_id", "chunk_index")
    return chunks.join(done, ["analysis_id", "chunk_index"], "left_anti")


def saved_chunks(status: DataFrame) -> DataFrame:
    """Indices of finished chunks, in order."""
    done = status.filter(F.col("status").isin(*DONE))
    return done.select("analysis_id", "chunk_index").distinct().orderBy("analysis_id", "chunk_index")


def analysis_progress(analyses: DataFrame, status: DataFrame) -> DataFrame:
    """Finished and total chunks of every analysis, and their percentage (0 of 0 is 0)."""
    done = saved_chunks(status).groupBy("analysis_id").agg(F.count("*").alias("completed"))
    share = F.coalesce(F.try_divide(F.col("completed"), F.col("total")) * F.lit(100.0), F.lit(0.0))
    return (
        analyses.select("analysis_id", F.col("total_chunks").cast("long").alias("total"))
        .join(done, "analysis_id", "left")
        .withColumn("completed", F.coalesce("completed", F.lit(0)).cast("long"))
        .select("analysis_id", "completed", "total", share.alias("percentage"))
    )


def resumable_analyses(analyses: DataFrame, status: DataFrame, cached: DataFrame, base_id: str) -> DataFrame:
    """Analyses of ``base_id`` with chunks left, or with all chunks done and elevations
    cached. ``cached`` holds one ``analysis_id`` per cached coordinate. Ids are a base id (``analysis_key``,
    which no other address, filter or radius shares) and what follows the last underscore."""
    mine = analyses.filter(F.regexp_replace("analysis_id", "_[^_]*$", "") == F.lit(base_id))
    coords = cached.groupBy("analysis_id").agg(F.count("*").alias("elevation_coords"))
    unfinished = F.col("completed") < F.col("total")
    return (
        analysis_progress(mine, status)
        .join(coords, "analysis_id", "left")
        .withColumn("elevation_coords", F.coalesce("elevation_coords", F.lit(0)).cast("long"))
        .filter(unfinished | (F.col("elevation_coords") > 0))
        .select(
            "analysis_id",
            "completed",
            "total",
            F.when(unfinished, F.col("percentage")).otherwise(F.lit(100.0)).alias("percentage"),
            "elevation_coords",
            F.when(unfinished, "chunk_processing").otherwise("elevation_fetching").alias("phase"),
        )
    )


def find_resumable(analyses: DataFrame, status: DataFrame, cached: DataFrame, base_id: str) -> DataFrame:
    """The newest resumable analysis, or no row."""
    return resumable_analyses(analyses, status, cached, base_id).orderBy(F.desc("analysis_id")).limit(1)


def process_chunks(
    ways: DataFrame,
    chunks: DataFrame,
    base: str,
    analysis_id: str,
    surface: str = "all",
    size_km: float = DEFAULT_CHUNK_KM,
    cover: str = "square",
    resume: bool = True,
    n_batches: int = 10,
) -> DataFrame:
    """Save the in-chunk merged segments of every chunk that is not done yet, and
    return all saved segments of the analysis.

    ``chunks`` comes from ``chunk_grid`` with ``area_id`` = the analysis. Chunks are
    worked on in a few batches, each one distributed job over all its chunks, and
    the status is written after each: that is what a restart can build on.
    """
    spark = ways.sparkSession
    chunks = materialize(
        chunks.filter(F.col("area_id") == analysis_id).withColumn("analysis_id", F.col("area_id")), "chunks"
    )
    todo = chunks
    if resume:
        todo = remaining_chunks(chunks, read_table(spark, f"{base}/status", schemas.CHUNK_STATUS))
    todo = materialize(todo.withColumn("batch", F.pmod(F.xxhash64("chunk_index"), F.lit(n_batches)).cast("int")), "todo")
    if todo.isEmpty():
        return saved_segments(spark, base, analysis_id)
    chosen = first_of_ways(surface_filter(ways, surface)).select("way_id", "tags", "nodes")
    nodes = chosen.select("way_id", F.inline("nodes"))
    placed = assign_chunks(nodes, todo, size_km, cover).join(todo.select("chunk_index", "batch"), "chunk_index")
    # Split by batch once, so that the ways are not scanned again for every batch.
    placed_ways = materialize(chosen.join(placed.drop("area_id"), "way_id"), "placed-ways", partition_by="batch")

    for batch in sorted(row["batch"] for row in todo.select("batch").distinct().collect()):
        mine = todo.filter(F.col("batch") == batch)
        try:
            seq = F.col("chunk_index").cast("long") * SEQ_PER_CHUNK + F.col("way_id")
            in_batch = placed_ways.filter(F.col("batch") == batch)
            segments = materialize(segments_from_ways(in_batch, seq), "chunk-segments")
            chunk = F.floor(F.col("seq") / SEQ_PER_CHUNK).cast("int")
            merged = merge_by_node_id(segments, chunk).select(
                F.lit(analysis_id).alias("analysis_id"),
                F.floor(F.col("road_id") / SEQ_PER_CHUNK).cast("int").alias("chunk_index"),
                F.col("road_id").alias("seq"),
                *[c for c in SEGMENTS.names if c not in ("analysis_id", "chunk_index", "seq")],
            )
            merged = materialize(merged, "chunk-roads")
            write_stage(merged, f"{base}/segments")
        except Exception:
            _save_status(mine, base, F.lit("failed"), F.lit(0))
            raise
        saved = merged.groupBy("chunk_index").agg(F.count("*").alias("n"))
        counted = mine.join(saved, "chunk_index", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        _save_status(counted, base, F.when(F.col("n") > 0, "ok").otherwise("empty"), F.col("n"))
    return saved_segments(spark, base, analysis_id)


def saved_segments(spark: SparkSession, base: str, analysis_id: str) -> DataFrame:
    """Saved segments of the chunks whose last status says that they hold some. What an
    earlier run left in a chunk that is empty now, or failed since, is not read."""
    status = read_table(spark, f"{base}/status", schemas.CHUNK_STATUS).filter(F.col("analysis_id") == analysis_id)
    last = status.groupBy("chunk_index").agg(F.max_by("status", "ts").alias("status")).filter("status = 'ok'")
    return read_stage(spark, f"{base}/segments", SEGMENTS, analysis_id).join(last.select("chunk_index"), "chunk_index", "left_semi").select(*SEGMENTS.names)


def _save_status(chunks: DataFrame, base: str, status, n_segments) -> None:
    write_status(
        chunks.select(
            "analysis_id",
            "chunk_index",
            status.alias("status"),
            n_segments.cast("long").alias("n_segments"),
            F.current_timestamp().alias("ts"),
        ),
        f"{base}/status",
    )


def enrich_incremental(
    coords: DataFrame, source: DataFrame | Callable[[DataFrame], DataFrame], cache_path: str
) -> DataFrame:
    """Elevations of coordinates: take what is cached, look up only the rest, and add
    it to the cache. ``source`` is a table, or a function from coordinates to one
    (such as grid sampling). A coordinate that failed before is tried again."""
    spark = coords.sparkSession
    missing = missing_elevations(coords, read_table(spark, cache_path, schemas.ELEVATION))
    found = source(missing) if callable(source) else missing.join(source, KEY)
    append_elevation_cache(found.select(*KEY, "elevation"), cache_path)
    return read_table(spark, cache_path, schemas.ELEVATION).join(coords.select(*KEY).distinct(), KEY, "left_semi")


def finish_analysis(
    base: str,
    analysis_id: str,
    elevation_source: DataFrame | Callable[[DataFrame], DataFrame],
    places: DataFrame,
    center: tuple[float, float] | None,
    unit_system: str = "imperial",
    min_score: float = DEFAULT_MIN_SCORE,
) -> DataFrame:
    """Report of an analysis from its saved segments."""
    spark = places.sparkSession
    segments = saved_segments(spark, base, analysis_id).drop("analysis_id", "chunk_index")
    elevation = enrich_incremental(distinct_coords(long_nodes(segments)), elevation_source, f"{base}/elevation")
    return locate_and_report(climbs_from_segments(segments, elevation), places, center, unit_system, min_score)


def begin_analysis(
    spark: SparkSession,
    base: str,
    address: str,
    center: tuple[float, float],
    radius_km: float,
    surface: str = "all",
    unit_system: str = "imperial",
    size_km: float = DEFAULT_CHUNK_KM,
    country: str | None = None,
    formatted_address: str | None = None,
    started: int | None = None,
) -> str:
    """Write down what an analysis is about, for any later session to take it up by its id: the key of
    its address, filter and radius, and the second it began in."""
    key = _key(spark, address, surface, radius_km)
    analysis_id = f"{key}_{int(time.time()) if started is None else started:010d}"
    told = (analysis_id, address, country, *map(float, center), float(radius_km), surface, unit_system, float(size_km))
    columns = [f for f in schemas.ANALYSIS.fields if f.name not in ("total_chunks", "formatted_address")]
    row = spark.createDataFrame([told], T.StructType(columns))
    total = _chunks_of(row, size_km).agg(F.count("*").cast("int").alias("total_chunks"))
    write_analysis(row.join(total).withColumn("formatted_address", F.lit(formatted_address).cast("string")), f"{base}/analysis")
    return analysis_id


def _key(spark: SparkSession, address: str, surface: str, radius_km: float) -> str:
    of = analysis_key(F.lit(address), F.lit(surface), F.lit(float(radius_km)))
    return spark.range(1).select(of).first()[0]


def _chunks_of(analysis: DataFrame, size_km: float) -> DataFrame:
    area = analysis.select(F.col("analysis_id").alias("area_id"), "center_lat", "center_lon", "radius_km")
    return chunk_grid(area, size_km)


def resume_analysis(
    ways: DataFrame,
    elevation_source: DataFrame | Callable[[DataFrame], DataFrame],
    places: DataFrame,
    base: str,
    analysis_id: str,
    unit_system: str | None = None,
    min_score: float = DEFAULT_MIN_SCORE,
    cover: str = "square",
    n_batches: int = 10,
) -> DataFrame:
    """Take up an analysis where it ended, by what is stored of it: its place, radius, filter, chunks and
    units. Chunks that are done are not worked on again, nor are known elevations looked up. Gives the report."""
    spark = ways.sparkSession
    stored = read_table(spark, f"{base}/analysis", schemas.ANALYSIS).filter(F.col("analysis_id") == analysis_id)
    told = stored.first()
    if told is None:
        raise ValueError(f"no analysis {analysis_id} under {base}")
    chunks = _chunks_of(stored, told["chunk_size_km"])
    process_chunks(ways, chunks, base, analysis_id, told["surface_filter"], told["chunk_size_km"], cover, n_batches=n_batches)
    center = told["center_lat"], told["center_lon"]
    return finish_analysis(base, analysis_id, elevation_source, places, center, unit_system or told["unit_system"], min_score)


def analyze_resumably(
    ways: DataFrame,
    elevation_source: DataFrame | Callable[[DataFrame], DataFrame],
    places: DataFrame,
    base: str,
    address: str,
    center: tuple[float, float],
    radius_km: float,
    surface: str = "all",
    unit_system: str = "imperial",
    size_km: float = DEFAULT_CHUNK_KM,
    min_score: float = DEFAULT_MIN_SCORE,
    **options,
) -> DataFrame:
    """The report of an area, from the newest unfinished analysis of the same address, filter and radius if there
    is one, else from a new one."""
    spark = ways.sparkSession
    analyses = read_table(spark, f"{base}/analysis", schemas.ANALYSIS)
    status = read_table(spark, f"{base}/status", schemas.CHUNK_STATUS)
    cached = spark.createDataFrame([], "analysis_id string")  # elevations are cached for all analyses together
    found = find_resumable(analyses, status, cached, _key(spark, address, surface, radius_km)).first()
    analysis_id = begin_analysis(spark, base, address, center, radius_km, surface, unit_system, size_km) if found is None else found["analysis_id"]
    return resume_analysis(ways, elevation_source, places, base, analysis_id, unit_system, min_score, **options)
