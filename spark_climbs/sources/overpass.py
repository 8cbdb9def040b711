"""Road elements from Overpass-style JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_climbs.materialize import materialize
from spark_climbs.schemas import OVERPASS_DOCUMENT, OVERPASS_ELEMENT


def read_overpass_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per element of every document under ``path``. One file is one
    answer for one chunk of the area, so a file is the unit of parallelism."""
    documents = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc"), F.col("value")
    )
    return parse_overpass(documents)


def parse_overpass(documents: DataFrame) -> DataFrame:
    """``(doc, value)`` texts to elements ``(doc, pos, type, id, ...)``. Text before
    the first '{' is skipped; a document that is not JSON yields no rows."""
    start = F.instr("value", "{")
    parsed = F.from_json(F.substr(F.col("value"), start), OVERPASS_DOCUMENT)
    return (
        documents.filter(start > 0)
        .select("doc", F.posexplode(parsed["elements"]).alias("pos", "element"))
        .select("doc", "pos", "element.*")
    )


def _geometry_nodes() -> Column:
    """Indexed geometry points; an unusable point is dropped but keeps its number."""
    indexed = F.transform(
        "geometry",
        lambda p, i: F.struct(
            i.cast("int").alias("idx"),
            F.concat_ws("_", F.col("id"), i).alias("node_id"),
            p["lat"].alias("lat"),
            p["lon"].alias("lon"),
        ),
    )
    return F.filter(indexed, lambda n: n["lat"].isNotNull() & n["lon"].isNotNull())


def ways_from_elements(elements: DataFrame) -> DataFrame:
    """Ways ``(doc, pos, way_id, tags, nodes)`` with more than one usable node.

    Geometry is preferred and needs no shuffle. Only ways that merely reference
    node ids are joined with the node elements of their own document; references
    without a node element are dropped and the order is kept. Geometry, references
    and nodes each read the elements, so they are written once: documents are
    parsed once."""
    used = ["doc", "pos", *OVERPASS_ELEMENT.names]
    elements = materialize(elements.filter(F.col("type").isin("way", "node")).select(*used), "elements")
    ways = elements.filter(F.col("type") == "way")
    with_geometry = ways.filter(F.col("geometry").isNotNull()).select(
        "doc", "pos", F.col("id").alias("way_id"), "tags", _geometry_nodes().alias("nodes")
    )

    references = ways.filter(F.col("geometry").isNull() & F.col("nodes").isNotNull()).select(
        "doc", "pos", F.col("id").alias("way_id"), "tags", F.posexplode("nodes").alias("ref_pos", "ref")
    )
    # The last definition of a node id in a document wins.
    nodes = (
        elements.filter(F.col("type") == "node")
        .groupBy("doc", F.col("id").alias("ref"))
        .agg(F.max_by(F.struct("lat", "lon"), "pos").alias("point"))
    )
    by_reference = (
        references.join(nodes, ["doc", "ref"])
        .groupBy("doc", "pos", "way_id")
        .agg(
            F.first("tags").alias("tags"),
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col("ref_pos").alias("idx"),
                        F.col("ref").cast("string").alias("node_id"),
                        F.coalesce("point.lat", F.lit(0.0)).alias("lat"),
                        F.coalesce("point.lon", F.lit(0.0)).alias("lon"),
                    )
                )
            ).alias("nodes"),
        )
    )
    empty_tags = F.from_json(F.lit("{}"), "map<string,string>")
    return (
        with_geometry.unionByName(by_reference)
        .filter(F.size("nodes") > 1)
        .withColumn("tags", F.coalesce("tags", empty_tags))
    )


def explode_nodes(ways: DataFrame) -> DataFrame:
    """Long form of the nodes: ``way_id, idx, node_id, lat, lon``."""
    return ways.select("way_id", F.inline("nodes"))


def way_start(ways: DataFrame) -> DataFrame:
    """Start coordinate of every way."""
    first = F.get("nodes", F.lit(0))
    return ways.select("way_id", first["lat"].alias("start_lat"), first["lon"].alias("start_lon"))
