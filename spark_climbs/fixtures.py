"""A road network projected from the order tables.

The given tables hold no roads, so every order becomes a way, every line of it a
node, and prices become elevations. Chains of four orders form roads: consecutive
ways of a chain share an end point, and chains lie far enough apart not to meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spark_climbs.functions.geo import coord_key

HIGHWAYS = ("primary", "residential", "track", "path", "service", "trunk_link")
CITY_LEVELS = ("city", "town", "village", "hamlet", "county")
STATE_LEVELS = ("state", "province", "region")
N_CHUNKS = 8
SEQ_PER_CHUNK = 100_000_000_000
NEAR_COPY_OFFSET = 10_000_000

# Elevation scale of the report queries: keeps scores off whole numbers, where the
# last bit of a sine would decide how they are cut.
REPORT_SCALE = 1.00013


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(a: Column, b) -> Column:
    return F.floor(a / F.lit(b) if not isinstance(b, Column) else a / b).cast("long")


def chain_of(way_id: Column) -> Column:
    return _div(way_id, 4)


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long nodes: ``way_id, idx, n, lat_e6, lon_e6, lat, lon, price, tax``."""
    line = table(spark, sf_dir, "lineitem")
    # keyed by the column that goes on, or what groups and joins by it would shuffle again
    per_way = Window.partitionBy("way_id")
    in_order = per_way.orderBy("l_linenumber", "l_partkey", "supplier")
    n, idx = F.col("n"), F.col("idx")
    run = F.when(n == 1, F.lit(0)).otherwise(_div(idx * 4000, n - 1))
    wobble = F.when((idx == 0) | (idx == n - 1), F.lit(0)).otherwise(F.col("supplier") % 97)
    step, chain = F.col("way_id") % 4, chain_of(F.col("way_id"))
    return (
        line.select(
            F.col("l_orderkey").alias("way_id"),
            "l_linenumber",
            "l_partkey",
            F.col("l_suppkey").alias("supplier"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_tax").alias("tax"),
        )
        .withColumns({"idx": F.row_number().over(in_order) - 1, "n": F.count("*").over(per_way)})
        .withColumn("lat_e6", F.lit(35000000) + (chain % 150) * 20000 + step * 4000 + run + wobble)
        .withColumn("lon_e6", F.lit(-82000000) + _div(chain, 150) * 20000 + step * 4000 + run)
        .select(
            "way_id",
            "idx",
            "n",
            "lat_e6",
            "lon_e6",
            (F.col("lat_e6") / 1e6).alias("lat"),
            (F.col("lon_e6") / 1e6).alias("lon"),
            "price",
            "tax",
        )
    )


def long_way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long nodes of ways with long edges: a way of every customer, through the first node of each of the
    customer's orders."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer"))
    first = way_nodes(spark, sf_dir).filter("idx = 0").join(orders, F.col("way_id") == F.col("order"))
    along = Window.partitionBy("customer").orderBy("order")
    return first.select(F.col("customer").alias("way_id"), (F.row_number().over(along) - 1).alias("idx"), "lat", "lon")


def elevation(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    """One elevation per coordinate; about a tenth of the nodes has none."""
    return elevation_of(way_nodes(spark, sf_dir), scale)


def elevation_of(nodes: DataFrame, scale: float = 1.0) -> DataFrame:
    return (
        nodes.filter(F.col("tax") < 0.08)
        .groupBy("lat_e6", "lon_e6")
        .agg((F.min("price") / F.lit(100.0) * F.lit(scale)).alias("elevation"))
    )


def _tags(way_id: Column) -> Column:
    """Tags of a way from its chain and its order; absent tags are left out."""
    chain = chain_of(way_id)
    highway = F.element_at(F.array(*[F.lit(h) for h in HIGHWAYS]), (chain % 6 + 1).cast("int"))
    named = (chain % 11 != 0) & (chain % 13 != 0)
    grade = F.substring("o_orderpriority", 1, 1)
    tags = {
        "highway": highway,
        "name": F.when(named, F.concat(F.lit("Road "), chain % 40)),
        "ref": F.when(chain % 11 == 0, F.concat(F.lit("R"), chain % 7)),
        "surface": F.when(F.col("o_orderstatus") == "F", "asphalt").when(F.col("o_orderstatus") == "P", "fine_gravel"),
        "tracktype": F.when(
            highway == "track",
            F.when(grade == "1", "grade1").when(grade == "2", "Grade2 ").when(grade == "4", "gradeX").when(grade == "5", "grade5"),
        ),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in tags.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def with_tags(spark: SparkSession, sf_dir: str, ways: DataFrame) -> DataFrame:
    """Ways ``(way_id, ...)`` with the tags that follow from their ids and orders."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("way_id"), "o_orderstatus", "o_orderpriority"
    )
    return ways.join(orders, "way_id", "left").select(*ways.columns, _tags(F.col("way_id")).alias("tags"))


def plain_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``way_id, tags, nodes, chunk_index``: every way once."""
    node = F.struct(
        "idx", F.concat_ws("_", "way_id", "idx").alias("node_id"), "lat", "lon"
    )
    nodes = way_nodes(spark, sf_dir).groupBy("way_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    return with_tags(spark, sf_dir, nodes).select(
        "way_id",
        "tags",
        "nodes",
        (chain_of(F.col("way_id")) % N_CHUNKS).cast("int").alias("chunk_index"),
    )


def turned_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain ways, of which those whose id leaves one when divided by three run the other way."""
    turned = F.transform(
        F.reverse("nodes"), lambda p, k: F.struct(k.alias("idx"), p["node_id"].alias("node_id"), p["lat"].alias("lat"), p["lon"].alias("lon"))
    )
    same = F.transform("nodes", lambda p, k: F.struct(k.alias("idx"), p["node_id"].alias("node_id"), p["lat"].alias("lat"), p["lon"].alias("lon")))
    return plain_ways(spark, sf_dir).withColumn("nodes", F.when(F.col("way_id") % 3 == 1, turned).otherwise(same))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain ways, ways seen again from the next chunk, and shifted near copies."""
    plain = plain_ways(spark, sf_dir)
    again = plain.filter(F.col("way_id") % 10 == 0).withColumn(
        "chunk_index", ((F.col("chunk_index") + 1) % N_CHUNKS).cast("int")
    )
    near = plain.filter(F.col("way_id") % 37 == 0).withColumns(
        {
            "way_id": F.col("way_id") + NEAR_COPY_OFFSET,
            "nodes": F.transform(
                "nodes",
                lambda p: F.struct(
                    p["idx"].alias("idx"),
                    F.concat_ws("_", F.col("way_id") + NEAR_COPY_OFFSET, p["idx"]).alias("node_id"),
                    ((coord_key(p["lat"]) + 30) / 1e6).alias("lat"),
                    p["lon"].alias("lon"),
                ),
            ),
        }
    )
    return plain.unionByName(again).unionByName(near)


def seq() -> Column:
    """Total order of ways: chunk, then way id."""
    return F.col("chunk_index").cast("long") * SEQ_PER_CHUNK + F.col("way_id")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place per start cell; some cells have none."""
    return places_of(way_nodes(spark, sf_dir))


def places_of(nodes: DataFrame) -> DataFrame:
    starts = (
        nodes.filter(F.col("idx") == 0)
        .groupBy(coord_key(F.col("lat"), 3).alias("lat_e3"), coord_key(F.col("lon"), 3).alias("lon_e3"))
        .agg(F.min("way_id").alias("w"))
        .filter(F.col("w") % 7 != 0)
    )
    w = F.col("w")

    def level(keys) -> Column:
        return F.element_at(F.array(*[F.lit(k) for k in keys]), (w % len(keys) + 1).cast("int"))

    address = F.create_map(
        level(CITY_LEVELS), F.concat(F.lit("Town "), w % 50), level(STATE_LEVELS), F.concat(F.lit("State "), w % 10)
    )
    return starts.select(
        "lat_e3", "lon_e3", address.alias("address"), F.concat(F.lit("Place "), w).alias("full_address")
    )
