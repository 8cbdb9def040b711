"""The ranked report, run counts and the connectivity check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spark_climbs.functions.geo import haversine_km, valid_coord
from spark_climbs.functions.scoring import height_units, is_imperial, length_units, osm_link


def report(climbs: DataFrame, unit_system: str = "imperial") -> DataFrame:
    """The 17 report columns of located climbs, best first. Whole numbers are cut, not
    rounded; anything but ``imperial`` is metric. Climbs of several areas are listed by area,
    with ``area_id`` before the columns."""
    up, along = ("ft", "mi") if is_imperial(unit_system) else ("m", "km")

    def whole(value: Column) -> Column:
        return value.cast("long")

    def metres(name: str) -> Column:
        return whole(height_units(F.col(name), unit_system))

    def km(name: str, digits: int) -> Column:
        return F.round(length_units(F.col(name), unit_system), digits)

    area = [c for c in ("area_id",) if c in climbs.columns]
    ranked = climbs.orderBy(*area, F.desc("climb_score"), "road_id")
    return ranked.select(
        *area,
        F.col("street_name").alias("Street Name"),
        F.col("city").alias("City"),
        F.col("state").alias("State"),
        km("center_km", 1).alias(f"From Center ({along})"),
        F.col("climb_category").alias("Category"),
        whole(F.col("climb_score")).alias("Score"),
        metres("elevation_gain").alias(f"Elev Gain ({up})"),
        metres("height").alias(f"Height ({up})"),
        metres("prominence").alias(f"Prominence ({up})"),
        km("length_km", 2).alias(f"Length ({along})"),
        km("distance_km", 2).alias(f"Distance ({along})"),
        F.round("avg_grade", 2).alias("Avg Grade (%)"),
        F.round("max_grade", 2).alias("Max Grade (%)"),
        F.col("surface").alias("Surface"),
        F.col("tracktype").alias("Tracktype"),
        F.coalesce(F.col("first_way_id").cast("string"), F.lit("N/A")).alias("Way ID"),
        F.coalesce(osm_link(F.col("first_way_id")), F.lit("N/A")).alias("OSM Link"),
    )


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """Run counts taken while ``df`` passes through an action, without a second pass."""
    observation = Observation(name)
    return df.observe(observation, *[c.alias(k) for k, c in counts.items()]), observation


def run_metrics(nodes: DataFrame, roads: DataFrame, climbs: DataFrame) -> DataFrame:
    """One row of counts: coordinates (all, distinct, with elevation), pieces, roads
    and climbs. ``nodes`` carries coordinate keys and elevation."""
    per_coord = nodes.groupBy("lat_e6", "lon_e6").agg(
        F.count("*").alias("n"), F.max(F.col("elevation").isNotNull().cast("int")).alias("hit")
    )
    coords = per_coord.agg(
        F.sum("n").alias("n_coordinates"), F.count("*").alias("n_unique"), F.sum("hit").cast("long").alias("n_elevations")
    )
    merged = roads.agg(F.sum("n_pieces").alias("n_segments"), F.count("*").alias("n_roads"))
    found = climbs.agg(F.count("*").alias("n_climbs"))
    rows = coords.unionByName(merged, allowMissingColumns=True).unionByName(found, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


# Upper limits in metres.
_STATUS = (("CONNECTABLE", 100.0), ("TOO FAR", 1000.0))
_VERDICT = (("SHOULD MERGE", 10.0), ("MIGHT MERGE", 100.0), ("GAP TOO LARGE", 1000.0))


def _graded(metres: Column, limits, beyond: str) -> Column:
    label = F.lit(beyond)
    for name, limit in reversed(limits):
        label = F.when(metres < limit, name).otherwise(label)
    return label


def connectivity_report(pairs: DataFrame, unrolled: bool = False) -> DataFrame:
    """Distances between the ends of two segments, nearest first, with a verdict on
    the nearest. ``pairs`` holds ``pair_id`` and ``a_*`` / ``b_*`` end columns; a pair
    with a segment without nodes gets one ERROR row. ``unrolled``: longitudes past 180 are valid."""

    def end(side: str, which: str) -> Column:
        return valid_coord(F.col(f"{side}_{which}_lat"), F.col(f"{side}_{which}_lon"), unrolled)

    no_nodes = F.col("a_start_lat").isNull() | F.col("b_start_lat").isNull()
    links = []
    for a in ("start", "end"):
        for b in ("start", "end"):
            p, q = end("a", a), end("b", b)
            metres = haversine_km(p["lat"], p["lon"], q["lat"], q["lon"]) * F.lit(1000.0)
            links.append(
                F.when(
                    p.isNotNull() & q.isNotNull(),
                    F.struct(
                        metres.alias("metres"),
                        F.lit(len(links)).alias("listed"),
                        F.lit(a).alias("a_end"),
                        F.lit(b).alias("b_end"),
                    ),
                )
            )
    ranked = F.array_sort(F.array_compact(F.array(*links)))
    return (
        pairs.select("pair_id", no_nodes.alias("no_nodes"), F.when(~no_nodes, ranked).alias("links"))
        .select(
            "pair_id",
            "no_nodes",
            F.get("links", F.lit(0))["metres"].alias("closest"),
            F.posexplode_outer("links").alias("rank", "link"),
        )
        .select(
            "pair_id",
            "rank",
            "link.a_end",
            "link.b_end",
            "link.metres",
            F.when(F.col("link").isNotNull(), _graded(F.col("link.metres"), _STATUS, "VERY FAR")).alias("status"),
            F.when(F.col("no_nodes"), "ERROR")
            .otherwise(_graded(F.coalesce("closest", F.lit(float("inf"))), _VERDICT, "SEGMENTS VERY FAR"))
            .alias("verdict"),
        )
    )
