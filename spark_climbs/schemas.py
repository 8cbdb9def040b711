"""Canonical schemas."""

from pyspark.sql import types as T

_string, _long, _int, _double = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TAGS = T.MapType(_string, _string)
NODE = _struct(idx=_int, node_id=_string, lat=_double, lon=_double)
WAYS = _struct(way_id=_long, tags=TAGS, nodes=T.ArrayType(NODE))

OVERPASS_ELEMENT = _struct(
    type=_string,
    id=_long,
    lat=_double,
    lon=_double,
    tags=TAGS,
    nodes=T.ArrayType(_long),
    geometry=T.ArrayType(_struct(lat=_double, lon=_double)),
)
OVERPASS_DOCUMENT = _struct(elements=T.ArrayType(OVERPASS_ELEMENT))

ELEVATION = _struct(lat_e6=_long, lon_e6=_long, elevation=_double)
ELEVATION_GRID = _struct(lat_i=_long, lon_i=_long, elevation=_double)
PLACES = _struct(lat_e3=_long, lon_e3=_long, address=TAGS, full_address=_string)
GAZETTEER = _struct(query=_string, lat=_double, lon=_double, address=_string)
REGION_BOUNDS = _struct(kind=_string, ord=_int, name=_string, lat=_double, lon=_double, radius_km=_double)

CHUNK_STATUS = _struct(
    analysis_id=_string, chunk_index=_int, status=_string, n_segments=_long, ts=T.TimestampType()
)
ANALYSIS = _struct(
    analysis_id=_string,
    address=_string,
    country=_string,
    center_lat=_double,
    center_lon=_double,
    radius_km=_double,
    surface_filter=_string,
    unit_system=_string,
    chunk_size_km=_double,
    total_chunks=_int,
    formatted_address=_string,
)
