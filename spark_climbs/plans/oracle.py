"""DuckDB SQL for the named queries, written independently of the DataFrame code.

Merged roads follow from the shape of the fixture: the ways of a chain meet end to
end and chains never meet, so a road is an island of consecutive steps.
"""

from __future__ import annotations

from spark_climbs.plans.catalog import CENTER

_LAT, _LON = CENTER

_NODES = """
line as (
  select l_orderkey as way_id, l_suppkey, l_extendedprice as price, l_tax as tax,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as idx,
    count(*) over (partition by l_orderkey) as n
  from lineitem),
spot as (
  select *, way_id // 4 as chain, way_id % 4 as step,
    case when n = 1 then 0 else (idx * 4000) // (n - 1) end as run,
    case when idx = 0 or idx = n - 1 then 0 else l_suppkey % 97 end as wobble
  from line),
nodes as (
  select way_id, idx, n, chain, step, price, tax, lat_e6, lon_e6, lat_e6 / 1e6 as lat, lon_e6 / 1e6 as lon
  from (select *, 35000000 + (chain % 150) * 20000 + step * 4000 + run + wobble as lat_e6,
          -82000000 + (chain // 150) * 20000 + step * 4000 + run as lon_e6 from spot)),
elev as (select lat_e6, lon_e6, min(price) / 100.0 * {scale} as elevation from nodes where tax < 0.08 group by all)
"""

_WAYS = """,
plain as (
  select w.way_id, w.chain, w.step, w.n, o_orderstatus, o_orderpriority,
    (['primary', 'residential', 'track', 'path', 'service', 'trunk_link'])[(w.chain % 6 + 1)::int] as highway,
    case when w.chain % 11 <> 0 and w.chain % 13 <> 0 then 'Road ' || (w.chain % 40) end as name,
    case when w.chain % 11 = 0 then 'R' || (w.chain % 7) end as ref,
    case o_orderstatus when 'F' then 'asphalt' when 'P' then 'fine_gravel' end as surface_tag,
    case left(o_orderpriority, 1) when '1' then 'grade1' when '2' then 'Grade2 ' when '4' then 'gradeX' when '5' then 'grade5' end as grade_tag,
    w.start_lat, w.start_lon, w.end_lat, w.end_lon
  from (select way_id, any_value(chain) as chain, any_value(step) as step, any_value(n) as n,
          min(lat) filter (idx = 0) as start_lat, min(lon) filter (idx = 0) as start_lon,
          min(lat) filter (idx = n - 1) as end_lat, min(lon) filter (idx = n - 1) as end_lon
        from nodes group by way_id) w
  left join orders on o_orderkey = w.way_id),
way as (
  select *, coalesce(name, ref, highway) as street_name,
    coalesce(surface_tag, case when highway in ('primary', 'residential') then 'asphalt' when highway = 'service' then 'paved'
      when highway in ('track', 'path') then 'unpaved' else 'unknown' end) as surface,
    case when highway <> 'track' then 'not_applicable' when grade_tag is null then 'unspecified'
      else lower(trim(grade_tag)) end as tracktype,
    case when highway <> 'track' then 'Not a track' when grade_tag is null then 'Track with unspecified surface quality'
      else case lower(trim(grade_tag))
        when 'grade1' then 'Solid: paved or heavily compacted hardcore surface'
        when 'grade2' then 'Mostly solid: unpaved track with through traffic, gravel/dirt with some soft areas'
        when 'grade5' then 'Soft: soil/sand/grass, no hard material. Almost impossible for cars'
        else 'Unknown tracktype: ' || lower(trim(grade_tag)) end end as tracktype_definition
  from plain)
"""


def _hav(a_lat, a_lon, b_lat, b_lon) -> str:
    h = (
        f"(sin(radians({b_lat} - {a_lat}) / 2) ** 2 + cos(radians({a_lat})) * cos(radians({b_lat})) "
        f"* sin(radians({b_lon} - {a_lon}) / 2) ** 2)"
    )
    return f"(6371.0 * 2 * atan2(sqrt({h}), sqrt(1 - {h})))"


# All ways with the copies: seen again from the next chunk, and shifted near copies.
_COPIES = """,
copies as (
  select *, chain % 8 as chunk_index, way_id as id, 0 as shift from way
  union all select *, (chain % 8 + 1) % 8, way_id, 0 from way where way_id % 10 = 0
  union all select *, chain % 8, way_id + 10000000, 30 from way where way_id % 37 = 0),
segs as (
  select *, chunk_index * 100000000000 + id as seq,
    (floor(start_lat * 1e6 + 0.5) + shift) / 1e6 as s_lat, (floor(end_lat * 1e6 + 0.5) + shift) / 1e6 as e_lat
  from copies where n >= 2),
exact as (select * from segs qualify row_number() over (partition by id order by seq) = 1)
"""

# Similar starts and ends by a band join: the box is wider than the tolerance.
_SIMILAR = f""",
pairs as (
  select a.seq as a_seq, b.seq as b_seq from exact a join exact b
    on a.s_lat between b.s_lat - 0.0002 and b.s_lat + 0.0002 and a.start_lon between b.start_lon - 0.0002 and b.start_lon + 0.0002
  where a.seq < b.seq and {_hav('a.s_lat', 'a.start_lon', 'b.s_lat', 'b.start_lon')} * 1000 < 10
    and {_hav('a.e_lat', 'a.end_lon', 'b.e_lat', 'b.end_lon')} * 1000 < 10),
dropped as (select b_seq as dropped_seq, min(a_seq) as kept_seq from pairs group by b_seq)
"""

# Islands of consecutive steps. Which way a road is attached from does not change
# its direction here: all joints are end to start.
_ROADS = """,
member as (
  select *, chain * 4 + step - row_number() over (partition by chain order by step) as island from {source}),
road as (
  select chain, island, min(way_id) as first_way, any_value(street_name) as street_name, count(*) as n_ways,
    string_agg(way_id::varchar, ',' order by way_id) as way_ids, sum(n) - count(*) + 1 as n_nodes,
    arg_min(start_lat, step) as start_lat, arg_min(start_lon, step) as start_lon,
    arg_max(end_lat, step) as end_lat, arg_max(end_lon, step) as end_lon
  from member group by chain, island),
road_node as (
  select m.chain, m.island, m.step as road_pos, x.idx, x.lat, x.lon, e.elevation
  from member m join nodes x using (way_id) join elev e using (lat_e6, lon_e6)
  where not (x.idx = 0 and exists (select 1 from member p where p.chain = m.chain and p.island = m.island and p.step = m.step - 1)))
"""

# The order of joining: the way with most nodes first, then whichever neighbour of the stretch has more. A way
# seen from two chunks counts in the first.
_SEQ = "case when {m}way_id % 10 = 0 and {m}chain % 8 = 7 then 0 else {m}chain % 8 end * 100000000000 + {m}way_id"
_JOINED = """,
grown as (
  select chain, island, 0 as no, way_id, step as low, step as high from (
    select * from member qualify row_number() over (partition by chain, island order by n desc, {seq}) = 1)
  union all
  select chain, island, no, way_id, low, high from (
    select g.chain, g.island, g.no + 1 as no, m.way_id, least(low, m.step) as low, greatest(high, m.step) as high,
      row_number() over (partition by g.chain, g.island order by m.n desc, {m_seq}) as turn
    from grown g join member m on m.chain = g.chain and m.island = g.island and (m.step = low - 1 or m.step = high + 1))
  where turn = 1),
told as (
  select g.chain, g.island, string_agg(way_id::varchar, ',' order by no) as joined_ids, arg_min(way_id, no) as seed,
    coalesce(arg_min(surface, no) filter (surface <> 'unknown'), 'unknown') as surface,
    coalesce(arg_min(tracktype, no) filter (tracktype not in ('unknown', 'not_applicable')), arg_min(tracktype, no)) as tracktype,
    coalesce(arg_min(tracktype_definition, no) filter (tracktype not in ('unknown', 'not_applicable')), arg_min(tracktype_definition, no)) as tracktype_definition
  from grown g join way using (way_id) group by g.chain, g.island)
"""

# Every way of which the id leaves one when divided by three runs the other way, so ways meet by any two ends.
# ``ahead``: whether the road runs with the steps; ``rightward``: whether a way joins after the last step.
_TURNED = """,
turned as (select *, way_id % 3 = 1 as turned, n as n_ from member),
joint as (
  select chain, island, 0 as no, way_id, null::bigint as beside, null::varchar as kind, step as low, step as high, not turned as ahead from (
    select * from turned qualify row_number() over (partition by chain, island order by n desc, way_id) = 1)
  union all
  select chain, island, no, way_id, beside,
    case when rightward = ahead then 'end1_to_' else 'start1_to_' end || case when rightward <> turned then 'start2' else 'end2' end,
    low, high,
    case when rightward <> ahead and rightward <> turned then not ahead else ahead end
  from (
    select g.chain, g.island, g.no + 1 as no, m.way_id, m.turned, g.ahead, m.step = high + 1 as rightward,
      m.way_id + case when m.step = high + 1 then -1 else 1 end as beside,
      least(low, m.step) as low, greatest(high, m.step) as high,
      row_number() over (partition by g.chain, g.island order by m.n desc, m.way_id) as turn
    from joint g join turned m on m.chain = g.chain and m.island = g.island and (m.step = low - 1 or m.step = high + 1))
  where turn = 1),
way_road as (
  select chain, island, arg_min(way_id, no) as seed, string_agg(way_id::varchar, ',' order by no) as way_ids,
    min(low) as low, max(high) as high, arg_max(ahead, no) as ahead
  from joint group by chain, island)
"""

_CLIMBS = f""",
stepped as (
  select *, lag(lat) over w as p_lat, lag(lon) over w as p_lon, lag(elevation) over w as p_elevation
  from road_node window w as (partition by chain, island order by road_pos, idx)),
moved as (
  select *, case when p_lat is not null then {_hav('p_lat', 'p_lon', 'lat', 'lon')} end as km, elevation - p_elevation as rise from stepped),
summed as (
  select chain, island, count(*) as n_valid, min(elevation) as min_elevation, max(elevation) as max_elevation,
    sum(km) as length_km, coalesce(sum(greatest(rise, 0)), 0) as elevation_gain,
    coalesce(max(case when km > 0 then abs(rise / (km * 1000)) * 100 end), 0) as max_grade,
    arg_min(lat, (road_pos, idx)) as f_lat, arg_min(lon, (road_pos, idx)) as f_lon,
    arg_max(lat, (road_pos, idx)) as l_lat, arg_max(lon, (road_pos, idx)) as l_lon
  from moved group by chain, island),
climb as (
  select *, max_elevation - min_elevation as height, max_elevation - min_elevation as prominence,
    (max_elevation - min_elevation) / (length_km * 1000) * 100 as avg_grade,
    {_hav('f_lat', 'f_lon', 'l_lat', 'l_lon')} as distance_km
  from summed where n_valid >= 2 and length_km <> 0),
scored as (
  select *, case when avg_grade > 0 then length_km * 1000 * avg_grade else 0 end as climb_score from climb),
rated as (
  select *, case when climb_score > 80000 then 'HC' when climb_score > 64000 then '1' when climb_score > 32000 then '2'
    when climb_score > 16000 then '3' when climb_score > 8000 then '4' else 'N/A' end as climb_category
  from scored join road using (chain, island))
"""

_METRICS = """
  round(climb_score, 4) as climb_score, round(elevation_gain, 4) as elevation_gain, round(height, 4) as height,
  round(prominence, 4) as prominence, round(length_km, 6) as length_km, round(distance_km, 6) as distance_km,
  round(avg_grade, 4) as avg_grade, round(max_grade, 4) as max_grade,
  round(min_elevation, 4) as min_elevation, round(max_elevation, 4) as max_elevation"""

_PLACES = """,
cell as (
  select floor(lat * 1e3 + 0.5)::bigint as lat_e3, floor(lon * 1e3 + 0.5)::bigint as lon_e3, min(way_id) as w
  from nodes where idx = 0 group by all),
place as (select *, 'Town ' || (w % 50) as city, 'State ' || (w % 10) as state from cell where w % 7 <> 0)
"""


def _located(climbs: str) -> str:
    """Location of climbs: the last of a cell in rank order lends its start."""
    return f""",
keyed as (
  select *, floor(start_lat * 1e3 + 0.5)::bigint as lat_e3, floor(start_lon * 1e3 + 0.5)::bigint as lon_e3 from {climbs}),
shared as (
  select *, last_value(start_lat) over w as shared_lat, last_value(start_lon) over w as shared_lon from keyed
  window w as (partition by lat_e3, lon_e3 order by climb_score desc, {{order}}
    rows between unbounded preceding and unbounded following)),
located as (
  select s.*, coalesce(p.city, 'Unknown') as city, coalesce(p.state, 'Unknown') as state,
    {_hav(_LAT, _LON, 'shared_lat', 'shared_lon')} as center_km
  from shared s left join place p using (lat_e3, lon_e3))
"""


def _nodes(scale: float = 1.0) -> str:
    return "with recursive " + _NODES.format(scale=scale)


def _single(scale: float = 1.0) -> str:
    """Climbs of single ways: every way is its own road."""
    own = "(select *, way_id as chain_ from way where n >= 2)"
    roads = _ROADS.format(source=own).replace(
        "chain * 4 + step - row_number() over (partition by chain order by step) as island", "way_id as island"
    )
    return _nodes(scale) + _WAYS + roads + _CLIMBS


def _joined(seq: str) -> str:
    return _JOINED.format(seq=seq.format(m=""), m_seq=seq.format(m="m."))


def _merged(scale: float = 1.0, where: str = "true") -> str:
    return _nodes(scale) + _WAYS + _ROADS.format(source=f"(select * from way where n >= 2 and {where})") + _joined(_SEQ) + _CLIMBS


_FILTERS = {
    "paved": "regexp_matches(highway, 'trunk|primary|secondary|tertiary|unclassified|residential|service') and not "
    "regexp_matches(coalesce(surface_tag, ''), 'unpaved|gravel|dirt|sand|grass|ground|earth|mud|clay')",
    "gravel": "regexp_matches(highway, 'track|unclassified|tertiary|residential|service') and "
    "regexp_matches(coalesce(surface_tag, ''), 'gravel|compacted|fine_gravel')",
    "dirt": "regexp_matches(highway, 'track|path')",
    "all": "regexp_matches(highway, 'trunk|primary|secondary|tertiary|unclassified|residential|service|track|path')",
}


def _report(scale: float, climbs: str, imperial: bool, extra: str = "") -> str:
    feet, miles = (3.28084, 0.621371) if imperial else (1.0, 1.0)
    up, along = ("ft", "mi") if imperial else ("m", "km")
    return f"""
select street_name as "Street Name", city as "City", state as "State", round(center_km * {miles}, 1) as "From Center ({along})",
  climb_category as "Category", trunc(climb_score)::bigint as "Score", trunc(elevation_gain * {feet})::bigint as "Elev Gain ({up})",
  trunc(height * {feet})::bigint as "Height ({up})", trunc(prominence * {feet})::bigint as "Prominence ({up})",
  round(length_km * {miles}, 2) as "Length ({along})", round(distance_km * {miles}, 2) as "Distance ({along})",
  round(avg_grade, 2) as "Avg Grade (%)", round(max_grade, 2) as "Max Grade (%)"{extra}
from {climbs}"""


def _arc_km(p_lat, p_lon, edge: str = "") -> str:
    """Distance of a point from the edge between (lat, lon) and (to_lat, to_lon), by the angles and sides
    of the triangle that the three form: across from the nearer end, or beyond it."""
    def bearing(a, b):
        (a_lat, a_lon), (b_lat, b_lon) = a, b
        return (
            f"atan2(sin(radians({b_lon} - {a_lon})) * cos(radians({b_lat})), cos(radians({a_lat})) * sin(radians({b_lat})) "
            f"- sin(radians({a_lat})) * cos(radians({b_lat})) * cos(radians({b_lon} - {a_lon})))"
        )

    p, a, b = (p_lat, p_lon), (f"{edge}lat", f"{edge}lon"), (f"{edge}to_lat", f"{edge}to_lon")
    to_a, to_b = _hav(*p, *a), _hav(*p, *b)
    turn = f"({bearing(a, p)} - {bearing(a, b)})"
    other = f"({bearing(b, p)} - {bearing(b, a)})"
    across = f"abs(asin(sin({to_a} / 6371.0) * sin({turn}))) * 6371.0"
    return f"case when {_hav(*a, *b)} > 0 and cos({turn}) > 0 and cos({other}) > 0 then {across} else least({to_a}, {to_b}) end"


def _near(radius_km: float) -> str:
    return f"{_arc_km(_LAT, _LON)} <= {radius_km!r}"


# Every node with the next one of its way; a lone one with itself.
_EDGES = """(
  select *, coalesce(next_lat, lat) as to_lat, coalesce(next_lon, lon) as to_lon from (
    select *, lead(lat) over w as next_lat, lead(lon) over w as next_lon, count(*) over (partition by way_id) as n_nodes
    from {nodes} window w as (partition by way_id order by idx))
  where next_lat is not null or n_nodes = 1)"""

_LONG = """,
long_nodes as (
  select o_custkey as way_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as idx, lat, lon
  from nodes join orders on o_orderkey = way_id where idx = 0)
"""

# Where an edge is inside a cell on either axis, in parts of its length.
_CROSSED = """
select distinct chunk_index, way_id from chunk c, (
  select e.*, (e.lat - center_lat) / (8.0 / 111.0) as y0, (e.to_lat - center_lat) / (8.0 / 111.0) as y1,
    (e.lon - center_lon) / (8.0 / (111.0 * cos(radians(center_lat)))) as x0,
    (e.to_lon - center_lon) / (8.0 / (111.0 * cos(radians(center_lat)))) as x1
  from {edges} e, area) e
where greatest(
    case when x0 = x1 then case when abs(x0 - j) <= 0.5 then 0 else 2 end else least((j - 0.5 - x0) / (x1 - x0), (j + 0.5 - x0) / (x1 - x0)) end,
    case when y0 = y1 then case when abs(y0 - i) <= 0.5 then 0 else 2 end else least((i - 0.5 - y0) / (y1 - y0), (i + 0.5 - y0) / (y1 - y0)) end, 0)
  <= least(
    case when x0 = x1 then 1 else greatest((j - 0.5 - x0) / (x1 - x0), (j + 0.5 - x0) / (x1 - x0)) end,
    case when y0 = y1 then 1 else greatest((i - 0.5 - y0) / (y1 - y0), (i + 0.5 - y0) / (y1 - y0)) end, 1)
"""



def _area_report(imperial: bool, radius_km: float, kind: str) -> str:
    """Selection works on whole ways, merging on what is selected."""
    where = f"{_FILTERS[kind]} and way_id in (select way_id from {_EDGES.format(nodes='nodes')} where {_near(radius_km)})"
    kept = "(select * from rated join told using (chain, island) where climb_score >= 6000)"
    order = _SEQ.format(m="").replace("way_id", "seed")
    return _merged(1.00013, where) + _PLACES + _located(kept).format(order=order) + _report(1.00013, "located", imperial, _WAY_COLUMNS)


_AREAS = """,
areas as (
  select n_nationkey::bigint as area_id, 35.1 + n_nationkey * 0.25 as center_lat, -81.98 + (n_nationkey % 5) * 0.03 as center_lon,
    6.0 + (n_nationkey % 4) * (n_nationkey % 4) * 5.0 as radius_km
  from nation where n_nationkey < 12)"""


def _resumed() -> str:
    """Ways of the chunks they cross, in the order of the first."""
    crossed = _CROSSED.format(edges=_EDGES.format(nodes="nodes"))
    grid = _AREA_GRID.replace("{area}", _ONE_AREA)
    first = f", {grid}, placed as (select way_id, min(chunk_index)::bigint * 1000000000000 + way_id as seq from ({crossed}) group by way_id)"
    own = f"(select way.*, placed.seq from way join placed using (way_id) where n >= 2 and {_FILTERS['all']})"
    kept = "(select * from rated join told using (chain, island) where climb_score >= 6000)"
    climbs = _ROADS.format(source=own) + _joined("{m}seq") + _CLIMBS + _PLACES + _located(kept).format(order="seed")
    return _nodes(1.00013) + _WAYS + first + climbs + _report(1.00013, "located", True, _WAY_COLUMNS)


def _multi_area() -> str:
    """Ways of every area as ways of their own, whose chains are a million apart from one area to the next."""
    inside = (
        f", inside as (select distinct area_id, way_id from {_EDGES.format(nodes='nodes')} e, areas"
        f" where {_arc_km('center_lat', 'center_lon', 'e.')} <= radius_km)"
    )
    own = (
        f"(select way.* replace (way.chain + area_id * 1000000 as chain) from way join inside using (way_id) where n >= 2 and {_FILTERS['all']})"
    )
    located = _located("(select * from rated join told using (chain, island) where climb_score >= 6000)").format(order=_SEQ.format(m="").replace("way_id", "seed"))
    located = located.replace("partition by lat_e3", "partition by chain // 1000000, lat_e3")
    located = located.replace(_hav(_LAT, _LON, "shared_lat", "shared_lon"), _hav("a.center_lat", "a.center_lon", "shared_lat", "shared_lon"))
    located = located.replace("from shared s left join place", "from shared s join areas a on a.area_id = chain // 1000000 left join place")
    return (
        _nodes(1.00013) + _WAYS + _AREAS + inside + _ROADS.format(source=own) + _joined(_SEQ) + _CLIMBS + _PLACES + located
        + _report(1.00013, "located", True, _WAY_COLUMNS).replace("select street_name", "select (chain // 1000000)::bigint as area_id, street_name", 1)
    )


_WAY_COLUMNS = """,
  surface as "Surface", tracktype as "Tracktype", seed::varchar as "Way ID",
  '[' || seed || '](https://www.openstreetmap.org/way/' || seed || ')' as "OSM Link\""""

_AREA_GRID = """
area as (select {area}),
grid as (
  select area_id, center_lat, center_lon, radius_km, i, j, 8.0 as size,
    case when radius_km <= 8 then radius_km else 4.0 end as chunk_radius_km,
    center_lat + i * 8.0 / 111.0 as lat, center_lon + j * 8.0 / (111.0 * cos(radians(center_lat))) as lon
  from (select *, case when radius_km <= 8 then 0 else ceil(radius_km / 8.0)::int end as n from area) a,
    range(-60, 61) ri(i), range(-60, 61) rj(j)
  where abs(i) <= n and abs(j) <= n),
chunk as (
  select *, (row_number() over (partition by area_id order by i, j) - 1)::int as chunk_index
  from grid where {near})
""".replace("{near}", _hav("center_lat", "center_lon", "lat", "lon") + " <= radius_km")

_ONE_AREA = f"1::bigint as area_id, {_LAT}::double as center_lat, {_LON}::double as center_lon, 60.0::double as radius_km"

_SUPPLIER_AREAS = """s_suppkey as area_id, (25.0 + s_nationkey)::double as center_lat, (-120.0 + s_suppkey % 50)::double as center_lon,
  (4.3 + s_suppkey % 40)::double as radius_km from supplier"""

_DOCUMENTS = """,
usable as (
  select *, way_id // 200 as doc,
    case when way_id % 2 = 0 then price % 50 >= 1 else idx % 5 <> 3 end as ok,
    case when way_id % 2 = 0 then way_id || '_' || idx else (way_id * 100 + idx)::varchar end as node_id
  from nodes)
"""

_STATUS = """
with status as (
  select 'run' || (o_orderkey % 12) || '_' || (o_orderkey % 40) as analysis_id, ((o_orderkey // 40) % 90)::int as chunk_index,
    case when o_orderkey % 6 = 0 then 'empty' when o_orderkey % 17 = 0 then 'failed' else 'ok' end as status
  from orders),
done as (select distinct analysis_id, chunk_index from status where status in ('ok', 'empty')),
analysis as (
  select analysis_id, case when split_part(analysis_id, '_', 2)::int % 9 = 0 then 0
    when split_part(analysis_id, '_', 2)::int % 2 = 0 then 10 else 100 end as total
  from (select distinct analysis_id from status)),
cached as (
  select 'run' || (o_orderkey % 12) || '_' || (o_orderkey % 40) as analysis_id, count(*) as elevation_coords
  from orders where o_orderkey % 40 % 4 = 2 group by 1),
progress as (
  select a.analysis_id, coalesce(d.completed, 0) as completed, total::bigint as total,
    case when total > 0 then coalesce(d.completed, 0) * 100.0 / total else 0.0 end as percentage
  from analysis a left join (select analysis_id, count(*) as completed from done group by 1) d using (analysis_id)),
resumable as (
  select analysis_id, completed, total, round(case when completed < total then percentage else 100.0 end, 6)::double as percentage,
    coalesce(elevation_coords, 0)::bigint as elevation_coords,
    case when completed < total then 'chunk_processing' else 'elevation_fetching' end as phase
  from progress left join cached using (analysis_id)
  where analysis_id like 'run2\\_%' escape '\\' and (completed < total or coalesce(elevation_coords, 0) > 0))
"""

_MANIFEST = """
with manifest as (
  select p_partkey, case when p_partkey % 11 = 0 then '  ' else ' ' || printf('%s%02d%s%03d',
    case when p_partkey % 3 = 0 then 's' else 'n' end, p_partkey % 80, case when p_partkey % 7 = 0 then 'e' else 'w' end, p_partkey % 180)
    || case when p_partkey % 2 = 0 then '.tif' else '' end end as value
  from part),
tile as (
  select replace(trim(value), '.tif', '') as tile from manifest where trim(value) <> ''),
listed as (
  select tile, 'https://prd-tnm.s3.amazonaws.com/StagedProducts/Elevation/13/TIFF/current/' || tile || '/USGS_13_' || tile || '.tif' as url,
    'USGS_13_' || tile || '.tif' as file_name from tile)
"""

_REGIONS = """
with bounds as (
  select case when n_nationkey % 5 = 4 then 'country' else 'state' end as kind, n_nationkey as ord,
    lower(replace(n_name, '_', ' ')) as name, 30.0 + n_nationkey * 0.5 as lat, -110.0 + n_nationkey * 1.5 as lon, 100.0 + n_nationkey as radius_km
  from nation),
wanted as (
  select distinct case c_custkey % 4 when 0 then '  ' || upper('Nation ' || (c_custkey % 30)) || ' '
    when 1 then 'Greater Nation ' || (c_custkey % 30) || ' Area ' || (c_custkey % 90)
    when 2 then substring('Nation ' || (c_custkey % 30), 4, 6) else c_mktsegment || ' zz' end as name
  from customer)
"""


def _region(kind: str, default: str) -> str:
    lat, lon, radius = default.split()
    return f"""{_REGIONS}
select w.name, b.name as matched_name, case when b.name is null then 'default' when b.name = trim(lower(w.name)) then 'exact' else 'partial' end as matched_by,
  coalesce(b.lat, {lat})::double as lat, coalesce(b.lon, {lon})::double as lon, coalesce(b.radius_km, {radius})::double as radius_km
from wanted w left join bounds b on b.kind = '{kind}'
  and (contains(b.name, trim(lower(w.name))) or contains(trim(lower(w.name)), b.name))
qualify row_number() over (partition by w.name order by (b.name = trim(lower(w.name))) desc, b.ord) = 1"""


_GEOCODE = """
with customers as (
  select c_custkey as k, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as seg, 'Town ' || (c_custkey % 60) as town,
    case when c_custkey % 2 = 0 then ', us' else '' end as tail
  from customer),
tries as (
  select k as address_id, 0 as rank, case when k % 9 = 0 then town || tail else k || ' ' || seg || ' St, ' || town || ', NC' || tail end as query from customers
  union all select k, 1, seg || ' St, ' || town || ', NC' || tail from customers where k % 9 <> 0
  union all select k, 2, town || ', NC' || tail from customers where k % 9 <> 0),
known as (
  select k || ' ' || seg || ' St, ' || town || ', NC, us' as query, k / 1000.0 as lat, k / -1000.0 as lon, 'full' as address from customers where k % 6 = 0
  union all select seg || ' St, ' || town || ', NC, us', k % 60 + 0.5, k % 60 - 0.5, 'street' from customers where k % 6 = 2
  union all select town || ', NC', (k % 60) * 1.0, (k % 60) * -1.0, 'town' from customers where k % 60 < 40),
hit as (select query, lat::double as lat, lon::double as lon, address from known qualify row_number() over (partition by query order by lat, lon, address) = 1)
"""


def all_sql() -> dict[str, str]:
    nodes, ways = _nodes(), _nodes() + _WAYS
    edges, long_edges = _EDGES.format(nodes="nodes"), _EDGES.format(nodes="long_nodes")
    roads = ways + _ROADS.format(source="(select * from way where n >= 2)") + _joined("{m}way_id")
    turned = roads + _TURNED
    one_grid = _AREA_GRID.replace("{area}", _ONE_AREA)
    in_disc = "select distinct c.chunk_index, x.way_id from {edges} x join chunk c on " + _arc_km("c.lat", "c.lon", "x.") + " <= c.chunk_radius_km"
    sql = {
        "road_attributes": ways + "select way_id, street_name, surface, tracktype, tracktype_definition from way",
        "distinct_ways": ways + _COPIES + """
            select id as way_id, chunk_index::int as chunk_index, n::int as n_nodes from copies
            qualify row_number() over (partition by id order by chunk_index) = 1""",
        "way_start": ways + "select way_id, start_lat, start_lon from way",
        "overpass_ways": nodes + _DOCUMENTS + """
            select doc, way_id, count(*) as n_nodes, arg_min(node_id, idx) as first_node, arg_max(node_id, idx) as last_node,
              sum(lon_e6)::bigint as lon_sum
            from usable where ok and doc % 10 <> 9 group by doc, way_id having count(*) > 1""",
        "within_radius": nodes + f"select distinct way_id from {edges} where {_near(60.0)}",
        "ways_within_radius": nodes + f"""
            select way_id, any_value(n)::int as n_nodes from {edges} group by way_id having bool_or({_near(60.0)})""",
        "long_edges_within_radius": nodes + _LONG + f"select distinct way_id from {long_edges} where {_near(5.0)}",
        "chunk_grid": "with " + _AREA_GRID.replace("{area}", _SUPPLIER_AREAS) + """
            select area_id, chunk_index, round(lat, 6) as lat, round(lon, 6) as lon, chunk_radius_km::double as chunk_radius_km from chunk""",
        "assign_chunks": nodes + "," + one_grid + _CROSSED.format(edges=edges),
        "assign_chunks_circle": nodes + "," + one_grid + in_disc.format(edges=edges),
        "assign_chunks_long_edges": nodes + _LONG + "," + one_grid + _CROSSED.format(edges=long_edges),
        "assign_chunks_circle_long_edges": nodes + _LONG + "," + one_grid + in_disc.format(edges=long_edges),
        "valid_coords": """
            select event_id, case when ok then value - 20.0 end as lat, case when ok then value * 4 - 40.0 end as lon
            from (select *, value - 20.0 between -90 and 90 and value * 4 - 40.0 between -180 and 180 as ok from events)""",
        "dedup_exact": ways + _COPIES + "select seq, id::varchar as way_ids, street_name from exact",
        "near_dup_pairs": ways + _COPIES + _SIMILAR + "select dropped_seq, kept_seq from dropped",
        "dedup_near": ways + _COPIES + _SIMILAR + """
            select seq, id::varchar as way_ids from exact where seq not in (select dropped_seq from dropped)""",
        "components": ways + _ROADS.format(source="(select * from way where n >= 2)") + """
            select way_id, min(way_id) over (partition by chain, island) as component from member""",
        "endpoint_joints": ways + _ROADS.format(source="(select * from way where n >= 2)") + """
            select a.way_id as left_way, b.way_id as right_way from member a join member b
              on a.chain = b.chain and a.island = b.island and b.step = a.step + 1""",
        "merge_by_endpoint": roads + """
            select seed as first_way, joined_ids as way_ids, street_name, surface, tracktype, tracktype_definition,
              n_nodes::bigint as n_nodes, round(start_lat, 6) as start_lat, round(end_lat, 6) as end_lat
            from road join told using (chain, island)""",
        "merge_turned": turned + """
            select seed as first_way, r.way_ids, any_value(m.street_name) as street_name, sum(n) - count(*) + 1 as n_nodes,
              round(case when ahead then arg_min(start_lat, step) else arg_max(end_lat, step) end, 6) as start_lat,
              round(case when ahead then arg_min(start_lon, step) else arg_max(end_lon, step) end, 6) as start_lon,
              round(case when ahead then arg_max(end_lat, step) else arg_min(start_lat, step) end, 6) as end_lat,
              round(case when ahead then arg_max(end_lon, step) else arg_min(start_lon, step) end, 6) as end_lon
            from way_road r join turned m using (chain, island) group by seed, r.way_ids, ahead""",
        "turned_members": turned + """
            select m.way_id, r.seed as road, j.no::int as attach_no,
              case when r.ahead then step - r.low else r.high - step end::int as road_pos, turned = r.ahead as reversed,
              coalesce(j.kind like '%start2', false) or coalesce(bool_or(o.kind = 'start1_to_end2' and (o.way_id < m.way_id) <> turned), false) as drop_head,
              coalesce(j.kind = 'end1_to_end2', false) or coalesce(bool_or(o.kind = 'start1_to_end2' and (o.way_id < m.way_id) = turned), false) as drop_tail
            from turned m join joint j using (way_id) join way_road r on r.chain = m.chain and r.island = m.island
            left join joint o on o.beside = m.way_id
            group by m.way_id, r.seed, j.no, r.ahead, step, r.low, r.high, turned, j.kind""",
        "connected_pairs": turned + """,
            side as (
              select *, case when turned then end_lat else start_lat end as a_lat, case when turned then end_lon else start_lon end as a_lon,
                case when turned then start_lat else end_lat end as b_lat, case when turned then start_lon else end_lon end as b_lon
              from turned),
            duo as (
              select x.way_id as left_way, y.way_id as right_way, x.n + y.n - 1 as n_nodes, x.surface as s1, y.surface as s2,
                x.tracktype as t1, y.tracktype as t2, x.tracktype_definition as d1, y.tracktype_definition as d2,
                x.a_lat as xa, x.b_lat as xb, y.a_lat as ya, y.b_lat as yb,
                case when greatest(abs(x.b_lat - y.a_lat), abs(x.b_lon - y.a_lon)) < 0.002 then 'end1_to_start2'
                  when greatest(abs(x.b_lat - y.b_lat), abs(x.b_lon - y.b_lon)) < 0.002 then 'end1_to_end2'
                  when greatest(abs(x.a_lat - y.a_lat), abs(x.a_lon - y.a_lon)) < 0.002 then 'start1_to_start2'
                  when greatest(abs(x.a_lat - y.b_lat), abs(x.a_lon - y.b_lon)) < 0.002 then 'start1_to_end2' end as kind
              from side x join side y on abs(y.way_id - x.way_id) = 1 and y.street_name = x.street_name)
            select kind, left_way || ',' || right_way as way_ids, n_nodes::bigint as n_nodes,
              round(case kind when 'end1_to_start2' then xa when 'end1_to_end2' then xa when 'start1_to_start2' then xb else ya end, 6) as start_lat,
              round(case kind when 'end1_to_start2' then yb when 'end1_to_end2' then ya when 'start1_to_start2' then yb else xb end, 6) as end_lat,
              case when s1 = 'unknown' then s2 else s1 end as surface,
              case when t1 in ('unknown', 'not_applicable') and t2 not in ('unknown', 'not_applicable') then t2 else t1 end as tracktype,
              case when t1 in ('unknown', 'not_applicable') and t2 not in ('unknown', 'not_applicable') then d2 else d1 end as tracktype_definition
            from duo where kind is not null""",
        "merge_by_node_id": ways + _ROADS.format(source="(select * from way where n >= 2)") + """
            select first_way, string_agg(way_id::varchar, ',' order by m.way_id) as way_ids, any_value(m.street_name) as street_name,
              arg_min(surface, way_id) as surface, arg_min(tracktype, way_id) as tracktype, any_value(n_nodes)::bigint as n_nodes
            from road join member m using (chain, island) group by chain, island, first_way""",
        "connectivity_report": ways + f""",
            a as (select * from way where n >= 2),
            duo as (select a.*, b.way_id as other, b.start_lat as b_start_lat, b.start_lon as b_start_lon, b.end_lat as b_end_lat, b.end_lon as b_end_lon
              from a left join a b on b.way_id = a.way_id + 1),
            link as (
              {' union all '.join(
                  f"select way_id, other, {k} as listed, '{p}' as a_end, '{q}' as b_end, "
                  f"{_hav(f'{p}_lat', f'{p}_lon', f'b_{q}_lat', f'b_{q}_lon')} * 1000 as metres from duo where other is not null"
                  for k, (p, q) in enumerate((p, q) for p in ('start', 'end') for q in ('start', 'end')))})
            select way_id as pair_id, (row_number() over w - 1)::int as rank, a_end, b_end, round(metres, 4) as metres,
              case when metres < 100 then 'CONNECTABLE' when metres < 1000 then 'TOO FAR' else 'VERY FAR' end as status,
              case when min(metres) over p < 10 then 'SHOULD MERGE' when min(metres) over p < 100 then 'MIGHT MERGE'
                when min(metres) over p < 1000 then 'GAP TOO LARGE' else 'SEGMENTS VERY FAR' end as verdict
            from link window w as (partition by way_id order by metres, listed), p as (partition by way_id)
            union all select way_id, null, null, null, null, null, 'ERROR' from duo where other is null""",
        "distinct_coords": nodes + "select distinct lat_e6, lon_e6 from nodes",
        "attach_elevation": nodes + "select way_id, idx::int as idx, lat_e6, lon_e6, elevation from nodes left join elev using (lat_e6, lon_e6)",
        "missing_elevations": nodes + "select distinct lat_e6, lon_e6 from nodes except select lat_e6, lon_e6 from elev",
        "elevation_cache": nodes + "select lat_e6, lon_e6, elevation from elev",
        "sample_elevation_grid": nodes + """,
            coord as (select distinct lat_e6, lon_e6, floor(lat_e6 / 500.0)::bigint as i, floor(lon_e6 / 500.0)::bigint as j from nodes),
            need as (select *, lat_e6 <> i * 500 as up, lon_e6 <> j * 500 as side from coord),
            gone as (select *, ((i + j) % 97 + 97) % 97 as m from need)
            select lat_e6, lon_e6, case when m = 0 or (up and m = 96) or (side and m = 96) or (up and side and m = 95) then null
              else round(lat_e6 / 500.0 * 0.25 + lon_e6 / 500.0 * 0.5, 4) end as elevation
            from gone""",
        "single_way_climbs": _single() + f"""
            select island as way_id, street_name, climb_category, {_METRICS} from rated where climb_score >= 6000""",
        "climb_metrics": _merged() + f"""
            select seed as first_way, street_name, climb_category, n_ways, n_ways as n_links, {_METRICS}
            from rated join told using (chain, island)""",
        "category_counts": _merged() + "select climb_category, count(*) as n_climbs from rated group by 1",
        "rank_climbs": _merged() + """
            select seed as first_way, street_name, round(climb_score, 4) as climb_score
            from rated join told using (chain, island) where climb_score >= 6000 order by rated.climb_score desc limit 100""",
        "run_metrics": _merged() + """,
            place_ as (
              select m.way_id, x.lat_e6, x.lon_e6 from member m join nodes x using (way_id)
              where not (x.idx = 0 and exists (select 1 from member p where p.chain = m.chain and p.island = m.island and p.step = m.step - 1)))
            select (select count(*) from place_) as n_coordinates, (select count(*) from (select distinct lat_e6, lon_e6 from place_)) as n_unique,
              (select count(*) from (select distinct lat_e6, lon_e6 from place_) semi join elev using (lat_e6, lon_e6)) as n_elevations,
              (select count(*) from member) as n_segments, (select count(*) from road) as n_roads, (select count(*) from rated) as n_climbs""",
        "attach_location": _single() + _PLACES + _located("rated").format(order="island") + """
            select island as way_id, city, state, round(center_km, 6) as center_km from located""",
        "single_way_report": _single(1.00013) + _PLACES
        + _located("(select * from rated where climb_score >= 6000)").format(order="island")
        + _report(1.00013, "located join way on way.way_id = island", True, """,
            surface as "Surface", tracktype as "Tracktype", island::varchar as "Way ID",
            '[' || island || '](https://www.openstreetmap.org/way/' || island || ')' as "OSM Link" """)
        .replace("select street_name", "select located.street_name"),
        "report_imperial": _area_report(True, 500.0, "all"),
        "report_metric": _area_report(False, 500.0, "paved"),
        "ways_of_areas": nodes + _LONG + _AREAS + f"""
            select distinct area_id, way_id from {long_edges} e, areas where {_arc_km('center_lat', 'center_lon', 'e.')} <= radius_km""",
        "multi_area_report": _multi_area(),
        "resumed_report": _resumed(),
        "flagship": _area_report(True, 150.0 * 1.60934, "all"),
        "resolve_region": _region("state", "39.0 -98.0 400.0"),
        "resolve_region_country": _region("country", "0.0 0.0 1000.0"),
        "suggest_regions": _REGIONS + "select name from bounds where kind = 'state' order by name",
        "geocode_candidates": _GEOCODE + "select address_id, rank, query from tries",
        "geocode": _GEOCODE + """,
            best as (select address_id, rank, lat, lon, address from tries join hit using (query)
              qualify row_number() over (partition by address_id order by rank) = 1)
            select k as address_id, lat, lon, address as formatted_address, rank as matched_by
            from customers left join best on address_id = k""",
        "tile_urls": _MANIFEST + "select tile, url, file_name from listed",
        "tile_names": _MANIFEST + """
            select distinct file_name, 'USGS_13_' || case when tile[1:3] = 'n00' then 's01'
                when tile[1] = 'n' then 'n' || lpad((tile[2:3]::int - 1)::varchar, 2, '0')
                else 's' || lpad((tile[2:3]::int + 1)::varchar, 2, '0') end || tile[4:] || '_renamed.tif' as renamed,
              file_name as from_url from listed""",
        "converted_files": """
            select name || ending as file_name, name || case ending when '.b.c' then '.b.tif' else '.tif' end as converted
            from (select 'N' || p_partkey as name, (['.hgt.zip', '.hgt', '.zip', '.b.c', ''])[(p_partkey % 5 + 1)::int] as ending from part)""",
        "flag_bad_tiles": _MANIFEST + """
            select distinct tile, right(tile, 2) = '37' as is_bad,
              case when right(tile, 2) = '37' then tile || '.SRTMGL1.repacked.hgt.zip' end as repacked_name from listed""",
        "analysis_names": """
            with c as (select c_custkey, c_custkey || ' Main St., Apt #' || (c_custkey % 7) || ', Old-Town_' || c_name as address,
                (['all', 'paved', 'dirt'])[(c_custkey % 3 + 1)::int] as kind, (c_custkey % 50 + 0.25)::double as radius from customer)
            select c_custkey, left(regexp_replace(address || '_' || kind || '_' || replace(radius::varchar, '.', '') || 'km', '[^A-Za-z0-9_-]', '', 'g'), 40) as analysis_id,
              'climbs_' || case when c_custkey % 2 = 0 then left(replace(regexp_replace(address, '[^A-Za-z0-9 _-]', '', 'g'), ' ', '_'), 50)
                else replace(address, ' ', '_') end || '_' || kind || '_' || case when c_custkey % 2 = 0 then 'address' else 'state' end
                || '_' || floor(radius)::bigint || 'km' as export_name,
              round(radius * 0.621371, 6) as radius_mi, round(radius * 3.28084, 6) as radius_ft
            from c""",
        "remaining_chunks": _STATUS + """
            select analysis_id, c::int as chunk_index from analysis, range(100) r(c)
            where (analysis_id, c) not in (select (analysis_id, chunk_index) from done)""",
        "saved_chunks": _STATUS + "select analysis_id, chunk_index from done",
        "analysis_progress": _STATUS + "select analysis_id, completed, total, round(percentage, 6)::double as percentage from progress",
        "resumable_analyses": _STATUS + "select * from resumable",
        "find_resumable": _STATUS + "select * from resumable order by analysis_id desc limit 1",
    }
    sql["report_roundtrip"] = sql["single_way_report"]
    for kind, where in _FILTERS.items():
        sql[f"filter_{kind}"] = ways + f"select way_id from way where {where}"
    return sql
