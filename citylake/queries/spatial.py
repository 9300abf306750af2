"""Geometry, spatial join, network, heat and layer queries on the derived city tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citylake.functions import geometry as G
from citylake.operators import heat as U
from citylake.operators import layers as L
from citylake.operators import spatial as J
from citylake.operators import water as W
from citylake.plans import imports as I
from citylake.queries.standin import City, box_hits, in_province, oracle, rnd, sql_lon_lat, sql_rd
from citylake.sinks import geojson as K

QUERIES: dict = {}
ORACLES: dict = {}


def add(name, fn, sql=None):
    QUERIES[name] = lambda spark, sf, _f=fn: _f(City(spark, sf))
    if sql:
        ORACLES[name] = sql


def zones(t):
    return t["province"].select(F.col("id").alias("province_id"), "geom")



# --- measures -------------------------------------------------------------------------

add(
    "polygon_area",
    lambda t: t["province"].select("id", G.area("geom").alias("area")).unionByName(t["building"].select("id", G.area("geom").alias("area"))),
    oracle("province building", "SELECT id, CAST(3255000000 AS DOUBLE) AS area FROM province UNION ALL SELECT id, CAST(1600 AS DOUBLE) FROM building"),
)
add(
    "line_length",
    lambda t: W.pipe_derived(t["pipe"]).select("id", F.round("length_km", 6).alias("length_km")),
    oracle("pipe", f"SELECT id, {rnd('(x2 - x1) / 1000', 6)} AS length_km FROM pipe"),
)
add(
    "feature_centroid",
    lambda t: t["building"].select("id", G.centroid("geom").alias("c")).unionByName(t["street"].select("id", G.centroid("geom").alias("c"))).select(
        "id", F.round("c.x", 4).alias("x"), F.round("c.y", 4).alias("y")
    ),
    oracle("building street", f"SELECT id, {rnd('x + 20', 4)} AS x, {rnd('y + 20', 4)} AS y FROM building UNION ALL SELECT id, {rnd('x', 4)}, {rnd('y + 100', 4)} FROM street"),
)
add(
    "feature_envelope",
    lambda t: t["building"].select("id", "geom.bbox.*"),
    oracle("building", "SELECT id, x AS xmin, y AS ymin, x + 40 AS xmax, y + 40 AS ymax FROM building"),
)
add(
    "single_to_multi",
    lambda t: t["building"].select("id", "geom").unionByName(t["street"].select("id", "geom")).select(
        "id", F.col("geom.kind").alias("kind"), G.to_multi("geom", G.POLYGON).isNotNull().alias("usable"), F.size("geom.parts").alias("parts")
    ),
    oracle(
        "building street",
        "SELECT id, 'POLYGON' AS kind, true AS usable, CAST(1 AS INT) AS parts FROM building UNION ALL SELECT id, 'LINE', false, CAST(1 AS INT) FROM street",
    ),
)
_lon, _lat = sql_lon_lat("x", "y")
_bx, _by = sql_rd("lon", "lat")


def _reproject(t):
    moved = t["well"].select("id", G.transform_geom("geom", G.WGS84).alias("w"))
    back = moved.select("id", "w", G.transform_geom("w", G.RD).alias("b"))
    return back.select(
        "id", F.round("w.bbox.xmin", 9).alias("lon"), F.round("w.bbox.ymin", 9).alias("lat"),
        F.round("b.bbox.xmin", 3).alias("x"), F.round("b.bbox.ymin", 3).alias("y"), F.col("b.srid").alias("srid"),
    )


add(
    "reprojection",
    _reproject,
    oracle(
        "well",
        f"SELECT id, {rnd('lon', 9)} AS lon, {rnd('lat', 9)} AS lat, {rnd(_bx, 3)} AS x, {rnd(_by, 3)} AS y, CAST(28992 AS INT) AS srid FROM m",
        m=f"SELECT id, {_lon} AS lon, {_lat} AS lat FROM well",
    ),
)
add(
    "missing_srid",
    lambda t: t["building"].withColumn("geom", F.col("geom").withField("srid", F.when(F.col("id") % 2 == 0, F.col("geom.srid")))).select(
        "id", G.with_srid("geom", G.WGS84).alias("geom")
    ).select("id", "geom.srid"),
    oracle("building", "SELECT id, CAST(CASE WHEN id % 2 = 0 THEN 28992 ELSE 4326 END AS INT) AS srid FROM building"),
)

# --- filters and sinks ----------------------------------------------------------------

_BOX = (4.75, 51.7, 5.6, 52.4)
_c0 = G.project_point(_BOX[0], _BOX[1], G.WGS84, G.RD)
_c1 = G.project_point(_BOX[2], _BOX[3], G.WGS84, G.RD)
add(
    "bounding_box_filter",
    lambda t: L.clip_to_box(t["building"], _BOX, G.WGS84, G.RD).select("id"),
    oracle("building", f"SELECT id FROM building WHERE x <= {_c1[0]!r} AND x + 40 >= {_c0[0]!r} AND y <= {_c1[1]!r} AND y + 40 >= {_c0[1]!r}"),
)
add(
    "contains_point",
    lambda t: t["building"].select("id", "x", "y", G.contains_point("geom", "x + id % 60", "y + 20").alias("inside")).select("id", "inside"),
    oracle("building", "SELECT id, id % 60 > 0 AND id % 60 < 40 AS inside FROM building"),
)
add(
    "geojson_export",
    lambda t: K.to_geojson(t["well"].select("id", "is_active", "geom")).select(
        F.get_json_object("feature", "$.properties.id").cast("long").alias("id"),
        F.get_json_object("feature", "$.geometry.type").alias("type"),
        F.get_json_object("feature", "$.properties.is_active").alias("active"),
        F.round(F.get_json_object("feature", "$.geometry.coordinates[0][0]").cast("double"), 8).alias("lon"),
        F.round(F.get_json_object("feature", "$.geometry.coordinates[0][1]").cast("double"), 8).alias("lat"),
    ),
    oracle(
        "well",
        f"SELECT id, 'MultiPoint' AS type, CASE WHEN is_active THEN 'true' ELSE 'false' END AS active, {rnd(_lon, 8)} AS lon, {rnd(_lat, 8)} AS lat FROM well",
    ),
)


def _corner(i):
    xs = {0: ("x0", "y0"), 1: ("x0 + 20000", "y0"), 2: ("x0 + 20000", "y0 + 30000"), 3: ("x0", "y0 + 30000")}
    return sql_lon_lat(*[f"({v})" for v in xs[i]])


_corners = [_corner(i) for i in range(4)]
add(
    "city_picker",
    lambda t: K.city_picker(t["city"]).select(
        "id", "name", *[F.round(F.col("bbox")[i], 8).alias(n) for i, n in enumerate(("west", "south", "east", "north"))],
        F.get_json_object("feature", "$.geometry.type").alias("type"),
    ),
    oracle(
        "city",
        f"""SELECT id, name, {rnd(f"least({', '.join(c[0] for c in _corners)})", 8)} AS west, {rnd(f"least({', '.join(c[1] for c in _corners)})", 8)} AS south,
              {rnd(f"greatest({', '.join(c[0] for c in _corners)})", 8)} AS east, {rnd(f"greatest({', '.join(c[1] for c in _corners)})", 8)} AS north, 'MultiPolygon' AS type FROM city""",
    ),
)

# --- joins ----------------------------------------------------------------------------

add(
    "join_points_polygons",
    lambda t: J.spatial_join(t["nbs_point"], zones(t), "id", "province_id"),
    oracle("province nbs_point", f"SELECT n.id, p.id AS province_id FROM nbs_point n JOIN province p ON {in_province('n.x', 'n.y')}"),
)
add(
    "join_lines_polygons",
    lambda t: J.spatial_join(t["street"], zones(t), "id", "province_id"),
    oracle("province street", f"SELECT s.id, p.id AS province_id FROM street s JOIN province p ON {box_hits('s.x', 's.y', 's.x', 's.y + 200')}"),
)
add(
    "join_polygons_polygons",
    lambda t: J.spatial_join(t["building"], zones(t), "id", "province_id"),
    oracle("province building", f"SELECT b.id, p.id AS province_id FROM building b JOIN province p ON {box_hits('b.x', 'b.y', 'b.x + 40', 'b.y + 40')}"),
)
add(
    "join_parks_buildings",
    lambda t: J.spatial_join(t["building"], t["park"].select(F.col("id").alias("park_id"), "geom"), "id", "park_id"),
    oracle(
        "building park",
        """SELECT b.id, k.id AS park_id FROM building b JOIN park k
           ON b.x <= k.x + 300 AND b.x + 40 >= k.x AND b.y <= k.y + 300 AND b.y + 40 >= k.y""",
    ),
)
add(
    "assign_by_centroid",
    lambda t: J.assign_by_centroid(t["fresh_water"], zones(t), "id", "province_id").select("id", "province_id", "matches"),
    oracle(
        "province fresh_water",
        f"""SELECT f.id, min(p.id) AS province_id, count(p.id) AS matches FROM fresh_water f LEFT JOIN province p ON {in_province('f.x0 + 14000.5', 'f.y0 + 14000.5')} GROUP BY 1""",
    ),
)
add(
    "assign_parent",
    lambda t: I.assign_parent(t["neighborhood"].select("id", "geom"), t["city"], "city_id").select("id", "city_id"),
    oracle(
        "neighborhood city",
        """SELECT n.id, CASE WHEN count(c.id) = 1 THEN min(c.id) END AS city_id FROM neighborhood n LEFT JOIN city c
           ON n.x + 200 > c.x0 AND n.x + 200 < c.x0 + 20000 AND n.y + 200 > c.y0 AND n.y + 200 < c.y0 + 30000 GROUP BY n.id""",
    ),
)
_D = 500
_near = "pow(greatest(0, n.x - p.x2, p.x1 - (n.x + 400)), 2) + pow(greatest(0, n.y - p.y, p.y - (n.y + 400)), 2)"
add(
    "pipes_near_neighborhoods",
    lambda t: J.distance_join(t["pipe"], t["neighborhood"].select(F.col("id").alias("neighborhood_id"), "geom"), "id", "neighborhood_id", _D),
    oracle("pipe neighborhood", f"SELECT p.id, n.id AS neighborhood_id FROM pipe p JOIN neighborhood n ON {_near} <= {_D * _D}"),
)
_STEP = 100
_grid = f"""SELECT DISTINCT g, c.col, r.row FROM (SELECT area_id AS g, x1, x2, y FROM pipe) p,
      unnest(range(CAST(floor((y - {_D}) / {_STEP}) AS BIGINT), CAST(floor((y + {_D}) / {_STEP}) AS BIGINT) + 1)) AS r(row),
      unnest(range(CAST(floor((x1 - {_D}) / {_STEP}) AS BIGINT), CAST(floor((x2 + {_D}) / {_STEP}) AS BIGINT) + 1)) AS c(col)
    WHERE pow(greatest(0, x1 - (c.col * {_STEP} + {_STEP / 2}), (c.col * {_STEP} + {_STEP / 2}) - x2), 2) + pow(r.row * {_STEP} + {_STEP / 2} - y, 2) <= {_D * _D}"""
add(
    "pipe_buffer_area",
    lambda t: J.buffer_area(t["pipe"], "area_id", _D, _STEP),
    oracle("pipe", f"SELECT g AS area_id, count(*) * CAST({_STEP * _STEP} AS DOUBLE) AS area FROM ({_grid}) GROUP BY 1"),
)
_over = lambda a, b: f"greatest(0, least(k.x2, {b}) - greatest(k.x1, {a}))"
_clip = f"""sum({_over('p.x0', 'CASE WHEN k.y < 475000 THEN p.x0 + 30000 ELSE p.x0 + 15000 END')}
    - CASE WHEN k.y > 420000 AND k.y < 440000 THEN {_over('p.x0 + 3000', 'p.x0 + 9000')} ELSE 0 END)"""
add(
    "water_network_length",
    lambda t: W.network_length(t["pipe"], t["province"]).select("province_id", F.round("network_km", 6).alias("network_km")),
    oracle("province pipe", f"SELECT p.id AS province_id, {rnd(f'{_clip} / 1000', 6)} AS network_km FROM province p CROSS JOIN pipe k GROUP BY 1"),
)
_crossing = "k.x1 <= c.x0 + 20000 AND k.x2 >= c.x0 AND k.y >= c.y0 AND k.y <= c.y0 + 30000"
_cov_step = 200
_cov_grid = _grid.replace(f"{_STEP / 2}", f"{_cov_step / 2}").replace(f"/ {_STEP})", f"/ {_cov_step})").replace(f"* {_STEP} ", f"* {_cov_step} ").replace(
    "(SELECT area_id AS g, x1, x2, y FROM pipe) p", "(SELECT city_id AS g, x1, x2, y FROM lines) p"
)
add(
    "water_coverage_build",
    lambda t: W.build_coverage(t["city"], t["pipe"], t["users_location"], t["neighborhood"], t["bridge"], _D, _cov_step),
    oracle(
        "city bridge pipe users_location",
        f"""SELECT c.id AS city_id, {rnd(f'coalesce(a.n, 0) * {_cov_step * _cov_step} / 1e6', 4)} AS area_km2, coalesce(v.cov, 0) AS covered, coalesce(h.tot, 0) AS total,
              coalesce({rnd('CAST(coalesce(v.cov, 0) AS DOUBLE) / nullif(h.tot, 0) * 100', 1)}, 0) AS pct
            FROM city c LEFT JOIN (SELECT g, count(*) AS n FROM cells GROUP BY 1) a ON a.g = c.id
            LEFT JOIN (SELECT city_id, CAST(sum(u) AS BIGINT) AS tot FROM homes GROUP BY 1) h ON h.city_id = c.id
            LEFT JOIN (SELECT city_id, CAST(sum(u) AS BIGINT) AS cov FROM homes h WHERE EXISTS (SELECT 1 FROM lines p JOIN neighborhood n ON n.id = h.neighborhood_id
              WHERE p.city_id = h.city_id AND {_near} <= {_D * _D}) GROUP BY 1) v ON v.city_id = c.id""",
        ends="SELECT b.city_id, k.* FROM pipe k JOIN users_location u ON k.destination_id = u.id JOIN bridge b ON u.neighborhood_id = b.neighborhood_id",
        lines=f"""SELECT city_id, x1, x2, y FROM ends UNION ALL SELECT c.id, k.x1, k.x2, k.y FROM city c JOIN pipe k ON {_crossing}
                  WHERE c.id NOT IN (SELECT city_id FROM ends)""",
        homes="SELECT b.city_id, b.neighborhood_id, sum(u.users_total) AS u FROM users_location u JOIN bridge b ON u.neighborhood_id = b.neighborhood_id GROUP BY 1, 2",
        cells=_cov_grid,
    ),
)

# --- heat -----------------------------------------------------------------------------

_PARK = f"SELECT p.id AS province_id, sum(k.area) AS v FROM province p JOIN park k ON {box_hits('k.x', 'k.y', 'k.x + 300', 'k.y + 300')} GROUP BY 1"
_LC = """SELECT province_id, sum(percentage) AS v FROM land_cover l JOIN land_cover_class c ON l.class_id = c.id
    WHERE regexp_matches(lower(c.class_name), 'forest|grass|green|vegetation|tree|park|nature') GROUP BY 1"""
_GREEN = f"""SELECT p.id AS province_id, p.area_km2, {rnd('coalesce(k.v, 0) / 1e6', 3)} AS park_area_km2, {rnd('coalesce(p.area_km2, 0) * coalesce(l.v, 0) / 100', 3)} AS green_lc_km2,
    {rnd('coalesce(k.v, 0) / 1e6 + coalesce(p.area_km2, 0) * coalesce(l.v, 0) / 100', 3)} AS total_green_km2
    FROM province p LEFT JOIN park_sum k ON k.province_id = p.id LEFT JOIN lc ON lc.province_id = p.id""".replace("l.v", "lc.v")
add(
    "heat_green_area",
    lambda t: U.green_area(t["park"], t["land_cover"], t["land_cover_class"], t["province"]),
    oracle("province park land_cover land_cover_class", "SELECT province_id, park_area_km2, green_lc_km2, total_green_km2 FROM g", park_sum=_PARK, lc=_LC, g=_GREEN),
)
add(
    "heat_vegetation",
    lambda t: U.vegetation_coverage(t["park"], t["land_cover"], t["land_cover_class"], t["province"]),
    oracle(
        "province park land_cover land_cover_class",
        f"""SELECT province_id, park_area_km2, green_lc_km2, total_green_km2,
              CASE WHEN area_km2 > 0 THEN {rnd('total_green_km2 / nullif(area_km2, 0) * 100', 1)} ELSE 0 END AS vegetation_coverage_pct FROM g""",
        park_sum=_PARK, lc=_LC, g=_GREEN,
    ),
)
add(
    "heat_morphology",
    lambda t: U.urban_morphology(t["building"], t["street"], t["province"]),
    oracle(
        "province building street",
        f"""SELECT p.id AS province_id, coalesce(b.n, 0) AS building_count, {rnd('coalesce(b.h, 0)', 1)} AS avg_building_height_m, {rnd('coalesce(b.m, 0)', 1)} AS max_building_height_m,
              {rnd('coalesce(b.f, 0) / 1e6', 3)} AS total_footprint_km2, coalesce(s.n, 0) AS street_count, {rnd('coalesce(s.w, 0)', 1)} AS avg_street_width_m,
              {rnd('coalesce(b.h, 0) / CASE WHEN coalesce(s.w, 0) <> 0 THEN s.w ELSE 1 END', 2)} AS aspect_ratio
            FROM province p LEFT JOIN (SELECT p.id AS k, count(*) AS n, avg(height) AS h, max(height) AS m, sum(footprint) AS f FROM province p JOIN building b
                ON {box_hits('b.x', 'b.y', 'b.x + 40', 'b.y + 40')} GROUP BY 1) b ON b.k = p.id
            LEFT JOIN (SELECT p.id AS k, count(*) AS n, avg(width) AS w FROM province p JOIN street s ON {box_hits('s.x', 's.y', 's.x', 's.y + 200')} GROUP BY 1) s ON s.k = p.id""",
    ),
)
add(
    "heat_nature_based_solutions",
    lambda t: U.nbs_coverage(t["nbs_polygon"], t["nbs_point"], t["province"]),
    oracle(
        "province nbs_polygon nbs_point",
        f"""SELECT p.id AS province_id, coalesce(a.n, 0) AS polygon_count, coalesce(b.n, 0) AS point_count, coalesce(a.n, 0) + coalesce(b.n, 0) AS total_count,
              {rnd('coalesce(a.s, 0) / 1e6', 4)} AS total_area_km2, {rnd('coalesce(a.s, 0)', 1)} AS total_area_m2
            FROM province p LEFT JOIN (SELECT p.id AS k, count(*) AS n, sum(a.area) AS s FROM province p JOIN nbs_polygon a ON {box_hits('a.x', 'a.y', 'a.x + 150', 'a.y + 150')} GROUP BY 1) a ON a.k = p.id
            LEFT JOIN (SELECT p.id AS k, count(*) AS n FROM province p JOIN nbs_point b ON {in_province('b.x', 'b.y')} GROUP BY 1) b ON b.k = p.id""",
    ),
)
add(
    "heat_latest_meteorology",
    lambda t: U.latest_meteorology(t["measurement"], t["station"], t["province"]).withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS")),
    oracle(
        "province station measurement",
        f"""SELECT p.id AS province_id, temperature, humidity, wind, precipitation, radiation, strftime(m.date, '%Y-%m-%d %H:%M:%S.%f') AS date
            FROM province p LEFT JOIN (SELECT p.id AS k, m.* FROM province p JOIN station s ON s.is_active AND {in_province('s.x', 's.y')} JOIN measurement m ON m.station_id = s.id
              QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY m.date DESC, s.id DESC) = 1) m ON m.k = p.id""",
    ),
)

# --- layers ---------------------------------------------------------------------------


def _layers(t):
    return [
        ("builtup", "building", t["building"]), ("builtup", "street", t["street"]), ("builtup", "park", t["park"]),
        ("watersupply", "pipe", t["pipe"]), ("watersupply", "well", t["well"]), ("common", "neighborhood", t["neighborhood"]),
        ("urban_heat", "land_cover", t["land_cover"]),
    ]


def _inventory(t):
    rasters = t["raster_meta"].select("id", F.lit("weather").alias("app"), F.col("kind").alias("model"), "name", "product_path")
    return L.layer_inventory(_layers(t), rasters)


_LAYER_SQL = " UNION ALL ".join(
    f"SELECT '{app}.{n}' AS key, '{app}' AS app, {'NULL' if kind is None else repr(kind)} AS kind, '{L.PALETTE[i]}' AS color, '{n.replace("_", " ").title()}' AS display_name, count(*) AS count FROM {n}"
    for i, (app, n, kind) in enumerate(
        [("builtup", "building", "polygon"), ("builtup", "street", "line"), ("builtup", "park", "polygon"), ("watersupply", "pipe", "line"),
         ("watersupply", "well", "point"), ("common", "neighborhood", "polygon"), ("urban_heat", "land_cover", None)]
    )
)
_RASTER_SQL = "SELECT concat('raster-weather-', kind, '-', id) AS key, 'weather' AS app, 'raster' AS kind, '#ff6b6b' AS color, name AS display_name, CAST(1 AS BIGINT) AS count FROM raster_meta WHERE product_path IS NOT NULL"
_LAYER_TABLES = "building street park pipe well neighborhood land_cover raster_meta"
add("layer_inventory", _inventory, oracle(_LAYER_TABLES, f"{_LAYER_SQL} UNION ALL {_RASTER_SQL}"))
add(
    "layer_extent",
    lambda t: L.layer_extent(t["building"]),
    oracle("building", "SELECT min(x) AS xmin, min(y) AS ymin, max(x + 40) AS xmax, max(y + 40) AS ymax FROM building"),
)
add(
    "layer_counts",
    lambda t: L.layer_counts(_inventory(t), ["builtup.park", "watersupply.well"]),
    oracle(
        _LAYER_TABLES,
        "SELECT count(*) AS layers, CAST(sum(count) AS BIGINT) AS features, count(*) FILTER (WHERE key IN ('builtup.park', 'watersupply.well')) AS visible FROM i",
        i=f"{_LAYER_SQL} UNION ALL {_RASTER_SQL}",
    ),
)
add(
    "layers_by_app",
    lambda t: L.layers_by_app(_inventory(t)),
    oracle(_LAYER_TABLES, "SELECT app, key, display_name, count(*) OVER (PARTITION BY app) AS layers FROM i", i=f"{_LAYER_SQL} UNION ALL {_RASTER_SQL}"),
)
def _themes(t):
    """Every theme with its layers; an urban heat layer is there for the temperature theme."""
    inventory = _inventory(t)
    themes = [L.layers_for_theme(inventory, k).select(F.lit(k).alias("theme"), "key", "count") for k in L.THEMES]
    out = themes[0]
    for x in themes[1:]:
        out = out.unionByName(x)
    return out


add(
    "layers_for_theme",
    _themes,
    oracle(
        _LAYER_TABLES,
        """SELECT theme, key, count FROM i JOIN (VALUES ('common', 'common'), ('temperature', 'temperature'), ('temperature', 'heat'), ('temperature', 'weather'),
             ('temperature', 'urban_heat'), ('builtup', 'builtup'), ('energy', 'Energy'), ('housing', 'housing'), ('green', 'green'), ('green', 'vegetation'),
             ('green', 'trees'), ('green', 'Park'), ('green', 'LandCover'), ('water', 'watersupply'), ('groundwater', 'groundwater')) AS v(theme, app) USING (app)""",
        i=f"{_LAYER_SQL} UNION ALL {_RASTER_SQL}"),
)
