"""Raster queries on cell tables derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citylake.functions import geometry as G
from citylake.operators import heat as U
from citylake.operators import raster as R
from citylake.operators import spatial as J
from citylake.queries.standin import City, box_hits, in_province, oracle, rnd, sql_lon_lat, sql_rd
from citylake.sources import files

QUERIES: dict = {}
ORACLES: dict = {}


def add(name, fn, sql=None):
    QUERIES[name] = lambda spark, sf, _f=fn: _f(City(spark, sf))
    if sql:
        ORACLES[name] = sql


def zones(t):
    return t["province"].select(F.col("id").alias("province_id"), "geom")


# --- zonal statistics -----------------------------------------------------------------

_STATS = f"""min(c.value) AS min, max(c.value) AS max, {rnd('avg(c.value)', 2)} AS mean, {rnd('stddev_pop(c.value)', 2)} AS stddev, count(c.value) AS count"""
_HIT = f"FROM province p JOIN cells c ON c.value IS NOT NULL AND {in_province('c.x', 'c.y')}"
add(
    "cells_in_zones",
    lambda t: J.point_join(t["cells"], zones(t), "province_id", alias="province_id").select("raster_id", "col", "row", "province_id"),
    oracle("province cells", f"SELECT raster_id, col, row, p.id AS province_id FROM province p JOIN cells c ON {in_province('c.x', 'c.y')}"),
)
add(
    "zonal_statistics",
    lambda t: R.zonal_stats(t["cells"], zones(t), "province_id"),
    oracle("province cells", f"SELECT p.id AS province_id, c.raster_id, {_STATS} {_HIT} GROUP BY 1, 2"),
)
_EXT = """SELECT raster_id, min(x) - coalesce((max(x) - min(x)) / nullif(max(col) - min(col), 0) / 2, 0) AS xmin, min(y) - coalesce((max(y) - min(y)) / nullif(max(row) - min(row), 0) / 2, 0) AS ymin,
    max(x) + coalesce((max(x) - min(x)) / nullif(max(col) - min(col), 0) / 2, 0) AS xmax, max(y) + coalesce((max(y) - min(y)) / nullif(max(row) - min(row), 0) / 2, 0) AS ymax FROM cells GROUP BY 1"""
_LATEST = f"""SELECT p.id AS province_id, r.kind, e.raster_id FROM province p JOIN e ON {box_hits('e.xmin', 'e.ymin', 'e.xmax', 'e.ymax')} JOIN heat_raster r ON r.id = e.raster_id
    QUALIFY row_number() OVER (PARTITION BY p.id, r.kind ORDER BY r.date_time DESC, e.raster_id DESC) = 1"""
add(
    "heat_thermal_indices",
    lambda t: U.thermal_indices(t["cells"], t["heat_raster"], t["province"]),
    oracle(
        "province cells heat_raster",
        f"SELECT l.province_id, l.kind, l.raster_id, s.* EXCLUDE (province_id, raster_id) FROM l JOIN s ON s.province_id = l.province_id AND s.raster_id = l.raster_id",
        e=_EXT, l=_LATEST, s=f"SELECT p.id AS province_id, c.raster_id, {_STATS} {_HIT} GROUP BY 1, 2",
    ),
)
add(
    "latest_touching_raster",
    lambda t: U.latest_rasters(t["cells"], t["heat_raster"], t["province"]),
    oracle("province cells heat_raster", "SELECT * FROM l", e=_EXT, l=_LATEST),
)

# --- grids, metadata ------------------------------------------------------------------

add("raster_bounds", lambda t: R.raster_bounds(t["cells"]).select("raster_id", "bounds.bbox.*"), oracle("cells", _EXT))
add(
    "raster_bounds_filled",
    lambda t: R.fill_bounds(
        t["cells"].select(F.col("raster_id").alias("id")).distinct().withColumn("bounds", F.when(F.col("id") % 2 == 0, G.box(0.0, 1.0, 2.0, 3.0))), t["cells"]
    ).select("id", "bounds.bbox.*"),
    oracle(
        "cells",
        """SELECT raster_id AS id, CASE WHEN raster_id % 2 = 0 THEN 0 ELSE xmin END AS xmin, CASE WHEN raster_id % 2 = 0 THEN 1 ELSE ymin END AS ymin,
              CASE WHEN raster_id % 2 = 0 THEN 2 ELSE xmax END AS xmax, CASE WHEN raster_id % 2 = 0 THEN 3 ELSE ymax END AS ymax FROM ext""",
        ext=_EXT,
    ),
)
add(
    "raster_metadata",
    lambda t: files.raster_metadata(
        t["cells"],
        t["raster_meta"].groupBy((F.col("id") % 12).alias("raster_id")).agg(F.min("date").alias("load_date"), F.min("id").alias("i")).select(
            "raster_id", "load_date",
            F.when(F.col("i") % 3 == 0, F.date_format("load_date", "yyyy:MM:dd '10:20:30'")).alias("datetime_tag"),
            F.when(F.col("i") % 3 == 1, F.lit("2024-02-03")).when(F.col("i") % 3 == 2, F.lit("not a date")).alias("acquisition_date"),
        ),
    ).withColumn("date", F.col("date").cast("string")),
    oracle(
        "cells raster_meta",
        """SELECT c.raster_id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, max(col) - min(col) + 1 AS width, max(row) - min(row) + 1 AS height,
              count(*) FILTER (WHERE value IS NULL) AS nodata_cells, count(*) AS cells, any_value(CASE WHEN m.i % 3 = 1 THEN '2024-02-03' ELSE CAST(m.d AS STRING) END) AS date
           FROM cells c JOIN (SELECT id % 12 AS k, min(date) AS d, min(id) AS i FROM raster_meta GROUP BY 1) m ON m.k = c.raster_id GROUP BY 1""",
    ),
)
add(
    "interpolation_bounds",
    lambda t: R.interpolation_bounds(
        t["city"].select(
            "id", F.when(F.col("id") % 3 == 0, F.col("geom")).alias("given"), F.when(F.col("id") % 3 == 1, F.col("province_id")).alias("province_id"),
            F.when(F.col("id") % 2 == 0, F.col("geom")).alias("stored"),
        ),
        t["province"], t["station"],
    ),
    oracle(
        "city province station",
        """SELECT id, CASE k WHEN 1 THEN x0 WHEN 2 THEN px0 ELSE s.a END AS xmin, CASE k WHEN 1 THEN y0 WHEN 2 THEN 400000 ELSE s.b END AS ymin,
              CASE k WHEN 1 THEN x0 + 20000 WHEN 2 THEN px0 + 30000 ELSE s.c END AS xmax, CASE k WHEN 1 THEN y0 + 30000 WHEN 2 THEN 550000 ELSE s.d END AS ymax
           FROM (SELECT c.*, p.x0 AS px0, CASE WHEN c.id % 3 = 0 THEN 1 WHEN c.id % 3 = 1 THEN 2 WHEN c.id % 2 = 0 THEN 1 ELSE 3 END AS k FROM city c JOIN province p ON c.province_id = p.id),
             (SELECT min(x) - 5000 AS a, min(y) - 5000 AS b, max(x) + 5000 AS c, max(y) + 5000 AS d FROM station WHERE is_active) s""",
    ),
)
_boxes = lambda t: t["neighborhood"].select(F.col("id").alias("raster_id"), F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + 410).alias("xmax"), (F.col("y") + 130).alias("ymax"))
add(
    "interpolation_grid",
    lambda t: R.make_grid(_boxes(t), 60.0).drop("tile"),
    oracle(
        "neighborhood",
        "SELECT id AS raster_id, c.col, r.row, x + c.col * 60 AS x, y + r.row * 60 AS y FROM neighborhood, unnest(range(7)) AS c(col), unnest(range(3)) AS r(row)",
    ),
)

# --- interpolation --------------------------------------------------------------------


def _requests(t):
    """Noon of every day that has measurements, numbered by date."""
    day = F.date_trunc("day", F.col("date").cast("timestamp"))
    days = t["measurement"].select(day.alias("day")).distinct()
    return days.select(F.datediff("day", F.lit("2020-01-01")).cast("long").alias("raster_id"), (F.col("day") + F.expr("INTERVAL 12 HOURS")).alias("at"))


def _values(t, field="temperature"):
    return R.station_values(t["measurement"], t["station"], field, _requests(t))


_REQ = "SELECT DISTINCT date_diff('day', DATE '2020-01-01', CAST(date AS DATE)) AS raster_id, date_trunc('day', date) + INTERVAL 12 HOUR AS at FROM measurement"
_VAL = """SELECT r.raster_id, m.station_id, s.x, s.y, avg(m.temperature) AS value FROM req r JOIN measurement m ON m.temperature IS NOT NULL
      AND m.date BETWEEN r.at - INTERVAL 1 HOUR AND r.at + INTERVAL 1 HOUR JOIN station s ON s.id = m.station_id AND s.is_active GROUP BY 1, 2, 3, 4"""
_BOUNDS = (100000.0, 400000.0, 250000.0, 550000.0)


def _bounds(t):
    names = ("xmin", "ymin", "xmax", "ymax")
    return _values(t).select("raster_id").distinct().select("raster_id", *[F.lit(v).alias(n) for v, n in zip(_BOUNDS, names)])


add("station_values", lambda t: _values(t), oracle("measurement station", "SELECT * FROM val", req=_REQ, val=_VAL))
add(
    "rasters_without_values",
    lambda t: R.missing_rasters(_requests(t), _values(t)).select("raster_id"),
    oracle("measurement station", "SELECT raster_id FROM req WHERE raster_id NOT IN (SELECT raster_id FROM val)", req=_REQ, val=_VAL),
)
add(
    "raster_sources",
    lambda t: R.raster_sources(_values(t)),
    oracle("measurement station", "SELECT DISTINCT raster_id, station_id FROM val", req=_REQ, val=_VAL),
)
_IDW = f"""SELECT v.raster_id, c.col, r.row, {_BOUNDS[0]} + c.col * 10000 AS x, {_BOUNDS[1]} + r.row * 10000 AS y,
      sum(v.value / (sqrt(pow({_BOUNDS[0]} + c.col * 10000 - v.x, 2) + pow({_BOUNDS[1]} + r.row * 10000 - v.y, 2)) + 1e-10))
      / sum(1 / (sqrt(pow({_BOUNDS[0]} + c.col * 10000 - v.x, 2) + pow({_BOUNDS[1]} + r.row * 10000 - v.y, 2)) + 1e-10)) AS value
    FROM val v, unnest(range(15)) AS c(col), unnest(range(15)) AS r(row) GROUP BY 1, 2, 3"""
add(
    "interpolate_idw",
    lambda t: R.interpolate_idw(_bounds(t), _values(t), 10000.0).withColumn("value", F.round("value", 6)),
    oracle("measurement station", f"SELECT raster_id, col, row, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, {rnd('value', 6)} AS value FROM idw", req=_REQ, val=_VAL, idw=_IDW),
)
add(
    "raster_summary",
    lambda t: R.raster_summary(
        t["cells"], t["cells"].select("raster_id", F.col("col").alias("station_id")).distinct(),
        t["heat_raster"].select(F.col("id").alias("raster_id"), F.when(F.col("kind") == "lst", "temperature").otherwise("wind").alias("field")),
    ),
    oracle(
        "cells heat_raster",
        """SELECT r.id AS raster_id, CASE WHEN r.kind = 'lst' THEN 'temperature' ELSE 'wind' END AS field, s.min, s.max, s.mean, s.num_stations, e.xmin, e.ymin, e.xmax, e.ymax,
              CASE WHEN r.kind = 'lst' THEN '°C' ELSE 'm/s' END AS unit
           FROM heat_raster r JOIN (SELECT raster_id, min(value) AS min, max(value) AS max, avg(value) AS mean, count(DISTINCT col) AS num_stations FROM cells GROUP BY 1) s ON s.raster_id = r.id
           JOIN e ON e.raster_id = r.id""",
        e=_EXT,
    ),
)

# --- reprojection, pyramids -----------------------------------------------------------

_lon, _lat = sql_lon_lat("(x + 700)", "(y + 130)")
_rx, _ry = sql_rd("x", "y")


def _target(t):
    """Positions in WGS84 a little off the source cells."""
    p = G.project_xy("x + 700", "y + 130", G.RD, G.WGS84)
    return t["cells"].select("raster_id", "col", "row", p.alias("p")).select("raster_id", "col", "row", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def _reproject(t, method):
    out = R.reproject_cells(t["cells"], _target(t), G.RD, G.WGS84, method)
    return out.select("raster_id", "col", "row", F.round("value", 4).alias("value"))


_TGT = f"SELECT raster_id, col, row, {_lon} AS x, {_lat} AS y FROM cells"
_SIZE = """SELECT raster_id, min(x) AS x0, min(y) AS y0, min(col) AS c0, min(row) AS r0, coalesce((max(x) - min(x)) / nullif(max(col) - min(col), 0), 1) AS dx,
    coalesce((max(y) - min(y)) / nullif(max(row) - min(row), 0), 1) AS dy FROM cells GROUP BY 1"""
_POS = f"SELECT g.raster_id, g.col, g.row, ({_rx} - x0) / dx + c0 AS fc, ({_ry} - y0) / dy + r0 AS fr FROM tgt g JOIN size s ON s.raster_id = g.raster_id"
_pick = lambda dc, dr, w: f"SELECT raster_id, col, row, CAST(floor(fc) AS BIGINT) + {dc} AS c, CAST(floor(fr) AS BIGINT) + {dr} AS r, {w} AS w FROM pos"
_U, _V = "(fc - floor(fc))", "(fr - floor(fr))"
_WANT = " UNION ALL ".join(
    [_pick(0, 0, f"(1 - {_U}) * (1 - {_V})"), _pick(1, 0, f"{_U} * (1 - {_V})"), _pick(0, 1, f"(1 - {_U}) * {_V}"), _pick(1, 1, f"{_U} * {_V}")]
)
_SAMPLED = f"""SELECT n.raster_id, n.col, n.row, {rnd('sum(n.w * s.value) / sum(n.w)', 4)} AS value FROM want n
    JOIN cells s ON s.raster_id = n.raster_id AND s.col = n.c AND s.row = n.r AND s.value IS NOT NULL WHERE n.w > 0 GROUP BY 1, 2, 3"""
add(
    "reproject_bilinear",
    lambda t: _reproject(t, "bilinear"),
    oracle("cells", _SAMPLED, tgt=_TGT, size=_SIZE, pos=_POS, want=_WANT),
)
add(
    "reproject_nearest",
    lambda t: _reproject(t, "nearest"),
    oracle(
        "cells", _SAMPLED, tgt=_TGT, size=_SIZE, pos=_POS,
        want="SELECT raster_id, col, row, CAST(floor(fc + 0.5) AS BIGINT) AS c, CAST(floor(fr + 0.5) AS BIGINT) AS r, 1 AS w FROM pos",
    ),
)
add(
    "raster_missing_srid",
    lambda t: t["raster_meta"].select(
        "id", F.coalesce(F.when(F.col("id") % 3 == 0, F.lit(4326)), F.when(F.col("id") % 3 == 1, F.lit(3857)), F.lit(G.RD)).alias("srid")
    ),
    oracle("raster_meta", "SELECT id, CAST(CASE id % 3 WHEN 0 THEN 4326 WHEN 1 THEN 3857 ELSE 28992 END AS INT) AS srid FROM raster_meta"),
)
add(
    "overview_pyramid",
    lambda t: R.overviews(t["cells"]),
    oracle(
        "cells",
        """SELECT raster_id, CAST(k AS INT) AS level, col // CAST(pow(2, k) AS BIGINT) AS col, row // CAST(pow(2, k) AS BIGINT) AS row,
              arg_min_null(value, row * 4294967296 + col) AS value FROM cells, unnest([1, 2, 3, 4, 5, 6]) AS l(k) GROUP BY ALL""",
    ),
)

# --- bands ----------------------------------------------------------------------------

_wide = lambda *bands: ", ".join(f"max(value) FILTER (WHERE band = '{b}') AS {b}" for b in bands)


def _index(name):
    a, b = R.INDEX_BANDS[name]
    return oracle(
        "band_cells",
        f"""SELECT raster_id, col, row, ({a} - {b}) / nullif({a} + {b}, 0) AS value
            FROM (SELECT raster_id, col, row, {_wide(a, b)} FROM band_cells WHERE band IN ('{a}', '{b}') GROUP BY 1, 2, 3)""",
    )


for _name, _key in (("NDVI", "index_vegetation"), ("NDWI", "index_water"), ("MOISTURE_INDEX", "index_moisture")):
    add(_key, lambda t, _n=_name: R.spectral_index(t["band_cells"], _n), _index(_name))
add(
    "true_color",
    lambda t: R.true_color(t["band_cells"]),
    oracle(
        "band_cells",
        f"""SELECT raster_id, col, row, B04 * CAST(2.5 AS DOUBLE) AS red, B03 * CAST(2.5 AS DOUBLE) AS green, B02 * CAST(2.5 AS DOUBLE) AS blue
            FROM (SELECT raster_id, col, row, {_wide('B04', 'B03', 'B02')} FROM band_cells WHERE band IN ('B04', 'B03', 'B02') GROUP BY 1, 2, 3)""",
    ),
)
add(
    "mosaic_least_cloud",
    lambda t: R.mosaic_least_cloud(t["scene"], t["band_cells"].select("raster_id", "band", "col", "row", "value"), F.to_date(F.lit("2024-01-02")), F.to_date(F.lit("2024-02-15"))),
    oracle(
        "scene band_cells",
        """SELECT band, col, row, arg_min(value, cloud_pct * 100000 + s.id) AS value FROM band_cells c JOIN scene s ON s.id = c.raster_id
           WHERE s.date BETWEEN DATE '2024-01-02' AND DATE '2024-02-15' GROUP BY 1, 2, 3""",
    ),
)
add(
    "composite_mean",
    lambda t: R.composite_mean(t["scene_cells"], F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("2000-01-01")), t["province"], "id", "label"),
    oracle(
        "province scene_cells",
        f"""SELECT band, col, row, avg(value) AS value FROM scene_cells c WHERE date >= DATE '1996-01-01' AND date < DATE '2000-01-01' AND band = 'label'
            AND EXISTS (SELECT 1 FROM province p WHERE {in_province('c.x', 'c.y')}) GROUP BY 1, 2, 3""",
    ),
)
add(
    "composite_mean_all",
    lambda t: R.composite_mean(t["scene_cells"]),
    oracle("scene_cells", "SELECT band, col, row, avg(value) AS value FROM scene_cells GROUP BY 1, 2, 3"),
)
