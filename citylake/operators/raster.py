"""Raster operators on the cell table (raster_id, date, band, col, row, x, y, value).

A raster is rows, not one blob per file: zonal statistics, pyramids and band indices are
aggregates and equi-joins on (raster, col, row), so a large raster is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylake.functions import geometry as G
from citylake.functions import scalars as S
from citylake.operators import spatial as J
from citylake.operators.select import active, in_window, with_value

# Reported unit of each measured field.
FIELD_UNITS = {"precipitation": "mm", "temperature": "°C", "wind": "m/s", "humidity": "%"}

# Bands of the normalised differences and of the true-colour composite, with its gain.
INDEX_BANDS = {"NDVI": ("B08", "B04"), "NDWI": ("B03", "B08"), "MOISTURE_INDEX": ("B8A", "B11")}
TRUE_COLOR_BANDS, TRUE_COLOR_GAIN = ("B04", "B03", "B02"), 2.5

TILE = 64
TILE_SALTS = 16
STATION_CHUNK = 512


# --- zonal statistics -----------------------------------------------------------------

def zonal_stats(
    cells: DataFrame, zones: DataFrame, zone_id: str = "zone_id", by: Sequence[str] = ("raster_id",),
    digits: int | None = 2, grid: J.Cells | None = None,
) -> DataFrame:
    """min, max, mean, population stddev and count of the cells whose centre lies in the zone; nodata is left out."""
    hit = J.point_join(with_value(cells, "value"), zones, zone_id, cells=grid, alias=zone_id)
    return statistics(hit, [zone_id, *by], digits)


def statistics(cells: DataFrame, by: Sequence[str], digits: int | None = 2) -> DataFrame:
    return cells.groupBy(*by).agg(
        S.rounded(F.min("value"), digits).alias("min"),
        S.rounded(F.max("value"), digits).alias("max"),
        S.rounded(F.avg("value"), digits).alias("mean"),
        S.rounded(F.stddev_pop("value"), digits).alias("stddev"),
        F.count("value").alias("count"),
    )


# --- grids and metadata ---------------------------------------------------------------

def raster_extent(cells: DataFrame) -> DataFrame:
    """Outer bounds per raster: cell centres widened by half the cell size."""
    t = cells.groupBy("raster_id").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        (F.max("col") - F.min("col")).alias("_nc"), (F.max("row") - F.min("row")).alias("_nr"),
    )
    hx = F.coalesce(F.try_divide(F.col("x1") - F.col("x0"), F.col("_nc")) / 2, F.lit(0.0))
    hy = F.coalesce(F.try_divide(F.col("y1") - F.col("y0"), F.col("_nr")) / 2, F.lit(0.0))
    return t.select(
        "raster_id", (F.col("x0") - hx).alias("xmin"), (F.col("y0") - hy).alias("ymin"),
        (F.col("x1") + hx).alias("xmax"), (F.col("y1") + hy).alias("ymax"),
    )


def raster_bounds(cells: DataFrame) -> DataFrame:
    """The extent as a polygon."""
    return raster_extent(cells).select(
        "raster_id", G.box("xmin", "ymin", "xmax", "ymax").alias("bounds")
    )


def fill_bounds(meta: DataFrame, cells: DataFrame) -> DataFrame:
    """Bounds taken from the cells where the raster has none."""
    b = raster_bounds(cells).withColumnsRenamed({"raster_id": "id", "bounds": "_b"})
    rest = [c for c in meta.columns if c != "bounds"]
    return meta.join(b, "id", "left").select(*rest, F.coalesce("bounds", "_b").alias("bounds"))


def interpolation_bounds(
    requests: DataFrame, province: DataFrame, stations: DataFrame, margin: float = 5000.0
) -> DataFrame:
    """Bounds of each requested raster: given geometry, else province, else stored, else active stations ± margin.

    ``requests`` has id, given, province_id and stored (given and stored are geometries).
    """
    p = province.select(F.col("id").alias("province_id"), F.col("geom.bbox").alias("_p"))
    s = active(stations).agg(
        (F.min("geom.bbox.xmin") - margin).alias("xmin"), (F.min("geom.bbox.ymin") - margin).alias("ymin"),
        (F.max("geom.bbox.xmax") + margin).alias("xmax"), (F.max("geom.bbox.ymax") + margin).alias("ymax"),
    )
    around = s.select(F.struct("xmin", "ymin", "xmax", "ymax")).scalar()
    picked = F.coalesce(F.col("given.bbox"), F.col("_p"), F.col("stored.bbox"), around)
    missing = F.raise_error(F.lit("no bounds given and no active stations")).cast("double")
    out = requests.join(p, "province_id", "left").select("id", picked.alias("_b"))
    return out.select("id", *[F.coalesce(F.col("_b")[c], missing).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def _steps(low: Column, high: Column, res: float) -> Column:
    """Number of grid positions in [low, high) at the given step."""
    return F.greatest(F.ceil((high - low) / F.lit(float(res))), F.lit(0)).cast("long")


def make_grid(bounds: DataFrame, res: float, keys: Sequence[str] = ("raster_id",)) -> DataFrame:
    """Grid positions of each bounds row, the upper ends excluded: keys, tile, col, row, x, y.

    Blocks of TILE × TILE positions are listed first and spread over the tasks, then filled, so
    one large raster does not grow inside one task.
    """
    return fill_tiles(grid_tiles(bounds, res, keys).repartition(*keys, "tile"), res, keys)


def grid_tiles(bounds: DataFrame, res: float, keys: Sequence[str] = ("raster_id",)) -> DataFrame:
    if res <= 0:
        raise ValueError("resolution must be positive")
    b = bounds.withColumn("_nx", _steps(F.col("xmin"), F.col("xmax"), res)).withColumn(
        "_ny", _steps(F.col("ymin"), F.col("ymax"), res)
    ).where((F.col("_nx") > 0) & (F.col("_ny") > 0))
    last = lambda n: F.floor((F.col(n) - 1) / TILE).cast("long")
    return (
        b.withColumn("_tx", F.explode(F.sequence(F.lit(0).cast("long"), last("_nx"))))
        .withColumn("_ty", F.explode(F.sequence(F.lit(0).cast("long"), last("_ny"))))
        .select(*keys, "xmin", "ymin", "_nx", "_ny", "_tx", "_ty", F.xxhash64("_tx", "_ty").alias("tile"))
    )


def fill_tiles(t: DataFrame, res: float, keys: Sequence[str]) -> DataFrame:
    span = lambda i, n: F.sequence(F.col(i) * TILE, F.least(F.col(i) * TILE + TILE, F.col(n)) - 1)
    cells = t.withColumn("row", F.explode(span("_ty", "_ny"))).withColumn("col", F.explode(span("_tx", "_nx")))
    return cells.select(
        *keys, "tile", "col", "row", (F.col("xmin") + F.col("col") * res).alias("x"),
        (F.col("ymin") + F.col("row") * res).alias("y"),
    )


# --- interpolation --------------------------------------------------------------------

def station_values(
    measurements: DataFrame, stations: DataFrame, field: str, requests: DataFrame | None = None,
    at: Column | None = None, hours: int = 1,
) -> DataFrame:
    """Values of active stations within ``hours`` of the wanted time: (raster_id, station_id, x, y, value).

    One instant is given by ``at``; many by ``requests`` (raster_id, at). Many instants are matched
    by hour bucket, so each measurement meets only the requests near it. Several values of a station
    inside a window are averaged.
    """
    st = active(stations).select(F.col("id").alias("station_id"), F.col("geom.bbox.xmin").alias("x"), F.col("geom.bbox.ymin").alias("y"))
    m = with_value(measurements, field).select("station_id", "date", F.col(field).alias("value"))
    if requests is None:
        m = in_window(m, "date", at, hours).withColumn("raster_id", F.lit(0))
    else:
        width = 2 * hours * 3600
        slot = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / width).cast("long")
        w = F.make_dt_interval(hours=F.lit(hours))
        r = requests.select("raster_id", "at", F.explode(F.sequence(slot(F.col("at") - w), slot(F.col("at") + w))).alias("_slot"))
        m = m.withColumn("_slot", slot(F.col("date"))).join(r, "_slot")
        m = m.where(F.col("date").between(F.col("at") - w, F.col("at") + w))
    per = m.groupBy("raster_id", "station_id").agg(F.avg("value").alias("value"))
    return per.join(st, "station_id").select("raster_id", "station_id", "x", "y", "value")


def missing_rasters(requests: DataFrame, values: DataFrame) -> DataFrame:
    """Requests for which no station value was found."""
    return requests.join(values.select("raster_id").distinct(), "raster_id", "left_anti").select(
        "raster_id", F.lit("no measurements found in the window").alias("error")
    )


def station_chunks(values: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Stations of each raster in arrays of about STATION_CHUNK entries, each repeated for every salt.

    The number of chunks follows the counted size of the group, so no array holds a whole large group.
    """
    size = values.groupBy(*keys).agg(F.ceil(F.count("*") / STATION_CHUNK).alias("_n"))
    spread = F.pmod(F.xxhash64(*values.columns), F.col("_n"))
    return (
        values.join(size, list(keys))
        .groupBy(*keys, spread.alias("_c"))
        .agg(F.collect_list(F.struct(*cols)).alias("stations"))
        .select(*keys, "stations", F.explode(F.sequence(F.lit(0), F.lit(TILE_SALTS - 1))).alias("_salt"))
    )


def interpolate_idw(bounds: DataFrame, values: DataFrame, res: float, keys: Sequence[str] = ("raster_id",)) -> DataFrame:
    """Inverse-distance weighting over all stations of the raster, power 1.

    Tiles of the grid meet chunks of stations on the raster key and a salt. The sums of a tile's cells over a
    chunk are taken inside one expression, before the cells are rows, so stations are copied for each tile and
    not for each cell; the chunks of a cell are added by a partial aggregate.
    """
    keys = list(keys)
    chunks = station_chunks(values, keys, ["x", "y", "value"])
    tiles = grid_tiles(bounds, res, keys).repartition(*keys, "tile")
    tiles = tiles.withColumn("_salt", F.pmod(F.col("tile"), F.lit(TILE_SALTS)).cast("int"))
    x, y = f"(xmin + col * {G.num(res)})", f"(ymin + row * {G.num(res)})"
    weight = f"1 / (hypot({x} - s.x, {y} - s.y) + 1e-10D)"
    add = G.let("w", weight, "named_struct('w', acc.w + w, 'v', acc.v + w * s.value)")
    sums = f"aggregate(stations, named_struct('w', 0D, 'v', 0D), (acc, s) -> {add})"
    span = lambda i, n: f"sequence({i} * {TILE}, least({i} * {TILE} + {TILE}, {n}) - 1)"
    cell = f"named_struct('col', col, 'row', row, 'x', {x}, 'y', {y}, '_s', {sums})"
    cells = f"inline(flatten(transform({span('_ty', '_ny')}, row -> transform({span('_tx', '_nx')}, col -> {cell}))))"
    part = tiles.join(chunks, [*keys, "_salt"]).selectExpr(*keys, cells)
    return part.groupBy(*keys, "col", "row", "x", "y").agg((F.sum("_s.v") / F.sum("_s.w")).alias("value"))


def raster_summary(cells: DataFrame, values: DataFrame, meta: DataFrame) -> DataFrame:
    """Summary of interpolated rasters: stations used, time, bounds, min, max, mean and unit of the field.

    ``meta`` has raster_id, at and field.
    """
    stats = cells.groupBy("raster_id").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")
    )
    used = values.groupBy("raster_id").agg(F.count("*").alias("num_stations"))
    unit = F.create_map(*[F.lit(v) for kv in FIELD_UNITS.items() for v in kv])
    return (
        meta.join(stats, "raster_id", "left").join(used, "raster_id", "left").join(raster_extent(cells), "raster_id", "left")
        .withColumn("unit", unit[F.col("field")])
    )


def raster_sources(values: DataFrame) -> DataFrame:
    """Stations behind each raster, as distinct link rows (raster_id, station_id)."""
    return values.select("raster_id", "station_id").distinct()


# --- reprojection and pyramids --------------------------------------------------------

def cell_size(cells: DataFrame) -> DataFrame:
    """Origin and step of each raster's grid, from its cell centres."""
    t = cells.groupBy("raster_id").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.min("col").alias("c0"), F.min("row").alias("r0"),
        F.max("x").alias("x1"), F.max("y").alias("y1"), F.max("col").alias("c1"), F.max("row").alias("r1"),
    )
    step = lambda a, b, n, m: F.coalesce(F.try_divide(F.col(b) - F.col(a), F.col(m) - F.col(n)), F.lit(1.0))
    return t.select("raster_id", "x0", "y0", "c0", "r0", step("x0", "x1", "c0", "c1").alias("dx"), step("y0", "y1", "r0", "r1").alias("dy"))


def reproject_cells(
    cells: DataFrame, grid: DataFrame, from_srid: int, to_srid: int, method: str = "bilinear",
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Values of ``cells`` (y ascending with row) on the positions of ``grid`` (raster_id, col, row, x, y).

    Every target position is moved back into the source system and meets its one or four source
    cells by equi-join on (raster, col, row). Bilinear weights of missing neighbours are shared
    among the known ones; a position with no known neighbour has no row. ``sizes`` gives the grids
    of the sources (see ``cell_size``); a stored table of them saves a pass over the cells and, being
    small, lets the position join be a broadcast.
    """
    if method not in ("bilinear", "nearest"):
        raise ValueError(f"unknown method {method}")
    g = grid.select("raster_id", "col", "row", "x", "y", G.project_xy("x", "y", to_srid, from_srid).alias("_p"))
    g = g.select("*", F.col("_p")[0].alias("_a"), F.col("_p")[1].alias("_b")).join(sizes if sizes is not None else cell_size(cells), "raster_id")
    fc = (F.col("_a") - F.col("x0")) / F.col("dx") + F.col("c0")
    fr = (F.col("_b") - F.col("y0")) / F.col("dy") + F.col("r0")
    if method == "nearest":
        near = [(F.floor(fc + 0.5), F.floor(fr + 0.5), F.lit(1.0))]
    else:
        c, r = F.floor(fc), F.floor(fr)
        u, v = fc - c, fr - r
        near = [(c, r, (1 - u) * (1 - v)), (c + 1, r, u * (1 - v)), (c, r + 1, (1 - u) * v), (c + 1, r + 1, u * v)]
    links = F.array(*[F.struct(i.cast("long").alias("c"), j.cast("long").alias("r"), w.alias("w")) for i, j, w in near])
    want = g.select("raster_id", "col", "row", "x", "y", F.explode(links).alias("_l")).where(F.col("_l.w") > 0).select(
        "raster_id", "col", "row", "x", "y", F.col("_l.c").alias("_c"), F.col("_l.r").alias("_r"), F.col("_l.w").alias("_w")
    )
    src = with_value(cells, "value").select(
        "raster_id", F.col("col").cast("long").alias("_c"), F.col("row").cast("long").alias("_r"), "value"
    )
    hit = want.join(src, ["raster_id", "_c", "_r"])
    return hit.groupBy("raster_id", "col", "row", "x", "y").agg(
        (F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("value")
    )


def overviews(cells: DataFrame, levels: int = 6) -> DataFrame:
    """Pyramid of ``levels`` halvings by nearest sampling: raster_id, level, col, row, value.

    The sample of a block is the value at its lowest (row, col). The first halving reads all cells;
    the others are listed from it, on a quarter of the rows, and aggregated together.
    """
    two = F.lit(2).cast("long")
    block = lambda c, level: F.floor(F.col(c) / F.pow(two, level)).cast("long")
    order = F.col("_row") * F.lit(2**32) + F.col("_col")

    def sample(df, level):
        key = df.select(
            "raster_id", level.alias("level"), block("_col", level).alias("col"), block("_row", level).alias("row"),
            order.alias("_o"), "value",
        )
        return key.groupBy("raster_id", "level", "col", "row").agg(
            F.min("_o").alias("_o"), F.min_by("value", "_o").alias("value")
        )

    base = cells.select("raster_id", F.col("col").cast("long").alias("_col"), F.col("row").cast("long").alias("_row"), "value")
    first = sample(base, F.lit(1))
    out = first
    if levels > 1:
        again = first.select(
            "raster_id", F.pmod(F.col("_o"), F.lit(2**32)).alias("_col"), F.floor(F.col("_o") / 2**32).cast("long").alias("_row"),
            "value", F.explode(F.sequence(F.lit(2), F.lit(levels))).alias("_lv"),
        )
        out = first.unionByName(sample(again, F.col("_lv")))
    return out.select("raster_id", "level", "col", "row", "value")


# --- bands ----------------------------------------------------------------------------

def _bands(cells: DataFrame, bands: Sequence[str]) -> DataFrame:
    wide = cells.where(F.col("band").isin(*bands)).groupBy("raster_id", "col", "row")
    return wide.agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands])


def normalized_difference(cells: DataFrame, a: str, b: str) -> DataFrame:
    """(a − b) / (a + b) per cell; NULL where the sum is zero or a band is missing."""
    num, den = F.col(a) - F.col(b), F.col(a) + F.col(b)
    return _bands(cells, [a, b]).select("raster_id", "col", "row", S.ratio(num, den).alias("value"))


def spectral_index(cells: DataFrame, name: str) -> DataFrame:
    return normalized_difference(cells, *INDEX_BANDS[name])


def true_color(cells: DataFrame) -> DataFrame:
    r, g, b = TRUE_COLOR_BANDS
    return _bands(cells, TRUE_COLOR_BANDS).select(
        "raster_id", "col", "row", *[(F.col(c) * TRUE_COLOR_GAIN).alias(n) for c, n in ((r, "red"), (g, "green"), (b, "blue"))]
    )


def mosaic_least_cloud(
    scenes: DataFrame, cells: DataFrame, date_from: Column | None = None, date_to: Column | None = None
) -> DataFrame:
    """Per cell and band the value of the least cloudy scene in the range (default: the last 30 days).

    Only cells with data compete, so a gap in the best scene is filled by the next one.
    """
    start = F.date_sub(F.current_date(), 30) if date_from is None else date_from
    end = F.current_date() if date_to is None else date_to
    s = scenes.where(F.to_date("date").between(start, end)).select(F.col("id").alias("raster_id"), "cloud_pct")
    return with_value(cells, "value").join(s, "raster_id").groupBy("band", "col", "row").agg(
        F.min_by("value", F.struct("cloud_pct", "raster_id")).alias("value")
    )


def composite_mean(
    cells: DataFrame, date_from: Column | None = None, date_to: Column | None = None,
    region: DataFrame | None = None, region_id: str = "id", band: str | None = None, grid: J.Cells | None = None,
) -> DataFrame:
    """Temporal mean per cell and band.

    The date filter applies only when both ends are given; the end is excluded. With a region
    the cells are clipped to it.
    """
    c = with_value(cells, "value")
    if date_from is not None and date_to is not None:
        c = c.where((F.col("date") >= date_from) & (F.col("date") < date_to))
    if band is not None:
        c = c.where(F.col("band") == band)
    if region is not None:
        c = J.points_within(c, region, region_id, cells=grid)
    return c.groupBy("band", "col", "row").agg(F.avg("value").alias("value"))
