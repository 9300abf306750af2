"""Urban heat operators: vegetation, morphology, thermal indices, nature-based solutions, weather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylake.functions import scalars as S
from citylake.operators import raster as R
from citylake.operators import spatial as J
from citylake.operators.hierarchy import from_provinces
from citylake.operators.select import active, latest_touching, with_value

# The thermal indices that are reported.
THERMAL_KINDS = ("lst", "tmrt", "pet", "utci", "svf", "suhii")


def _zones(province: DataFrame) -> DataFrame:
    return province.select(F.col("id").alias("province_id"), "geom")


def green_area(
    parks: DataFrame, land_cover: DataFrame, classes: DataFrame, province: DataFrame, digits: int | None = 3
) -> DataFrame:
    """Park area and green land cover of each province, km². A park in two provinces counts in both."""
    p = J.spatial_join(parks, _zones(province), "id", "province_id", keep=["area"]).groupBy("province_id").agg(
        F.sum("area").alias("_park")
    )
    lc = green_cover(land_cover, classes).groupBy("province_id").agg(F.sum("_pct").alias("_pct"))
    area = province.select(F.col("id").alias("province_id"), F.col("area_km2").alias("_km2"))
    out = from_provinces(province, p).join(lc, "province_id", "left").join(area, "province_id")
    return out.select("province_id", *green_columns("_park", "_pct", "_km2", digits))


def green_cover(land_cover: DataFrame, classes: DataFrame) -> DataFrame:
    """Share of each green class in each province: (province_id, _pct). Class totals come first, so the join with
    the class names sees one row per province and class."""
    lc = land_cover.groupBy("province_id", "class_id").agg(F.sum("percentage").alias("_pct"))
    green = classes.where(S.is_green("class_name")).select(F.col("id").alias("class_id"))
    return lc.join(green, "class_id").select("province_id", "_pct")


def green_columns(park: str, cover_pct: str, km2: str, digits: int | None = 3) -> list[Column]:
    zero = F.lit(0.0)
    parks = F.coalesce(F.col(park), zero) / 1e6
    cover = F.coalesce(F.col(km2), zero) * F.coalesce(F.col(cover_pct), zero) / 100
    return [
        S.rounded(parks, digits).alias("park_area_km2"), S.rounded(cover, digits).alias("green_lc_km2"),
        S.rounded(parks + cover, digits).alias("total_green_km2"),
    ]


def vegetation_column(green: Column, km2: str, digits: int | None = 1) -> Column:
    share = F.when(F.col(km2) > 0, S.percent(green, F.col(km2), digits)).otherwise(F.lit(0.0))
    return share.alias("vegetation_coverage_pct")


def vegetation_coverage(
    parks: DataFrame, land_cover: DataFrame, classes: DataFrame, province: DataFrame, digits: tuple = (3, 1)
) -> DataFrame:
    g = green_area(parks, land_cover, classes, province, digits[0])
    area = province.select(F.col("id").alias("province_id"), F.col("area_km2").alias("_km2"))
    return g.join(area, "province_id").select(*g.columns, vegetation_column(F.col("total_green_km2"), "_km2", digits[1]))


def urban_morphology(
    buildings: DataFrame, streets: DataFrame, province: DataFrame, digits: tuple = (1, 3, 2)
) -> DataFrame:
    """Building and street statistics and the canyon aspect (mean height / mean width)."""
    z = _zones(province)
    b = J.spatial_join(buildings, z, "id", "province_id", keep=["height", "footprint"]).groupBy("province_id").agg(
        F.count("*").alias("_nb"), F.avg("height").alias("_h"), F.max("height").alias("_hmax"), F.sum("footprint").alias("_f")
    )
    s = J.spatial_join(streets, z, "id", "province_id", keep=["width"]).groupBy("province_id").agg(
        F.count("*").alias("_ns"), F.avg("width").alias("_w")
    )
    out = from_provinces(province, b).join(s, "province_id", "left")
    return out.select("province_id", *morphology_columns("_nb", F.col("_h"), "_hmax", "_f", "_ns", F.col("_w"), digits))


def morphology_columns(
    buildings: str, height: Column, highest: str, footprint: str, streets: str, width: Column, digits: tuple = (1, 3, 2)
) -> list[Column]:
    zero = F.lit(0.0)
    h, w = F.coalesce(height, zero), F.coalesce(width, zero)
    return [
        S.or_zero(buildings).alias("building_count"),
        S.rounded(h, digits[0]).alias("avg_building_height_m"),
        S.rounded(F.coalesce(F.col(highest), zero), digits[0]).alias("max_building_height_m"),
        S.rounded(F.coalesce(F.col(footprint), zero) / 1e6, digits[1]).alias("total_footprint_km2"),
        S.or_zero(streets).alias("street_count"),
        S.rounded(w, digits[0]).alias("avg_street_width_m"),
        S.rounded(h / F.when(w != 0, w).otherwise(F.lit(1.0)), digits[2]).alias("aspect_ratio"),
    ]


def latest_rasters(cells: DataFrame, rasters: DataFrame, province: DataFrame) -> DataFrame:
    """(province_id, kind, raster_id): the latest raster of each kind whose extent touches the province.

    Extents come from the raster table when it has them, else from the cells.
    """
    ext = rasters.select(F.col("id").alias("raster_id"), "geom") if "geom" in rasters.columns else R.raster_bounds(
        cells
    ).select("raster_id", F.col("bounds").alias("geom"))
    touching = J.spatial_join(ext, _zones(province), "raster_id", "province_id")
    return latest_touching(rasters, touching, "province_id")


def thermal_indices(cells: DataFrame, rasters: DataFrame, province: DataFrame, digits: int | None = 2) -> DataFrame:
    """Statistics of the latest raster of each index that touches the province, one row per index.

    The rasters are chosen first, so only their cells are read into the zonal statistics, for all
    indices in one job. A chosen raster without a cell inside leaves the index empty.
    """
    picked = latest_rasters(cells, rasters, province).select("province_id", "kind", "raster_id")
    # each chosen raster's cells carry the province that chose it, so the choice is made once
    own = with_value(cells, "value").select("raster_id", "x", "y", "value").join(picked, "raster_id")
    zone = J.point_join(own, _zones(province), "province_id", alias="_zone")
    stats = R.statistics(zone.where("province_id = _zone"), ["province_id", "kind", "raster_id"], digits)
    return stats.select("province_id", "kind", "raster_id", "min", "max", "mean", "stddev", "count")


def thermal_wide(indices: DataFrame) -> DataFrame:
    """The six indices side by side, one row for each province that has any."""
    cols = [
        F.max(F.when(F.col("kind") == k, F.col(m))).alias(f"{k}_{m}")
        for k in THERMAL_KINDS for m in ("min", "max", "mean", "stddev", "count")
    ]
    return indices.groupBy("province_id").agg(*cols)


def nbs_coverage(polygons: DataFrame, points: DataFrame, province: DataFrame, digits: tuple = (4, 1)) -> DataFrame:
    z = _zones(province)
    a = J.spatial_join(polygons, z, "id", "province_id", keep=["area"]).groupBy("province_id").agg(
        F.count("*").alias("_n"), F.sum("area").alias("_a")
    )
    b = J.spatial_join(points, z, "id", "province_id").groupBy("province_id").agg(F.count("*").alias("_m"))
    return from_provinces(province, a).join(b, "province_id", "left").select("province_id", *nbs_columns("_n", "_m", "_a", digits))


def nbs_columns(polygons: str, points: str, area: str, digits: tuple = (4, 1)) -> list[Column]:
    n, m, area = S.or_zero(polygons), S.or_zero(points), F.coalesce(F.col(area), F.lit(0.0))
    return [
        n.alias("polygon_count"), m.alias("point_count"), (n + m).alias("total_count"),
        S.rounded(area / 1e6, digits[0]).alias("total_area_km2"), S.rounded(area, digits[1]).alias("total_area_m2"),
    ]


def latest_meteorology(measurements: DataFrame, stations: DataFrame, province: DataFrame) -> DataFrame:
    """Latest measurement of an active station in the province."""
    return from_provinces(province, station_weather(measurements, stations, province))


def station_weather(measurements: DataFrame, stations: DataFrame, province: DataFrame) -> DataFrame:
    """The same for the provinces that have one. The latest row of every station is taken before the join, so
    the join sees one row a station."""
    fields = ["temperature", "humidity", "wind", "precipitation", "radiation"]
    last = measurements.groupBy("station_id").agg(
        F.max_by(F.struct("date", *fields), "date").alias("_m")
    )
    where = J.spatial_join(active(stations), _zones(province), "id", "province_id")
    m = where.join(last.withColumnRenamed("station_id", "id"), "id").groupBy("province_id").agg(
        F.max_by("_m", F.struct(F.col("_m.date"), F.col("id"))).alias("_m")
    )
    return m.select("province_id", *[F.col("_m")[f].alias(f) for f in fields], F.col("_m.date").alias("date"))
