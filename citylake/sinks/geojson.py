"""GeoJSON output in WGS84, one feature per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylake.functions import geometry as G


def _feature(geom: str, properties: Column) -> Column:
    """Feature text. Coordinates are already JSON, so the parts are put together as text."""
    moved = G.let("wg", G.transform_geom.sql(geom, G.WGS84), G.geojson_text.sql("wg"))
    geometry = F.coalesce(F.expr(moved), F.lit("null"))
    return F.concat(
        F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), properties, F.lit("}")
    )


def to_geojson(layer: DataFrame, geom: str = "geom") -> DataFrame:
    """One GeoJSON feature per row; every other column is a property, NULLs included."""
    props = [c for c in layer.columns if c != geom]
    body = F.to_json(F.struct(*props), {"ignoreNullFields": "false"}) if props else F.lit("{}")
    return layer.select(_feature(geom, body).alias("feature"))


def write_geojson(layer: DataFrame, path: str, geom: str = "geom", mode: str = "overwrite") -> None:
    """Newline-delimited features, written by all tasks."""
    to_geojson(layer, geom).write.mode(mode).text(path)


def city_picker(city: DataFrame) -> DataFrame:
    """City features whose properties hold id, name and the WGS84 box; rows without a usable geometry are left out."""
    usable = city.where(F.col("geom").isNotNull() & F.col("geom.srid").isin(G.RD, G.WGS84))
    moved = usable.select("id", "name", G.transform_geom("geom", G.WGS84).alias("geom"))
    b = F.col("geom")["bbox"]
    with_box = moved.withColumn("bbox", F.array(b["xmin"], b["ymin"], b["xmax"], b["ymax"]))
    return with_box.select(
        "id", "name", "bbox", _feature("geom", F.to_json(F.struct("id", "name", "bbox"))).alias("feature")
    )
