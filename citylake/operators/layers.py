"""Layer inventory: what layers exist, how large they are and where they lie."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylake.functions import geometry as G
from citylake.operators.select import union_layers
from citylake.schema import TABLES

# The colours that vector layers take in turn, and the raster colour.
PALETTE = (
    "#3388ff", "#e74c3c", "#2ecc71", "#9b59b6", "#f39c12", "#1abc9c", "#e91e63", "#00bcd4",
    "#ff5722", "#607d8b", "#8bc34a", "#673ab7", "#ffeb3b", "#795548", "#009688",
)
RASTER_COLOR = "#ff6b6b"

# The layer groups of each theme; a theme without groups shows no layer.
THEMES = {
    "overview": (),
    "common": ("common",),
    "temperature": ("temperature", "heat", "weather", "urban_heat"),
    "builtup": ("builtup",),
    "energy": ("Energy",),
    "housing": ("housing",),
    "green": ("green", "vegetation", "trees", "Park", "LandCover"),
    "water": ("watersupply",),
    "groundwater": ("groundwater",),
    "satellite": (),
}


def layer_inventory(tables: Sequence[tuple[str, str, DataFrame]], rasters: DataFrame | None = None) -> DataFrame:
    """One row per layer: key, app, kind, colour, display name and number of rows.

    ``tables`` lists (app, name, layer) in display order. ``rasters`` (id, app, model, name, product_path)
    adds each raster that has a product. The kind is the declared one of the table, so that an empty layer
    has one too; a layer that is not declared has that of its rows. Counting reads only metadata then.
    """
    rows = []
    for i, (app, name, df) in enumerate(tables):
        declared = TABLES[name].geom if name in TABLES else None
        kind = F.lit(declared) if declared or "geom" not in df.columns else F.max(F.col("geom")["kind"])
        rows.append(
            df.agg(F.count("*").alias("count"), F.lower(kind.cast("string")).alias("kind")).select(
                F.lit(f"{app}.{name}").alias("key"), F.lit(app).alias("app"), "kind",
                F.lit(PALETTE[i % len(PALETTE)]).alias("color"),
                F.lit(name.replace("_", " ").title()).alias("display_name"), "count",
            )
        )
    out = union_layers(*rows)
    if rasters is not None:
        r = rasters.where(F.col("product_path").isNotNull() & (F.col("product_path") != "")).select(
            F.concat_ws("-", F.lit("raster"), "app", "model", F.col("id").cast("string")).alias("key"), "app",
            F.lit("raster").alias("kind"), F.lit(RASTER_COLOR).alias("color"),
            F.coalesce(F.col("name"), F.concat(F.lit("Raster "), F.col("id").cast("string"))).alias("display_name"),
            F.lit(1).cast("long").alias("count"),
        )
        out = out.unionByName(r)
    return out


def layer_extent(layer: DataFrame, geom: str = "geom") -> DataFrame:
    """xmin, ymin, xmax, ymax of a layer; NULL when it is empty. Reads only the stored boxes."""
    b = F.col(geom)["bbox"]
    return layer.agg(
        F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"),
        F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax"),
    )


def layer_counts(inventory: DataFrame, visible: Sequence[str] = ()) -> DataFrame:
    """Number of layers, of features and of visible layers."""
    return inventory.agg(
        F.count("*").alias("layers"), F.coalesce(F.sum("count"), F.lit(0)).alias("features"),
        F.count_if(F.col("key").isin(*visible) if visible else F.lit(False)).alias("visible"),
    )


def layers_by_app(inventory: DataFrame) -> DataFrame:
    """Every layer under its app, with the app's number of layers. Rows, not lists: an app may own many rasters."""
    sizes = inventory.groupBy("app").agg(F.count("*").alias("layers"))
    return inventory.select("app", "key", "display_name").join(sizes, "app")


def layers_for_theme(inventory: DataFrame, theme: str) -> DataFrame:
    return inventory.where(F.col("app").isin(*THEMES.get(theme, ())))


def clip_to_box(layer: DataFrame, box: tuple[float, float, float, float], srid: int, layer_srid: int, geom: str = "geom") -> DataFrame:
    """Features whose box meets the given one. The corners are moved once, so the scan sees four plain comparisons."""
    x0, y0 = G.project_point(box[0], box[1], srid, layer_srid)
    x1, y1 = G.project_point(box[2], box[3], srid, layer_srid)
    b = F.col(geom)["bbox"]
    return layer.where((b["xmin"] <= x1) & (b["xmax"] >= x0) & (b["ymin"] <= y1) & (b["ymax"] >= y0))
