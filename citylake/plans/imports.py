"""End-to-end import jobs: landed files to a new snapshot and a report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citylake.functions import geometry as G
from citylake.operators.layers import clip_to_box
from citylake.operators.quality import join_city, map_columns, run_import, upsert
from citylake.operators.select import limit_features
from citylake.operators.spatial import assign_by_centroid
from citylake.sources import files


@dataclass(frozen=True)
class LayerImport:
    """What a landed vector layer maps to. ``columns`` is source → target, ``unique`` a target column."""

    kind: str
    unique: str
    columns: dict[str, str]
    types: dict[str, str] = field(default_factory=dict)
    any_of: tuple[str, tuple[str, ...]] | None = None


# Source attributes of the published layers and the columns they fill.
LAYERS = {
    "provinces": LayerImport(G.POLYGON, "name", {"naam": "name", "code": "code"}),
    "cities": LayerImport(G.POLYGON, "name", {"naam": "name", "code": "code"}),
    "districts": LayerImport(G.POLYGON, "id", {"wijkcode": "id", "wijknaam": "name"}),
    "neighborhoods": LayerImport(
        G.POLYGON, "id", {"buurtcode": "id", "buurtnaam": "name", "aantalInwoners": "population"}, {"population": "long"}
    ),
    "buildings": LayerImport(
        G.POLYGON, "bag_id",
        {"identificatie": "bag_id", "bouwjaar": "construction_year", "status": "status", "oppervlakte": "area_m2"},
        {"construction_year": "int", "area_m2": "double"},
    ),
    "streets": LayerImport(
        G.LINE, "identification", {"identificatie": "identification", "openbareruimtenaam": "name", "type": "street_type"}
    ),
    "protected_areas": LayerImport(
        G.POLYGON, "name", {"naam": "name", "sitecode": "site_code", "type": "protection_type"}
    ),
    "water_bodies": LayerImport(G.POLYGON, "name", {"naam": "name", "type": "water_type"}),
    "waterways": LayerImport(G.LINE, "name", {"naam": "name", "type": "waterway_type"}),
    "forests": LayerImport(
        G.POLYGON, "source_id", {"id": "source_id", "naam": "name"},
        any_of=("typelandgebruik", ("bos: loofbos", "bos: naaldbos", "bos: gemengd bos")),
    ),
    "energy_labels": LayerImport(
        G.POLYGON, "building_id",
        {"pand_id": "building_id", "energieklasse": "energy_label", "registratiedatum": "registration_date"},
        {"registration_date": "date"},
    ),
}


def layer_rows(
    features: DataFrame, spec: LayerImport, bbox: tuple | None = None, bbox_srid: int = G.WGS84, srid: int = G.RD,
    limit: int | None = None,
) -> DataFrame:
    """Mapped rows of a layer: typed columns, geometry of the layer's kind, and the error list."""
    df = features
    if spec.any_of:
        c, values = spec.any_of
        df = df.where(F.col("properties")[c].isin(*values))
    if bbox:
        df = clip_to_box(df, bbox, bbox_srid, srid)
    rows = map_columns(df, spec.columns, spec.types)
    wrong = F.when(
        F.col("geom").isNotNull() & (F.col("geom.kind") != spec.kind), F.concat(F.lit("wrong geometry kind: "), F.col("geom.kind"))
    )
    rows = rows.withColumn("errors", F.array_compact(F.concat("errors", F.array(wrong)))).withColumn(
        "geom", G.to_multi("geom", spec.kind)
    )
    return rows if limit is None else limit_features(rows, limit, spec.unique)


def import_layer(
    spark: SparkSession, name: str, path: str, target: DataFrame, bbox: tuple | None = None, srid: int = G.RD,
    limit: int | None = None, dry_run: bool = False, multiline: bool = True, max_errors: int | None = None,
    delivery: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(snapshot, report) of one landed vector layer, upserted by the layer's unique column.

    The feature of a repeated key that arrived last wins, see ``sources.files.arrival_order``. Rows with errors are in the report
    only; the others are written, unless the caller sets ``max_errors`` and more rows than that fail.
    """
    spec = LAYERS[name]
    rows = layer_rows(files.read_geojson(spark, path, srid, multiline, delivery=delivery), spec, bbox, srid=srid, limit=limit)
    compare = [c for c in (*spec.columns.values(), "geom") if c != spec.unique]
    return run_import(
        target, rows, [spec.unique], compare, "arrival", dry_run, required_geom="geom", errors="errors",
        max_errors=max_errors,
    )


def housing_lifecycle(odata: DataFrame, city: DataFrame, target: DataFrame) -> DataFrame:
    """New (city, year) supply-and-demand snapshot from the housing lifecycle table; the last row that arrived wins.

    Rows with a bad municipality number, or one that is unknown, are left out; see
    ``sources.files.housing_updates`` for their errors.
    """
    rows = files.housing_updates(files.housing_rows(odata)).where(F.col("error").isNull())
    rows = join_city(rows, city, "code").select("city_id", "year", "supply", "demand", "arrival")
    return upsert(target, rows, ["city_id", "year"], "arrival")


def assign_parent(child: DataFrame, parent: DataFrame, fk: str) -> DataFrame:
    """Child rows with their parent id found by centroid containment; NULL when not exactly one matches."""
    link = assign_by_centroid(child, parent.select(F.col("id").alias("_pid"), "geom"), "id", "_pid")
    rest = [c for c in child.columns if c != fk]
    return child.select(*rest).join(link.select("id", F.col("_pid").alias(fk)), "id", "left")
