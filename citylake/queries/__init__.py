"""Registered queries and their check SQL."""

from citylake.queries import dashboards, ingest, raster, relational, spatial, streams

MODULES = (relational, spatial, raster, dashboards, ingest, streams)

# Whole-number columns with gaps are shown as text on both sides, since readers differ in how they
# hold a missing integer.
GAPPED = {
    "period_year": "year", "municipality_code": "code", "assign_by_centroid": "province_id", "assign_parent": "city_id",
    "read_feature_collections": "n", "read_csv": "served", "column_mapping": "population", "foreign_keys": "city_id",
    "housing_lifecycle_import": "demand",
}


def _as_text(query, column):
    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.withColumn(column, df[column].cast("string"))

    return run


def all_queries() -> dict:
    found = {k: v for m in MODULES for k, v in m.QUERIES.items()}
    return {k: _as_text(v, GAPPED[k]) if k in GAPPED else v for k, v in found.items()}


def all_oracles() -> dict:
    found = {k: v for m in MODULES for k, v in m.ORACLES.items()}
    return {
        k: f"SELECT * REPLACE (CAST({GAPPED[k]} AS VARCHAR) AS {GAPPED[k]}) FROM ({v})" if k in GAPPED else v
        for k, v in found.items()
    }
