"""First and latest records per key, unions and small ordered outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], agg, order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(agg(F.struct(*rest), order).alias("_r"))
    return out.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def first_by(df: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """The record with the lowest id per key. Partial aggregates, so a hot key is reduced map-side."""
    return _pick(df, keys, F.min_by, F.col(id_col))


def latest_by(df: DataFrame, keys: Sequence[str], order: str, id_col: str = "id") -> DataFrame:
    """The record with the highest (order, id) per key; rows without an order value never win."""
    return _pick(df.where(F.col(order).isNotNull()), keys, F.max_by, F.struct(order, id_col))


def latest_touching(rasters: DataFrame, touching: DataFrame, zone: str, kind: str = "kind") -> DataFrame:
    """Latest raster of each kind among those that touch the zone: (zone, kind, raster_id)."""
    r = rasters.select(F.col("id").alias("raster_id"), kind, "date_time")
    return (
        touching.join(r, "raster_id")
        .groupBy(zone, kind)
        .agg(F.max_by("raster_id", F.struct("date_time", "raster_id")).alias("raster_id"))
    )


def latest_raster(rasters: DataFrame, kind: str = "kind") -> DataFrame:
    """Newest raster of every kind, with its display name."""
    order = F.struct(F.col("date"), F.col("created_at"), F.col("id"))
    rest = [c for c in rasters.columns if c != kind]
    picked = rasters.groupBy(kind).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select(kind, *[F.col("_r")[c].alias(c) for c in rest]).withColumn(
        "display_name", F.concat(F.col("name"), F.lit(" (LATEST)"))
    )


def pending_exports(rasters: DataFrame, exports: DataFrame) -> DataFrame:
    """Rasters without an exported product."""
    return rasters.join(exports.select(F.col("raster_id").alias("id")), "id", "left_anti")


def pending_counts(rasters: DataFrame, exports: DataFrame) -> DataFrame:
    return pending_exports(rasters, exports).groupBy("kind").agg(F.count("*").alias("pending"))


def limit_features(df: DataFrame, n: int, order: str) -> DataFrame:
    """At most n features, the first by key: a top-k, not a full sort."""
    return df.orderBy(order).limit(n)


def union_layers(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def ordered_stations(stations: DataFrame) -> DataFrame:
    return stations.orderBy("name", "id")


def ordered_measurements(measurements: DataFrame) -> DataFrame:
    return measurements.orderBy(F.col("date").desc(), F.col("station_id"))


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_active"))


def with_value(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNotNull())


def in_window(df: DataFrame, ts: str, center: Column, hours: int) -> DataFrame:
    """Rows within ``hours`` of the centre, both ends included."""
    w = F.make_dt_interval(hours=F.lit(hours))
    return df.where(F.col(ts).between(center - w, center + w))

