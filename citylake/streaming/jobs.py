"""Change-feed jobs that keep derived tables current.

Each job is a foreachBatch over a stream of changed rows. A table is a folder of Parquet whose partitions are
buckets of a key. A batch reads and rewrites only the buckets that its keys fall into, so its cost follows the
batch and not the batches before it. A rewritten bucket holds the latest row of each key before the batch and the
row that the batch sets, with the batch's number: a batch that is run again finds the state before it, and writes
the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType

from citylake.functions.scalars import density
from citylake.operators.raster import overviews
from citylake.operators.select import latest_raster, pending_exports
from citylake.operators.water import city_consumption_yr

# Raster kinds that have a latest view (wind has none).
LATEST_KINDS = ("temperature", "precipitation", "humidity")
DELETED = "_deleted"
BUCKETS = 16  # more for larger tables, so that a bucket stays at a file of some hundred MB


def run(changes: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived, then stop. Drop the trigger for a job that runs on."""
    return (
        changes.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


class Table:
    """Rows by ``keys``, in buckets of the column ``bucket`` (the only key, or one that every lookup gives)."""

    def __init__(self, spark: SparkSession, path: str, bucket: str = "id", keys: Sequence[str] | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.by, self.keys, self.buckets = spark, path, bucket, list(keys or [bucket]), buckets
        self.schema = None  # read once: to infer it is a job of its own

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.by)), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame, batch: int = -1) -> Table:
        """The rows that the table begins with. An empty file keeps its columns."""
        rows = rows.withColumns({DELETED: F.lit(False), "batch": F.lit(batch).cast("long")})
        rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/bucket=-1")
        self._write(rows)
        return self

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _write(self, rows: DataFrame) -> None:
        rows = rows.withColumn("bucket", self._bucket()).repartition("bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def _files(self, near: DataFrame | None) -> DataFrame:
        if self.schema is None:
            self.schema = self.spark.read.parquet(f"{self.path}/bucket=-1").schema.add("bucket", IntegerType())
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path)
        if near is not None:  # at most ``buckets`` numbers reach the driver
            rows = rows.where(F.col("bucket").isin([r[0] for r in near.select(self._bucket()).distinct().collect()]))
        return rows.drop("bucket")

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).where(~F.col("_r")[DELETED])
        return latest.select(*self.keys, *[F.col("_r")[c].alias(c) for c in rest])

    def read(self, near: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """The latest row of every key, NULL fields included, as it was before a batch (else now). ``near`` has
        the bucket column: only buckets that its values fall into are read."""
        rows = self._files(near)
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        return self._latest(rows).drop(DELETED, "batch")

    def put(self, rows: DataFrame, batch: int, near: DataFrame | None = None) -> None:
        """Rows that a batch sets, whole; those with ``_deleted`` take their key away. Once a batch. ``near`` names
        the values of their bucket column, where those are known at less cost than from the rows."""
        if DELETED not in rows.columns:
            rows = rows.withColumn(DELETED, F.lit(False))
        rows = rows.withColumn("batch", F.lit(batch).cast("long"))
        old = self._latest(self._files(rows if near is None else near).where(F.col("batch") < batch))
        self._write(old.unionByName(rows.select(old.columns)))


def write_batch(rows: DataFrame, path: str, batch: int, bucket: str = "id", keys: Sequence[str] | None = None) -> None:
    """A new table of these rows, or what a batch sets in one that is there."""
    table = Table(rows.sparkSession, path, bucket, keys)
    table.put(rows, batch) if table.exists() else table.create(rows, batch)


def current(spark: SparkSession, path: str, keys: Sequence[str], before: int | None = None) -> DataFrame:
    """The latest row of every key of a whole table."""
    return Table(spark, path, keys[0], keys).read(before=before)


def newest(batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last change of every key in the batch, whole."""
    rest = [c for c in batch.columns if c not in keys]
    picked = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest if c != order])


def refresh_parents(children: DataFrame, parents: DataFrame, parent_key: str) -> DataFrame:
    """The parents with population and density summed from these children; all other columns stay."""
    total = children.groupBy(F.col(parent_key).alias("id")).agg(F.sum("population").alias("_t"))
    pop = F.coalesce("_t", F.lit(0)).cast("long")
    new = {"population": pop, "density": density(pop, "area_km2")}
    return parents.join(total, "id", "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in parents.columns])


def population_handler(
    spark: SparkSession, neighborhoods: str, districts: str, cities: str, provinces: str, buckets: int = BUCKETS
) -> Callable[[DataFrame, int], None]:
    """Neighborhood changes (id, district_id, population, …, seq, _deleted) → district → city → province.

    Parents of both the old and the new row are touched; a chain stops where a parent is missing. Beside each
    level stands a table of its children by parent, ``<path>-children``, made from the level at the first batch,
    so that a parent's sum reads the parent's bucket.
    """
    steps = (
        (Table(spark, neighborhoods, buckets=buckets), Table(spark, districts, buckets=buckets), "district_id"),
        (Table(spark, districts, buckets=buckets), Table(spark, cities, buckets=buckets), "city_id"),
        (Table(spark, cities, buckets=buckets), Table(spark, provinces, buckets=buckets), "province_id"),
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        # what later steps ask again for is kept while the batch runs; all of it can be read anew
        rows = newest(batch, ["id"], "seq").persist()
        steps[0][0].put(rows, batch_id)
        ids, kept = rows.select("id"), [rows]
        for level, parents, key in steps:
            own = ["id", key, "population"]
            children = Table(spark, f"{level.path}-children", key, ["id", key], buckets)
            if not children.exists():
                children.create(level.read(before=batch_id).select(own))
            of = lambda before: level.read(ids, before).join(ids, "id", "left_semi").select(own)
            was, now = of(batch_id).withColumn(DELETED, F.lit(True)), of(batch_id + 1).withColumn(DELETED, F.lit(False))
            moves = was.unionByName(now).persist()
            was, now = moves.where(DELETED), moves.where(f"NOT {DELETED}")
            # a child that stays under its parent is one row, as it is now
            gone = was.join(now, (was["id"] == now["id"]) & was[key].eqNullSafe(now[key]), "left_anti")
            children.put(gone.unionByName(now), batch_id, moves)
            touched = moves.where(F.col(key).isNotNull()).select(key).distinct().persist()
            kept += [moves, touched]
            as_id = touched.select(F.col(key).alias("id"))
            rest = children.read(touched, batch_id + 1).join(touched, key, "left_semi")
            parents.put(refresh_parents(rest, parents.read(as_id, batch_id).join(as_id, "id", "left_semi"), key), batch_id, as_id)
            ids = as_id
        for df in kept:
            df.unpersist()

    return handle


def consumption_handler(spark: SparkSession, cities: str, consumption: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """City changes (id, population, …, seq) → yearly consumption of those cities. Records are in buckets of
    their city."""
    city, records = Table(spark, cities, buckets=buckets), Table(spark, consumption, "city_id", ["id", "city_id"], buckets)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = newest(batch, ["id"], "seq").persist()
        city.put(rows, batch_id)
        touched = rows.select(F.col("id").alias("city_id"))
        before = records.read(touched, batch_id)
        records.put(city_consumption_yr(before.join(touched, "city_id", "left_semi"), rows).select(before.columns), batch_id, touched)
        rows.unpersist()

    return handle


def latest_raster_handler(spark: SparkSession, rasters: str, latest: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Saved or deleted rasters → the latest raster of each touched kind.

    What is saved is compared with the latest there is. All rasters are read only if a kind's latest one has
    itself changed or gone.
    """
    stored, views = Table(spark, rasters, buckets=buckets), Table(spark, latest, "kind", buckets=buckets)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = newest(batch, ["id"], "seq").persist()
        stored.put(rows, batch_id)
        kinds = [r["kind"] for r in rows.select("kind").distinct().where(F.col("kind").isin(*LATEST_KINDS)).collect()]
        was = views.read(before=batch_id).where(F.col("kind").isin(*LATEST_KINDS))
        lost = [r["kind"] for r in was.join(rows.select("id"), "id", "left_semi").select("kind").collect()]
        alike = lambda df: df.where(~F.col(DELETED)).drop(DELETED) if DELETED in df.columns else df
        saved = alike(rows).where(F.col("kind").isin(*[k for k in kinds if k not in lost]))
        known = was.where(F.col("kind").isin(kinds) & ~F.col("kind").isin(lost)).select(saved.columns)
        now = latest_raster(saved.unionByName(known))
        if lost:
            full = stored.read(before=batch_id + 1).where(F.col("kind").isin(lost)).select(saved.columns)
            now = now.unionByName(latest_raster(full))
        # a kind whose last raster was deleted loses its row
        gone = was.where(F.col("kind").isin(lost)).select("kind").join(now.select("kind"), "kind", "left_anti").withColumn(DELETED, F.lit(True))
        views.put(now.withColumn(DELETED, F.lit(False)).unionByName(gone, allowMissingColumns=True), batch_id)
        rows.unpersist()

    return handle


def overview_handler(
    spark: SparkSession, cells: DataFrame, exports: str, out_path: str, levels: int = 6
) -> Callable[[DataFrame, int], None]:
    """New rasters without a product → their pyramid, one folder per batch, then the product record."""

    done = Table(spark, exports, "raster_id")

    def handle(batch: DataFrame, batch_id: int) -> None:
        ids = batch.select("id").distinct()
        there = done.read(ids.select(F.col("id").alias("raster_id")), batch_id)
        todo = pending_exports(ids, there).select(F.col("id").alias("raster_id"))
        pyramid = overviews(cells.join(todo, "raster_id", "left_semi"), levels)
        pyramid.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        done.put(todo.withColumn("path", F.lit(f"{out_path}/batch={batch_id}")), batch_id)

    return handle


def unique_measurements(measurements: DataFrame, delay: str = "1 day") -> DataFrame:
    """Stream of measurements with repeats of (station, date) dropped; state is kept for ``delay``."""
    return measurements.withWatermark("date", delay).dropDuplicatesWithinWatermark(["station_id", "date"])
