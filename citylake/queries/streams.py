"""Change-feed jobs run over the test tables as arriving files, read back as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylake.operators import water as W
from citylake.queries.standin import City, oracle
from citylake.session import shared_folder
from citylake.streaming import jobs as T

QUERIES: dict = {}
ORACLES: dict = {}


def add(name, fn, sql=None):
    QUERIES[name] = lambda spark, sf, _f=fn: _f(City(spark, sf))
    if sql:
        ORACLES[name] = sql


class Run:
    """Folders of one run."""

    def __init__(self, t: City):
        self.t, self.root = t, f"{shared_folder(t.spark)}/streams/{uuid.uuid4().hex}"

    def table(self, name: str, df: DataFrame, bucket: str = "id", keys: list[str] | None = None) -> str:
        path = f"{self.root}/{name}"
        T.write_batch(df, path, -1, bucket, keys)
        return path

    def arrive(self, df: DataFrame, slices: list[str], start) -> None:
        """Land the rows slice by slice, written by all tasks, and run the job after each."""
        feed = self.t.spark.readStream.schema(df.schema).parquet(f"{self.root}/feed/*")
        for k, where in enumerate(slices):
            df.where(where).write.parquet(f"{self.root}/feed/{k}")
            start(feed).awaitTermination()

    def go(self, df: DataFrame, slices: list[str], handler) -> None:
        self.arrive(df, slices, lambda feed: T.run(feed, handler, f"{self.root}/checkpoint"))


THIRDS = ["id % 3 = 0", "id % 3 = 1", "id % 3 = 2"]


def _population(t):
    r = Run(t)
    zero = F.lit(0).cast("long")
    level = lambda df, *cols: df.select("id", *cols, "area_km2", zero.alias("population"), F.lit(None).cast("double").alias("density"))
    n = r.table("neighborhood", t["neighborhood"].select("id", "district_id", "population"))
    d = r.table("district", level(t["district"], "city_id"))
    c = r.table("city", level(t["city"], "province_id"))
    p = r.table("province", level(t["province"]))
    # one in ten goes away, and one in ten leaves its district
    change = t["neighborhood"].select(
        "id", F.when(F.col("id") % 10 != 1, F.col("district_id")).alias("district_id"), (F.col("population") + 7).alias("population"),
        F.lit(1).alias("seq"), (F.col("id") % 10 == 0).alias("_deleted"),
    )
    r.go(change, THIRDS, T.population_handler(t.spark, n, d, c, p))
    cols = lambda path, name: T.current(t.spark, path, ["id"]).select(F.lit(name).alias("level"), F.col("id").cast("string").alias("id"), "population", "density")
    return cols(d, "district").unionByName(cols(c, "city")).unionByName(cols(p, "province"))


add(
    "stream_population",
    _population,
    oracle(
        "neighborhood district city province",
        """SELECT level, CAST(id AS STRING) AS id, pop AS population, CASE WHEN area_km2 > 0 THEN pop / area_km2 END AS density FROM (
             SELECT 'district' AS level, d.id, d.area_km2, CAST(coalesce(d.pop, 0) AS BIGINT) AS pop FROM d
             UNION ALL SELECT 'city', CAST(c.id AS STRING), c.area_km2, CAST(coalesce(c.pop, 0) AS BIGINT) FROM c
             UNION ALL SELECT 'province', CAST(p.id AS STRING), p.area_km2, CAST(coalesce((SELECT sum(pop) FROM c WHERE c.province_id = p.id), 0) AS BIGINT) FROM province p)""",
        d="SELECT d.id, d.city_id, d.area_km2, (SELECT sum(population + 7) FROM neighborhood n WHERE n.district_id = d.id AND n.id % 10 NOT IN (0, 1)) AS pop FROM district d",
        c="SELECT c.id, c.province_id, c.area_km2, (SELECT sum(pop) FROM d WHERE d.city_id = c.id) AS pop FROM city c",
    ),
)


def _consumption(t):
    r = Run(t)
    cities = r.table("city", t["city"].select("id", "population"))
    cc = r.table("cc", W.city_consumption_yr(t["consumption_capita"], t["city"]), "city_id", ["id", "city_id"])
    change = t["city"].select("id", (F.col("population") * 2).alias("population"), F.lit(1).alias("seq"))
    r.go(change, THIRDS, T.consumption_handler(t.spark, cities, cc))
    return T.current(t.spark, cc, ["city_id", "id"]).select("id", "m3_yr")


add(
    "stream_consumption",
    _consumption,
    oracle("city consumption_capita", "SELECT cc.id, l_per_day / 1000 * (population * 2) * 365 AS m3_yr FROM consumption_capita cc JOIN city ON city_id = city.id"),
)


def _latest(t):
    r = Run(t)
    # rasters arrive by date; those of the last slice have no name, and one of them wins each kind
    meta = t["raster_meta"].select(
        "id", "kind", F.when(F.year("date") < 1998, F.col("name")).alias("name"), "date", F.col("created_at").cast("timestamp").alias("created_at")
    )
    rasters = r.table("rasters", meta.limit(0))
    latest = r.table("latest", meta.withColumn("display_name", F.col("name")).limit(0), "kind")
    slices = ["year(date) < 1995", "year(date) BETWEEN 1995 AND 1997", "year(date) > 1997"]
    feed = meta.withColumn("seq", F.lit(1)).withColumn("_deleted", F.lit(False))
    r.go(feed, slices, T.latest_raster_handler(t.spark, rasters, latest))
    return T.current(t.spark, latest, ["kind"]).select("kind", "id", "name", "display_name")


add(
    "stream_latest_raster",
    _latest,
    oracle(
        "raster_meta",
        """SELECT kind, id, CASE WHEN year(date) < 1998 THEN name END AS name, CASE WHEN year(date) < 1998 THEN name || ' (LATEST)' END AS display_name
           FROM raster_meta WHERE kind <> 'wind'
           QUALIFY row_number() OVER (PARTITION BY kind ORDER BY date DESC, created_at DESC, id DESC) = 1""",
    ),
)


def _overviews(t):
    r = Run(t)
    done = r.table("exports", t["heat_raster"].where("kind = 'svf'").select(F.col("id").alias("raster_id"), F.lit("old").alias("path")), "raster_id")
    r.go(t["heat_raster"].select("id"), THIRDS, T.overview_handler(t.spark, t["cells"], done, f"{r.root}/pyramids"))
    return t.spark.read.parquet(f"{r.root}/pyramids").drop("batch")


add(
    "stream_overviews",
    _overviews,
    oracle(
        "cells heat_raster",
        """SELECT raster_id, CAST(k AS INT) AS level, col // CAST(pow(2, k) AS BIGINT) AS col, row // CAST(pow(2, k) AS BIGINT) AS row,
              arg_min_null(value, row * 4294967296 + col) AS value FROM cells, unnest([1, 2, 3, 4, 5, 6]) AS l(k)
           WHERE raster_id NOT IN (SELECT id FROM heat_raster WHERE kind = 'svf') GROUP BY ALL""",
    ),
)


def _unique(t):
    """Every measurement comes twice in its own third of the month, and those of the first third once more with
    the last: by then the watermark has passed them, so they are late, and their state is gone."""
    r = Run(t)
    date = F.col("date").cast("timestamp")
    part = F.when(F.dayofmonth(date) <= 10, 0).when(F.dayofmonth(date) <= 20, 1).otherwise(2)
    rows = t["measurement"].select("station_id", date.alias("date"), part.alias("part"))
    late = rows.where("part = 0").withColumn("part", F.lit(2))
    feed = rows.unionByName(rows).unionByName(late)
    out = f"{r.root}/out"

    def start(stream):
        unique = T.unique_measurements(stream).select("station_id", "date")
        return unique.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{r.root}/checkpoint").trigger(availableNow=True).start()

    r.arrive(feed, ["part = 0", "part = 1", "part = 2"], start)
    return t.spark.read.parquet(out).groupBy("station_id").agg(F.count("*").alias("n"))


add("stream_unique_measurements", _unique, oracle("measurement", "SELECT station_id, count(DISTINCT date) AS n FROM measurement GROUP BY 1"))
