"""Change-feed jobs give the batch result, also when a batch is run again."""

import datetime

from pyspark.sql import functions as F

from citylake.operators import hierarchy as HI
from citylake.streaming import jobs as T


def _tables(spark, root):
    n = spark.createDataFrame([("a", "D1", 10), ("b", "D1", 20), ("c", "D2", 5)], "id string, district_id string, population long")
    level = lambda df: df.withColumn("density", F.lit(None).cast("double"))
    d = level(spark.createDataFrame([("D1", 1, 30, 2.0), ("D2", 2, 5, 0.0)], "id string, city_id long, population long, area_km2 double"))
    c = level(spark.createDataFrame([(1, 1, 30, 3.0), (2, 1, 5, 4.0)], "id long, province_id long, population long, area_km2 double"))
    p = level(spark.createDataFrame([(1, 35, 5.0)], "id long, population long, area_km2 double"))
    paths = [f"{root}/{k}" for k in "ndcp"]
    for path, df in zip(paths, (n, d, c, p)):
        T.write_batch(df, path, -1)
    return paths


def test_population_follows_changes(spark, tmp_path):
    n, d, c, p = _tables(spark, str(tmp_path))
    handle = T.population_handler(spark, n, d, c, p)
    read = lambda path: T.current(spark, path, ["id"])
    rows = "id string, district_id string, population long, seq long, _deleted boolean"
    # a moves to another district, b changes twice, c goes away
    batch = spark.createDataFrame([("a", "D2", 10, 1, False), ("b", "D1", 1, 1, False), ("b", "D1", 40, 2, False), ("c", "D2", 5, 1, True)], rows)
    handle(batch, 0)
    handle(batch, 0)  # a batch that is run again changes nothing more
    assert {r.id: r.population for r in read(d).collect()} == {"D1": 40, "D2": 10}
    assert {r.id: r.population for r in read(c).collect()} == {1: 40, 2: 10}
    assert read(p).first().population == 50
    d2, c2, p2 = HI.rollup_population(read(n), read(d), read(c), read(p))
    assert p2.first().density == read(p).first().density == 10.0


def test_unique_measurements(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00")], "station_id long, d string")
    rows.select("station_id", F.col("d").cast("timestamp").alias("date")).write.parquet(src)
    stream = spark.readStream.schema("station_id long, date timestamp").parquet(src)
    q = T.unique_measurements(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_a_child_that_leaves_no_longer_counts(spark, tmp_path):
    n, d, c, p = _tables(spark, str(tmp_path))
    batch = spark.createDataFrame([("a", None, 10, 1, False)], "id string, district_id string, population long, seq long, _deleted boolean")
    T.population_handler(spark, n, d, c, p)(batch, 0)
    assert {r.id: r.population for r in T.current(spark, d, ["id"]).collect()} == {"D1": 20, "D2": 5}
    assert T.current(spark, p, ["id"]).first().population == 25


def test_latest_raster_is_one_row_whole(spark, tmp_path):
    kinds = "id long, kind string, name string, date date, created_at timestamp, seq long, _deleted boolean"
    row = lambda i, name, day, gone=False: (i, "temperature", name, datetime.date(2024, 1, day), None, 1, gone)
    rasters, latest = str(tmp_path / "r"), str(tmp_path / "l")
    first = spark.createDataFrame([row(1, "A", 1)], kinds)
    T.write_batch(first.drop("seq").limit(0), rasters, -1)
    T.write_batch(first.drop("seq").withColumn("display_name", F.lit("")).limit(0), latest, -1, "kind")
    handle = T.latest_raster_handler(spark, rasters, latest)
    handle(first, 0)
    handle(spark.createDataFrame([row(2, None, 2)], kinds), 1)
    found = T.current(spark, latest, ["kind"]).first()
    assert (found.id, found.name, found.display_name) == (2, None, None)
    handle(spark.createDataFrame([row(1, "A", 1, True), row(2, None, 2, True)], kinds), 2)
    assert T.current(spark, latest, ["kind"]).count() == 0


def test_overviews_only_for_new_rasters(spark, tmp_path):
    cells = spark.range(16).selectExpr("id % 2 AS raster_id", "id div 2 AS col", "0L AS row", "CAST(id AS DOUBLE) AS value")
    done = str(tmp_path / "x")
    T.write_batch(spark.createDataFrame([(1, "old")], "raster_id long, path string"), done, -1, "raster_id")
    T.overview_handler(spark, cells, done, str(tmp_path / "o"), 2)(spark.createDataFrame([(0,), (1,)], "id long"), 0)
    assert {r.raster_id for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {0}
    assert T.current(spark, done, ["raster_id"]).count() == 2


def _read_files(df):
    return df.select(F.input_file_name().alias("f")).distinct().count()


def test_a_batch_reads_and_writes_its_own_buckets(spark, tmp_path):
    """Whatever came before: a table of 2,000 rows, and many batches of one row."""
    rows = spark.range(2000).selectExpr("concat('n', id) AS id", "concat('D', id % 40) AS district_id", "id AS population")
    t = T.Table(spark, str(tmp_path / "t"), buckets=16).create(rows)
    one = lambda k, n: spark.createDataFrame([(f"n{k}", "D1", n)], "id string, district_id string, population long")
    for batch in range(6):
        t.put(one(7, 1000 + batch), batch)
    near = one(7, 0)
    assert _read_files(t._files(near)) == 1  # of 16, after six batches
    files = [f for f in (tmp_path / "t").glob("bucket=*/*.parquet") if "bucket=-1" not in str(f)]
    assert len(files) == 16
    mine = t.read(near).where("id = 'n7'")
    assert mine.first().population == 1005 and t.read(near, before=5).where("id = 'n7'").first().population == 1004
    before = {f: f.stat().st_mtime_ns for f in files}
    t.put(one(7, 5), 6)
    left = [f for f in before if f.exists() and f.stat().st_mtime_ns == before[f]]
    assert len(left) == 15 and t.read().count() == 2000


def test_a_batch_run_again_after_a_part_of_it(spark, tmp_path):
    """As if the job had ended between two tables."""
    n, d, c, p = _tables(spark, str(tmp_path))
    rows = "id string, district_id string, population long, seq long, _deleted boolean"
    T.population_handler(spark, n, d, c, p)(spark.createDataFrame([("c", "D1", 7, 1, False)], rows), 0)
    batch = spark.createDataFrame([("a", "D2", 10, 1, False), ("c", "D2", 7, 1, True)], rows)
    T.Table(spark, n).put(T.newest(batch, ["id"], "seq"), 1)
    for _ in range(2):
        T.population_handler(spark, n, d, c, p)(batch, 1)
    read = lambda path: {r.id: r.population for r in T.current(spark, path, ["id"]).collect()}
    assert read(d) == {"D1": 20, "D2": 10} and read(c) == {1: 20, 2: 10} and read(p) == {1: 30}
