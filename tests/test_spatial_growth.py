"""What the spatial operators move and how they are dealt, at the sizes where tables are dense."""

import random

import pytest
from pyspark.sql import functions as F

from citylake.functions import geometry as G
from citylake.operators import spatial as J


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def pipes(spark, n=60, seed=1):
    rnd = random.Random(seed)
    rows = [(k % 3 if k % 7 else None, *(round(rnd.random() * 3000, 1) for _ in range(4))) for k in range(n)]
    rows = spark.createDataFrame(rows, "g long, x1 double, y1 double, x2 double, y2 double")
    return rows.select("*", G.line([("x1", "y1"), ("x2", "y2")]).alias("geom"))


def test_a_box_needs_no_lambda(spark):
    """Geometry of known vertices: reading the box leaves plain arithmetic, whatever else the geometry holds."""
    rows = spark.createDataFrame([(3.0, 7.0), (None, 7.0)], "x double, y double").select(
        G.box("x", "y", "x + 4", "y - 2").alias("g"), G.point("x", "y").alias("p"), G.polygon([(0, 0), ("x", 9), (-1, "y"), (0, 0)], [[("x", 1), (2, 20), ("x", 1)]]).alias("h")
    )
    box = rows.select("g.bbox.*", F.col("p.bbox.xmin").alias("px"), F.col("h.bbox").alias("h"))
    assert "lambda" not in plan(box)
    got = [(r.xmin, r.ymin, r.xmax, r.ymax, r.px, tuple(r.h)) for r in box.collect()]
    assert got == [(3.0, 5.0, 7.0, 7.0, 3.0, (-1.0, 0.0, 3.0, 20.0)), (None, 5.0, None, 7.0, None, (-1.0, 0.0, 2.0, 20.0))]


def test_compiled_nearness_equals_the_other(spark):
    rnd = random.Random(4)
    some = lambda: tuple(float(rnd.randrange(12)) for _ in range(4))
    edge = "struct<x1: double, y1: double, x2: double, y2: double>"
    rows = spark.createDataFrame([(some(), some()) for _ in range(400)], f"a {edge}, b {edge}")
    got = rows.select(G.nearby("a", "b", 2.0).alias("n"), G.segments_within("a", "b", 2.0).alias("w")).collect()
    assert [r.n for r in got] == [r.w for r in got] and 50 < sum(r.n for r in got) < 350


def test_one_file_of_lines_is_dealt_over_all_tasks(spark):
    """A table of few bytes in one partition: its work is not one task's."""
    lines, n = pipes(spark).coalesce(1), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert J.dealt(lines).rdd.getNumPartitions() >= n > 1
    zones = lines.select(F.monotonically_increasing_id().alias("z"), G.box("x1", "y1", "x1 + 40", "y1 + 40").alias("geom"))
    near = J.distance_join(lines.select("g", "geom"), zones, "g", "z", 50.0)
    found = J.assign_by_centroid(zones, zones.select(F.col("z").alias("o"), "geom"), "z", "o")
    for df in (near, J.buffer_area(lines, "g", 50.0, 10.0), found):
        assert "Repartition" in plan(df)


@pytest.mark.parametrize("d, step", [(100.0, 10.0), (75.0, 40.0)])
def test_runs_make_the_area_of_the_cells(spark, d, step):
    """Cells by brute force; what leaves a task is a row for each segment and row of cells."""
    lines = pipes(spark)
    runs = J.buffer_runs(lines, "g", d, step)
    n = int(3400 / step)
    grid = spark.range(-20, n).selectExpr("id AS col").crossJoin(spark.range(-20, n).selectExpr("id AS row"))
    xy = grid.selectExpr("*", f"(col + 0.5D) * {step}D AS xc", f"(row + 0.5D) * {step}D AS yc")
    e = F.struct("x1", "y1", "x2", "y2").alias("e")
    near = lines.select("g", e).crossJoin(xy).where(G.distance2_to_edge("xc", "yc", "e") <= d * d)
    want = {r.g: r.n * step**2 for r in near.select("g", "col", "row").distinct().groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert {r.g: r.area for r in J.buffer_area(lines, "g", d, step).collect()} == want and None in want
    cells = J.buffer_cells(lines, "g", d, step)
    assert {r.g: r["count"] * step**2 for r in cells.groupBy("g").count().collect()} == want
    assert runs.count() <= 60 * (3000 + 2 * d) / step and runs.count() < near.count() / 3


def test_zones_meet_the_lines_of_their_own_group(spark):
    lines = pipes(spark).select("g", "geom")
    zones = spark.range(90).selectExpr("id AS z", "CAST(id * 33 % 3000 AS DOUBLE) AS x", "CAST(id * 71 % 3000 AS DOUBLE) AS y")
    zones = zones.select("z", G.box("x", "y", "x + 30", "y + 30").alias("geom"))
    owned = zones.withColumn("g", F.col("z") % 4).unionByName(zones.withColumn("g", F.lit(1)))
    pairs = J.distance_join(lines, zones, "g", "z", 60.0).join(owned.select("z", "g").distinct(), ["z", "g"]).select("g", "z").collect()
    got = J.distance_join(lines, owned, "g", "z", 60.0, within="g").collect()
    assert sorted((r.g, r.z) for r in got) == sorted((r.g, r.z) for r in pairs) and got


def test_the_join_compares_boxes_and_not_edges(spark):
    a = spark.range(50).select("id", G.box("id * 10", "0", "id * 10 + 15", "9").alias("geom"))
    text = plan(J.spatial_join(a, a.select(F.col("id").alias("b"), "geom"), "id", "b", cells=J.Cells()))
    condition = next(line for line in text.splitlines() if "Join Inner" in line)
    assert "lambda" not in condition and "bbox" in condition or "box" in condition and "lambda" not in condition
