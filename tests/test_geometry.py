"""Geometry kernels and grid joins against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from citylake.functions import geometry as G
from citylake.operators import spatial as J


def ring_area(r):
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(r, r[1:]))) / 2


def inside(x, y, rings):
    odd = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def star(rnd, cx, cy, r, n):
    pts = [(cx + r * (0.4 + 0.6 * rnd.random()) * math.cos(t), cy + r * (0.4 + 0.6 * rnd.random()) * math.sin(t)) for t in sorted(rnd.random() * 2 * math.pi for _ in range(n))]
    return [list(p) for p in pts] + [list(pts[0])]


@pytest.fixture(scope="module")
def shapes(spark):
    rnd = random.Random(4)
    rows = [(i, [[star(rnd, rnd.random() * 1000, rnd.random() * 1000, rnd.choice([20, 100, 300]), rnd.randint(3, 12))]]) for i in range(30)]
    big = [[0.0, 0.0], [1000.0, 0.0], [1000.0, 1000.0], [0.0, 1000.0], [0.0, 0.0]]
    hole = [[100.0, 100.0], [900.0, 100.0], [900.0, 900.0], [100.0, 900.0], [100.0, 100.0]]
    rows.append((30, [[big, hole]]))
    rows.append((31, [[big[:1] + [[40.0, 0.0], [40.0, 40.0], [0.0, 40.0]] + big[:1]], [[[500.0, 500.0], [560.0, 500.0], [500.0, 560.0], [500.0, 500.0]]]]))
    df = spark.createDataFrame(rows, f"id long, parts {G.PARTS_TYPE}").select("id", G.make_geom("'POLYGON'", 28992, "parts").alias("geom"))
    return rows, df.cache()


def test_area(shapes):
    rows, df = shapes
    got = {r.id: r.a for r in df.select("id", G.area("geom").alias("a")).collect()}
    for i, parts in rows:
        want = sum(ring_area(p[0]) - sum(ring_area(h) for h in p[1:]) for p in parts)
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_area_does_not_move_with_the_polygon(spark):
    df = spark.range(1).select(*[G.box(o, o, o + 4.0, o + 3.0).alias(f"g{i}") for i, o in enumerate((0.0, 150000.0, 600000.0))])
    row = df.select(*[G.area(f"g{i}") for i in range(3)]).first()
    assert all(v == pytest.approx(12.0) for v in row)


def test_centroid_and_length(spark):
    df = spark.range(1).select(
        G.polygon([(0, 0), (6, 0), (6, 3), (0, 3), (0, 0)], [[(4, 1), (5, 1), (5, 2), (4, 2), (4, 1)]]).alias("p"),
        G.line([(0, 0), (3, 4), (3, 10)]).alias("l"), G.multipoint([(0, 0), (4, 2)]).alias("m"), G.box(1, 1, 1, 1).alias("z"),
    )
    r = df.select(G.centroid("p").alias("p"), G.length("l").alias("n"), G.centroid("m").alias("m"), G.centroid("z").alias("z")).first()
    assert (r.p.x, r.p.y) == (pytest.approx((18 * 3 - 4.5) / 17), pytest.approx(1.5))
    assert r.n == pytest.approx(11.0)
    assert (r.m.x, r.m.y) == (2.0, 1.0)
    assert (r.z.x, r.z.y) == (1.0, 1.0)


def test_reprojection_round_trip(spark):
    df = spark.range(1).select(G.point(120000.0, 487000.0).alias("g")).select("g", G.transform_geom("g", G.WGS84).alias("w"))
    r = df.select("w", G.transform_geom("w", G.RD).alias("b")).first()
    assert r.b.parts[0][0][0] == pytest.approx([120000.0, 487000.0], abs=0.01)
    assert r.w.srid == 4326
    assert G.project_point(r.w.bbox.xmin, r.w.bbox.ymin, G.WGS84, G.RD) == pytest.approx((120000.0, 487000.0), abs=0.01)
    with pytest.raises(ValueError):
        G.transform_geom("g", 3857)
    with pytest.raises(Exception, match="no transformation"):
        df.select(G.transform_geom("named_struct('kind', 'POINT', 'srid', 3857, 'parts', g.parts, 'bbox', g.bbox)", G.WGS84)).collect()


@pytest.mark.parametrize("cell,salts", [(130.0, 3), (5000.0, 1)])
def test_point_join(spark, shapes, cell, salts):
    rows, df = shapes
    rnd = random.Random(9)
    pts = [(i, rnd.random() * 1000, rnd.random() * 1000) for i in range(400)]
    got = {(r.id, r.zone_id) for r in J.point_join(spark.createDataFrame(pts, "id long, x double, y double"), df, "id", cells=J.Cells(cell, salts=salts)).collect()}
    want = {(i, z) for i, x, y in pts for z, parts in rows if inside(x, y, [r for p in parts for r in p])}
    assert got == want


@pytest.mark.parametrize("cell", [130.0, 5000.0])
def test_polygon_join_equals_pairwise_test(shapes, cell):
    _, df = shapes
    a, b = df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b")
    got = [(r.a, r.b) for r in J.spatial_join(a, b, "a", "b", cells=J.Cells(cell)).collect()]
    want = a.selectExpr("a", "geom AS g").join(b.selectExpr("b", "geom AS h")).where(G.intersects("g", "h")).collect()
    assert len(got) == len(set(got))
    assert set(got) == {(r.a, r.b) for r in want}


def test_boundary(spark):
    zone = spark.range(1).select(F.lit(7).alias("zone"), G.box(0, 0, 10, 10).alias("geom"))
    pts = spark.createDataFrame([(1, 10.0, 5.0), (2, 0.0, 0.0), (3, 5.0, 5.0), (4, 10.1, 5.0)], "id int, x double, y double")
    loose = {r.id for r in J.point_join(pts, zone, "zone", cells=J.Cells(4.0)).collect()}
    strict = {r.id for r in J.point_join(pts, zone, "zone", cells=J.Cells(4.0), strict=True).collect()}
    assert loose == {1, 2, 3} and strict == {3}
    assert {r.id for r in J.spatial_join(pts.select("id", G.point("x", "y").alias("geom")), zone, "id", "zone", cells=J.Cells(4.0)).collect()} == {1, 2, 3}


def test_polygon_in_a_hole_does_not_touch(spark):
    ring = spark.range(1).select(F.lit(1).alias("a"), G.polygon([(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [[(2, 2), (2, 7), (7, 7), (7, 2), (2, 2)]]).alias("geom"))
    inner = spark.range(1).select(F.lit(2).alias("b"), G.box(3, 3, 6, 6).alias("geom"))
    assert J.spatial_join(inner, ring, "b", "a", cells=J.Cells(2.0)).count() == 0
    assert J.spatial_join(inner, ring, "b", "a", cells=J.Cells(100.0)).count() == 0


def test_clip_length(spark):
    zone = spark.range(1).select(F.lit(1).alias("z"), G.polygon([(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)], [[(40, 40), (40, 60), (60, 60), (60, 40), (40, 40)]]).alias("geom"))
    lines = spark.range(1).select("id", G.line([(-50, 50), (150, 50), (150, -20), (20, -20), (20, 30)]).alias("geom"))
    for cell in (17.0, 1000.0):
        r = J.clip_length(lines, zone, "id", "z", cell=cell).first()
        assert r.length == pytest.approx(40 + 40 + 30)


def test_distance_join_and_buffer(spark):
    line = spark.range(1).select(F.lit(1).alias("g"), G.line([(0, 0), (1000, 500)]).alias("geom"))
    spots = [(i, 100.0 * i, 260.0) for i in range(10)]
    zones = spark.createDataFrame(spots, "z int, x double, y double").select("z", "x", "y", G.box("x", "y", "x + 5", "y + 5").alias("geom"))
    got = {r.z for r in J.distance_join(line, zones, "g", "z", 100.0, cell=70.0).collect()}

    def dist(px, py):
        t = max(0, min(1, (px * 1000 + py * 500) / (1000**2 + 500**2)))
        return math.hypot(px - 1000 * t, py - 500 * t)

    want = set()
    for z, x, y in spots:
        corners = [(x, y), (x + 5, y), (x, y + 5), (x + 5, y + 5)]
        signs = {(1000 * b - 500 * a) > 0 for a, b in corners}
        if len(signs) == 2 or min(dist(*c) for c in corners) <= 100:
            want.add(z)
    assert got == want
    area = J.buffer_area(line, "g", 100.0, 2.0).first().area
    assert area == pytest.approx(math.hypot(1000, 500) * 200 + math.pi * 1e4, rel=0.005)


def test_assign_by_centroid_reports_errors(spark):
    zones = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 15.0)], "zone int, x double").select("zone", G.box("x", 0, "x + 10", 10).alias("geom"))
    things = spark.createDataFrame([(1, 4.0), (2, 16.0), (3, 90.0)], "id int, x double").select("id", G.box("x", 1, "x + 1", 2).alias("geom"))
    got = {r.id: (r.zone, r.error) for r in J.assign_by_centroid(things, zones, "id", "zone").collect()}
    assert got == {1: (1, None), 2: (None, "several matches"), 3: (None, "no match")}


def test_hot_cell_keeps_every_pair(spark):
    """A third of all points on one spot, joined with shuffles and salts only."""
    zones = spark.createDataFrame([(1, 0.0), (2, 50.0), (3, 100.0)], "zone int, x double").select("zone", G.box("x", 0, "x + 60", 50).alias("geom"))
    pts = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 55D ELSE CAST(id % 160 AS DOUBLE) + 0.5 END AS x", "CAST(id % 50 AS DOUBLE) + 0.5 AS y")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = J.point_join(pts, zones, "zone", cells=J.Cells(20.0, salts=4)).groupBy("zone_id").count().collect()
        plain = pts.selectExpr("explode(filter(array(IF(x <= 60, 1, 0), IF(x BETWEEN 50 AND 110, 2, 0), IF(x BETWEEN 100 AND 160, 3, 0)), z -> z > 0)) AS zone_id").groupBy("zone_id").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {tuple(r) for r in got} == {tuple(r) for r in plain}


def test_points_within_overlapping_zones_come_once(spark):
    zones = spark.createDataFrame([(1, 0.0), (2, 5.0)], "zone int, x double").select("zone", G.box("x", 0, "x + 10", 10).alias("geom"))
    pts = spark.createDataFrame([(1, 7.0, 5.0), (2, 1.0, 1.0), (3, 20.0, 1.0)], "id int, x double, y double")
    assert sorted(r.id for r in J.points_within(pts, zones, "zone", cells=J.Cells(3.0)).collect()) == [1, 2]
