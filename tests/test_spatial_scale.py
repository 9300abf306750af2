"""What the spatial joins list and compare, where it must not grow with the square of anything."""

import math
import random

import pytest
from pyspark.sql import functions as F

from citylake.functions import geometry as G
from citylake.operators import spatial as J

EDGE = "struct<x1: double, y1: double, x2: double, y2: double>"


def chain(rnd, n, x, step=1.0):
    """Edges that climb from y = 0 to n steps around a vertical line."""
    xs = [x + rnd.random() for _ in range(n + 1)]
    return [(xs[k], k * step, xs[k + 1], (k + 1) * step) for k in range(n)]


def touch(a, b):
    side = lambda e, x, y: (e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0])
    box = lambda e, x, y: min(e[0], e[2]) <= x <= max(e[0], e[2]) and min(e[1], e[3]) <= y <= max(e[1], e[3])
    s = side(a, *b[:2]), side(a, *b[2:]), side(b, *a[:2]), side(b, *a[2:])
    cross = s[0] * s[1] < 0 and s[2] * s[3] < 0
    ends = (s[0] == 0 and box(a, *b[:2]), s[1] == 0 and box(a, *b[2:]), s[2] == 0 and box(b, *a[:2]), s[3] == 0 and box(b, *a[2:]))
    return cross or any(ends)


def swept(spark, pairs):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], f"k int, a array<{EDGE}>, b array<{EDGE}>")
    rows = rows.select("k", F.expr(G.sweep.sql("a", "b")).alias("s"), G.edges_touch("a", "b").alias("hit")).orderBy("k")
    return [(r["s"]["hit"], r["hit"], r["s"]["tests"]) for r in rows.collect()]


def test_a_sweep_compares_only_edges_that_overlap(spark):
    """1,000 edges beside 1,000 edges: some thousand comparisons, not a million."""
    rnd = random.Random(1)
    apart = (chain(rnd, 1000, 0.0), chain(rnd, 1000, 5.0, 1.01))
    crossing = (chain(rnd, 1000, 0.0), [*chain(rnd, 999, 5.0), (-1.0, 700.5, 9.0, 700.6)])
    got = swept(spark, [apart, crossing])
    assert got[0][:2] == (False, False) and got[0][2] < 6000
    assert got[1][:2] == (True, True) and got[1][2] < 6000


def test_a_sweep_finds_what_all_pairs_find(spark):
    rnd = random.Random(2)
    some = lambda n: [tuple(float(rnd.randrange(14)) if rnd.random() < 0.6 else rnd.random() * 14 for _ in range(4)) for _ in range(n)]
    short = lambda n: [(x, y, x + rnd.choice([0, 0.3, 1]), y + rnd.choice([0, -0.3, 1])) for x, y in ((rnd.random() * 40, rnd.random() * 40) for _ in range(n))]
    pairs = [(some(rnd.randrange(3)), some(rnd.randrange(3))) for _ in range(60)] + [(short(20), short(25)) for _ in range(60)]
    want = [any(touch(e, f) for e in a for f in b) for a, b in pairs]
    got = swept(spark, pairs)
    assert [g[0] for g in got] == want and [g[1] for g in got] == want
    assert 20 < sum(want) < 110


def cells(spark, x1, y1, x2, y2, cell, d=0.0):
    segments = f"SELECT 1 AS id, named_struct('x1', {x1}D, 'y1', {y1}D, 'x2', {x2}D, 'y2', {y2}D) AS e"
    return {(r["cx"], r["cy"]) for r in spark.sql(J._segment_cells_sql(segments, cell, d)).collect()}


def distance(px, py, x1, y1, x2, y2):
    n = (x2 - x1) ** 2 + (y2 - y1) ** 2
    t = 0 if n == 0 else max(0, min(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / n))
    return math.hypot(px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1))


def test_a_long_diagonal_meets_the_cells_along_it(spark):
    assert len(cells(spark, 100_100, 400_200, 170_900, 470_800, 5000.0)) <= 30  # 100 km; its box has 225


@pytest.mark.parametrize("d", [0.0, 3.0, 25.0])
def test_the_walk_misses_no_cell(spark, d):
    rnd = random.Random(int(d))
    for _ in range(12):
        x1, y1, x2, y2 = (round(rnd.random() * 120, 1) for _ in range(4))
        if rnd.random() < 0.3:
            x2, y2 = rnd.choice([(x1, y2), (x2, y1), (x1, y1)])
        got = cells(spark, x1, y1, x2, y2, 10.0, d)
        for k in range(400):  # points within d of the segment
            t, r, a = k / 399, d * rnd.random(), rnd.random() * 2 * math.pi
            x, y = x1 + t * (x2 - x1) + r * math.cos(a), y1 + t * (y2 - y1) + r * math.sin(a)
            assert (math.floor(x / 10), math.floor(y / 10)) in got
        far = [c for c in got if distance(c[0] * 10 + 5, c[1] * 10 + 5, x1, y1, x2, y2) > (d + 8) * 2.5]
        assert not far


# ---- cells that follow density


def crowded(spark, n=8_000):
    """Half of all features in one city block of 150 m, the others over 60 km; every tenth is a larger polygon."""
    block = "id % 2 = 0"
    x = f"IF({block}, 30000 + pmod(id * 7919, 1500) / 10, pmod(id * 104729, 600000) / 10D)"
    y = f"IF({block}, 20000 + pmod(id * 15485863, 1500) / 10, pmod(id * 32452843, 600000) / 10D)"
    rows = spark.range(n).selectExpr("id", f"CAST({x} AS DOUBLE) AS x", f"CAST({y} AS DOUBLE) AS y", "IF(id % 10 = 3, 900D, IF(id % 2 = 0, 2D, 20D)) AS w")
    return rows.select("id", "x", "y", "w", G.box("x", "y", "x + w", "y + w").alias("geom"))


def test_a_city_block_is_split_and_pairs_stay_the_same(spark):
    a = crowded(spark).cache()
    b = crowded(spark).selectExpr("id AS b", "x", "y", "w", "geom").cache()
    cells = J.cells_for((a, "geom"), (b, "geom"), capacity=300)
    assert len(cells.splits) >= 2
    tiles = J.tiles(a, "id", cells=cells).groupBy("c").count()
    most = tiles.agg(F.max("count")).first()[0]
    in_one = J.tiles(a, "id", cells=J.Cells()).groupBy("c").count().agg(F.max("count")).first()[0]
    assert in_one > 4_000 and most < 400  # features in one cell, so pairs fall from 16 million to some hundred thousand
    got = J.spatial_join(a, b, "id", "b", cells=cells)
    meets = "a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.w AND b.y <= a.y + a.w"
    spark.conf.set("spark.sql.crossJoin.enabled", "true")
    want = a.alias("a").where("id % 8 < 2").join(b.alias("b"), F.expr(meets)).select(F.xxhash64("id", "b").alias("h"))
    total = lambda df: df.agg(F.count("*"), F.bit_xor("h")).first()
    assert total(got.where("id % 8 < 2").select(F.xxhash64("id", "b").alias("h"))) == total(want)
    assert got.count() == got.distinct().count()


def test_points_in_a_crowd_meet_the_same_zones(spark):
    pts = crowded(spark, 6000).select("id", "x", "y").unionByName(spark.range(10**6, 10**6 + 2000).selectExpr("id", "30020.5D AS x", "20020.5D AS y"))
    zones = spark.range(40).select("id", G.polygon([("id * 1500", 0), ("id * 1500 + 4000", 30000), ("id * 1500", 60000), ("id * 1500", 0)]).alias("geom"))
    cells = J.cells_for((pts, "x y"), capacity=300)
    assert len(cells.splits) == J.STEPS and len(cells.hot) == 1  # points on one spot cannot be told apart: salts
    key = F.xxhash64("id", "zone_id").alias("h")
    one = lambda c: J.point_join(pts, zones, "id", cells=c).select(key).agg(F.count("*"), F.bit_xor("h")).first()
    assert one(cells) == one(J.Cells()) and one(cells)[0] > 8000


def test_cells_without_a_crowd_stay_whole(spark):
    few = crowded(spark, 100)
    assert J.cells_for((few, "geom"), (few, "x y")) == J.Cells()
