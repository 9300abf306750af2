"""Operators on small hand-made tables, with the edge rows that matter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citylake.functions import geometry as G
from citylake.functions import scalars as S
from citylake.operators import heat as U
from citylake.operators import hierarchy as HI
from citylake.operators import housing as H
from citylake.operators import layers as L
from citylake.operators import quality as Q
from citylake.operators import raster as R
from citylake.operators import select as X
from citylake.operators import water as W
from citylake.sinks import geojson as K
from citylake.sources import files


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(n) if not hasattr(v, "alias") else v.alias(n) for n, v in cols.items()])


# --- metered water recovery -----------------------------------------------------------


@pytest.fixture(scope="module")
def meters(spark):
    def run(installed=400, collected=350, served=1200, with_rate=True):
        bridge = spark.createDataFrame([("N1", "D1", 1, 1)], "neighborhood_id string, district_id string, city_id long, province_id long")
        cc = spark.createDataFrame([(1, 1, 2023, 100.0), (2, 1, 2024, 120.0)] if with_rate else [], "id long, city_id long, year int, l_per_day double")
        users = spark.createDataFrame([(1, "N1", 500, served)], "id long, neighborhood_id string, users_total long, served long")
        m = spark.createDataFrame([(1, 1, installed, 380, collected, 0.5, None, None)], "id long, users_location_id long, installed long, functional long, collected long, tariff double, consumption double, recovery double")
        return W.meter_recovery(m, users, bridge, cc).first().recovery

    return run


def test_recovery_value(meters):
    assert meters() == pytest.approx(22995.0, abs=0.005)


def test_recovery_without_meters(meters):
    assert meters(installed=0, collected=0) == 0


def test_recovery_without_consumption_record(meters):
    assert meters(with_rate=False) is None


def test_recovery_without_served_population(meters):
    assert meters(served=None) is None


# --- scalars --------------------------------------------------------------------------


def test_classes_at_their_bounds(spark):
    rows = spark.createDataFrame([(3.99,), (4.0,), (41.0,), (None,)], "v double")
    assert [r[0] for r in rows.select(S.classify_pet("v")).collect()] == ["Very Cold Stress", "Cold Stress", "Extreme Heat Stress", None]
    rows = spark.createDataFrame([(-40.1,), (-40.0,), (46.0,), (None,)], "v double")
    assert [r[0] for r in rows.select(S.classify_utci("v")).collect()] == ["Extreme Cold Stress", "Very Strong Cold Stress", "Extreme Heat Stress", None]


def test_scalars(spark):
    r = one(
        spark, zero_rate=S.annuity(F.lit(36000.0), F.lit(0.0)), rate=S.annuity(F.lit(100000.0), F.lit(6.0)),
        full=S.service_hours(F.lit(5.0), F.lit(5.0)), part=S.service_hours(F.lit(1.0), F.lit(3.0)),
        year=S.period_year(F.lit(" 2023KW04 ")), short=S.period_year(F.lit("20")), code=S.gm_code(F.lit("GM0363  ")), bad=S.gm_code(F.lit("NL01")),
        nan=S.cast_to(F.lit("NaN"), "double"), yes=S.cast_to(F.lit(" Y "), "boolean"), empty=S.density(F.lit(5), F.lit(0.0)),
        mm=S.pipe_diameter_mm(F.lit(None).cast("double"), F.lit(2.0)), inch=S.pipe_diameter_in(F.lit(254.0), F.lit(99.0)),
        none=S.round_or_null(F.lit(0.0), 1), r=S.price_to_rent(F.lit(10.0), F.lit(0.0)),
    ).first()
    assert (r.zero_rate, r.rate, r.full, r.part) == (100.0, 599.55, 24.0, 8.0)
    assert (r.year, r.short, r.code, r.bad, r.nan, r.yes, r.empty) == (2023, None, 363, None, None, True, None)
    assert (r.mm, r.inch, r.none, r.r) == (50.8, 10.0, None, 0.0)


# --- hierarchy ------------------------------------------------------------------------


def test_rollup_keeps_empty_parents(spark):
    p = spark.createDataFrame([(1, 9, 10.0), (2, None, 0.0)], "id long, population long, area_km2 double")
    c = spark.createDataFrame([(1, 1, 0, 2.0)], "id long, province_id long, population long, area_km2 double")
    d = spark.createDataFrame([("D", 1, 0, 0.0)], "id string, city_id long, population long, area_km2 double")
    n = spark.createDataFrame([("a", "D", 30), ("b", "D", 10), ("c", None, 99)], "id string, district_id string, population long")
    d2, c2, p2 = HI.rollup_population(n, d, c, p)
    assert (d2.first().population, d2.first().density) == (40, None)
    assert (c2.first().population, c2.first().density) == (40, 20.0)
    assert {r.id: (r.population, r.density) for r in p2.collect()} == {1: (40, 4.0), 2: (0, None)}


def test_climb_needs_no_fact_row_more_than_once(spark):
    facts = spark.createDataFrame([(1, 5.0)] * 300 + [(2, 7.0), (9, 1.0)], "prop long, v double")
    prop = spark.createDataFrame([(1, 10), (2, 10)], "id long, building_id long")
    building = spark.createDataFrame([(10, 100)], "id long, province_id long")
    out = HI.climb(facts, "prop", {"s": F.sum("v"), "n": F.count("*")}, [(prop, "id", "building_id"), (building, "id", "province_id")])
    assert [tuple(r) for r in out.collect()] == [(100, 1507.0, 301)]


def test_price_index_gap_year_has_no_change(spark):
    bridge = spark.createDataFrame([("N", "D", 1, 1)], "neighborhood_id string, district_id string, city_id long, province_id long")
    hpi = spark.createDataFrame([(1, "N", 2020, 100.0), (2, "N", 2021, 110.0), (3, "N", 2023, 120.0), (4, "N", 2024, 0.0)], "id long, neighborhood_id string, year int, value double")
    got = {r.year: (r.avg_index, r.yoy_change_pct) for r in H.house_price_index(hpi, bridge, spark.createDataFrame([(1,)], "id long"), [2020, 2021, 2022, 2023, 2024]).collect()}
    assert got == {2020: (100.0, None), 2021: (110.0, 10.0), 2022: (None, None), 2023: (120.0, None), 2024: (None, None)}


def test_latest_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, 1, 2020, "a"), (2, 1, 2020, "b"), (3, 1, None, "c")], "id long, k long, year int, v string")
    assert X.latest_by(df, ["k"], "year").first().v == "b"
    assert X.first_by(df, ["k"]).first().v == "a"


# --- rasters --------------------------------------------------------------------------


def _stations(spark, n=12):
    rng = np.random.default_rng(3)
    rows = [(1, i, float(x), float(y), float(v)) for i, (x, y, v) in enumerate(rng.uniform(0, 100, (n, 3)))]
    return rows, spark.createDataFrame(rows, "raster_id long, station_id long, x double, y double, value double")


def _bounds(spark):
    return spark.createDataFrame([(1, 0.0, 0.0, 100.0, 50.0)], "raster_id long, xmin double, ymin double, xmax double, ymax double")


def test_grid_excludes_its_upper_ends(spark):
    g = R.make_grid(_bounds(spark), 10.0)
    assert g.count() == 50 and g.agg(F.max("x"), F.max("y")).first()[:] == (90.0, 40.0)
    assert R.make_grid(_bounds(spark), 0.5).select("col", "row").distinct().count() == 200 * 100
    with pytest.raises(ValueError):
        R.make_grid(_bounds(spark), 0.0)


def test_idw_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(R, "STATION_CHUNK", 5)
    rows, values = _stations(spark)
    s = np.array(rows)[:, 2:]
    for r in R.interpolate_idw(_bounds(spark), values, 25.0).collect():
        w = 1 / (np.hypot(s[:, 0] - r.x, s[:, 1] - r.y) + 1e-10)
        assert r.value == pytest.approx((w * s[:, 2]).sum() / w.sum())


def test_zonal_stats_and_nodata(spark):
    cells = spark.createDataFrame([(1, 1.0, 1.0, 2.0), (1, 2.0, 1.0, 4.0), (1, 3.0, 1.0, None), (1, 50.0, 1.0, 9.0)], "raster_id long, x double, y double, value double")
    zone = one(spark, zone_id=1, geom=G.box(0, 0, 10, 10))
    r = R.zonal_stats(cells, zone).first()
    assert (r["min"], r["max"], r["mean"], r["stddev"], r["count"]) == (2.0, 4.0, 3.0, 1.0, 2)


def test_reproject_same_grid_is_identity(spark):
    cells = spark.range(12).selectExpr("1L AS raster_id", "id % 4 AS col", "id div 4 AS row", "100D + 10 * (id % 4) AS x", "200D + 10 * (id div 4) AS y", "CAST(id AS DOUBLE) AS value")
    for m in ("bilinear", "nearest"):
        got = {(r.col, r.row): r.value for r in R.reproject_cells(cells, cells.drop("value"), G.RD, G.RD, m).collect()}
        assert got == {(r.col, r.row): r.value for r in cells.collect()}
    mid = spark.createDataFrame([(1, 0, 0, 105.0, 205.0)], "raster_id long, col long, row long, x double, y double")
    assert R.reproject_cells(cells, mid, G.RD, G.RD).first().value == pytest.approx((0 + 1 + 4 + 5) / 4)


def test_overviews_take_the_lowest_cell(spark):
    cells = spark.range(64).selectExpr("1L AS raster_id", "id % 8 AS col", "id div 8 AS row", "CAST(id AS DOUBLE) AS value")
    got = R.overviews(cells, 3).groupBy("level").agg(F.count("*").alias("n"), F.max("value").alias("m")).orderBy("level").collect()
    assert [(r.level, r.n, r.m) for r in got] == [(1, 16, 54.0), (2, 4, 36.0), (3, 1, 0.0)]


def test_latest_raster_must_touch(spark):
    zone = one(spark, id=1, geom=G.box(0, 0, 10, 10))
    cells = spark.createDataFrame([(1, 0, 0, 2.0, 2.0, 5.0), (1, 1, 1, 8.0, 8.0, 7.0), (2, 0, 0, 90.0, 90.0, 1.0)], "raster_id long, col long, row long, x double, y double, value double")
    rasters = spark.createDataFrame([(1, "pet", 1), (2, "pet", 2)], "id long, kind string, date_time int")
    got = U.thermal_indices(cells, rasters, zone).collect()
    assert [(r.raster_id, r["mean"]) for r in got] == [(1, 6.0)]


def test_mosaic_fills_gaps_from_the_next_scene(spark):
    scenes = spark.createDataFrame([(1, 5.0, "2024-01-02"), (2, 50.0, "2024-01-03"), (3, 0.0, "2023-01-01")], "id long, cloud_pct double, date string")
    cells = spark.createDataFrame([(1, "B", 0, 0, None), (2, "B", 0, 0, 7.0), (1, "B", 1, 0, 3.0), (2, "B", 1, 0, 4.0), (3, "B", 1, 0, 9.0)], "raster_id long, band string, col long, row long, value double")
    got = R.mosaic_least_cloud(scenes, cells, F.lit("2024-01-01").cast("date"), F.lit("2024-02-01").cast("date"))
    assert {r.col: r.value for r in got.collect()} == {0: 7.0, 1: 3.0}


# --- imports --------------------------------------------------------------------------


def test_upsert_only_touches_given_columns(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, name string, n long")
    upd = spark.createDataFrame([(2, 21, 1), (2, None, 2), (3, 30, 1)], "id long, n long, seq long")
    assert sorted(tuple(r) for r in Q.upsert(target, upd, ["id"], "seq").collect()) == [(1, "a", 10), (2, "b", 21), (3, None, 30)]
    with pytest.raises(ValueError):
        Q.upsert(target, upd.withColumnRenamed("n", "other"), ["id"], "seq")


def test_dry_run_writes_nothing(spark):
    target = spark.createDataFrame([(1, "a")], "id long, name string")
    upd = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "c", 3)], "id long, name string, line long")
    same, report = Q.run_import(target, upd, ["id"], ["name"], "line")
    assert same.count() == 1
    r = report.first()
    assert (r.total_rows, r.created, r.updated, r.skipped, r.errors, list(r.sample_errors)) == (3, 1, 0, 1, 1, ["missing key id"])
    new, _ = Q.run_import(target, upd, ["id"], ["name"], "line", dry_run=False)
    assert sorted(tuple(x) for x in new.collect()) == [(1, "a"), (2, "b")]
    halted, r = Q.run_import(target, upd, ["id"], ["name"], "line", dry_run=False, max_errors=0)
    assert r.first().stopped and halted.count() == 1


def test_foreign_key_prefers_the_name(spark):
    parent = spark.createDataFrame([(1, "Delft"), (2, "1")], "id long, name string")
    df = spark.createDataFrame([(" delft ",), ("1",), ("2",), ("x",), (None,)], "city string")
    assert [r.city_id for r in Q.resolve_fk(df, "city", parent).collect()] == [1, 2, 2, None, None]


def test_acquisition_date_chain(spark):
    df = spark.createDataFrame([("2024:05:31 10:20:30", "2020-01-01"), (None, "2020-01-01"), ("junk", "junk")], "tag string, acq string")
    got = df.select(files.acquisition_date(F.col("tag"), F.col("acq"), F.lit("2000-02-03"))).collect()
    assert [str(r[0]) for r in got] == ["2024-05-31", "2020-01-01", "2000-02-03"]


def test_geojson_of_an_empty_layer(spark, tmp_path):
    empty = one(spark, id=1, geom=G.point(1.0, 2.0)).limit(0)
    assert K.to_geojson(empty).collect() == []
    assert L.layer_extent(empty).first().xmin is None


def test_unused_theme_shows_nothing(spark):
    inv = L.layer_inventory([("builtup", "park", one(spark, id=1, geom=G.box(0, 0, 1, 1)))])
    assert L.layers_for_theme(inv, "overview").count() == 0
    assert L.layers_for_theme(inv, "builtup").first().kind == "polygon"


def test_nothing_is_cross_joined(spark):
    """Global scalars and scenarios must not add a nested-loop join."""
    p = spark.range(1000).withColumnRenamed("id", "id")
    one_row = spark.range(5).agg(F.sum("id").alias("s"))
    df = HI.with_scenarios(HI.with_global(p, one_row, "g"), [1.0, 2.0], "sc")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_box_filters_reach_the_stored_layer(spark, tmp_path):
    path = str(tmp_path / "layer")
    spark.range(20).select("id", F.expr("CAST(id * 1000 AS DOUBLE) AS x")).select("id", G.box("x", "x", "x + 10", "x + 10").alias("geom")).write.parquet(path)
    near = L.clip_to_box(spark.read.parquet(path), (2500.0, 2500.0, 5500.0, 5500.0), G.RD, G.RD)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert all(f"geom.bbox.{side}" in plan.split("PushedFilters")[1] for side in ("xmin", "xmax", "ymin", "ymax"))
    assert sorted(r.id for r in near.collect()) == [3, 4, 5]
