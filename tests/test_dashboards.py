"""The dashboards read every table once, and the fact table keeps levels, years and defaults apart."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citylake.plans import dashboards as D
from citylake.plans.facts import AFTER, BEFORE, PREVIOUS, Facts, greatest, means, number, number_if, total
from citylake.queries.standin import City

SF = "/root/testdata/sf0.001"
PLANS = {
    "water": (lambda t: D.water_indicators(t, [1996, 1997]), {"province": 3, "well": 2}),  # shape twice, attributes; wells with and without a place
    "housing": (lambda t: D.housing_indicators(t, [1996, 1997]), {}),
    "heat": (lambda t: D.heat_indicators(t), {"province": 5}),  # attributes, and the shape for features, cells, extents and stations
}


class Landed(City):
    """Every table in files of its own, so that its scans can be told apart in a plan."""

    def __init__(self, spark, sf_dir, folder):
        super().__init__(spark, sf_dir)
        self.folder, self.seen = folder, {}

    def __getitem__(self, name):
        if name not in self.seen:
            path = f"{self.folder}/{name}.table"
            City.__getitem__(self, name).write.parquet(path)
            self.seen[name] = self.spark.read.parquet(path)
        return self.seen[name]


@pytest.mark.parametrize("name", list(PLANS))
def test_each_table_is_read_once(spark, tmp_path, name):
    plan, allowed = PLANS[name]
    t = Landed(spark, SF, tmp_path)
    df = plan(t)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    tables = [x for x in map(leaves.apply, range(leaves.size())) if x.nodeName() == "LogicalRelation"]
    paths = [x.relation().location().rootPaths().head().toString() for x in tables]
    scans = Counter(re.search(r"/(\w+)\.table", p)[1] for p in paths)
    extents = {"cells": 2} if name == "heat" and "geom" not in t["heat_raster"].columns else {}
    assert {k: n for k, n in scans.items() if n > 1} == {k: n for k, n in {**allowed, **extents}.items() if n > 1}
    assert set(scans) == set(t.seen)


def tables(spark):
    city = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, None)], "id long, province_id long")
    district = spark.createDataFrame([(100, 1), (200, 2), (300, 3), (400, 9)], "id long, city_id long")
    province = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c")], "id long, name string")
    return province, [("district_id", district, "id", "city_id"), ("city_id", city, "id", "province_id")]


def test_levels_years_and_defaults(spark):
    province, parents = tables(spark)
    low = spark.createDataFrame([(100, 1, 2.0), (100, 1, None), (200, 2, 4.0), (300, 1, 8.0), (400, 1, 100.0), (None, 1, 9.0)], "district_id long, year int, v double")
    mid = spark.createDataFrame([(1, 5), (3, 7), (4, 11), (None, 13)], "city_id long, n int")
    top = spark.createDataFrame([(10, 1, 3), (10, 1, 6), (20, 3, 9), (None, 1, 1)], "province_id long, year int, level int")
    facts = Facts([1, 2])
    facts.add("low", low, "district_id", {**means(["v"]), "rows": number(), "large": number_if(F.col("v") > 3)}, "year")
    facts.add("mid", mid, "city_id", {"n": total("n")})
    facts.add("top", top, "province_id", {"level": greatest("level")}, "year")
    got = {(r["province_id"], r["year"]): r.asDict() for r in facts.wide(province, parents, [F.col("name").alias("province")]).collect()}
    assert set(got) == {(p, y) for p in (10, 20, 30) for y in (1, 2)}
    pick = lambda p, y: tuple(got[p, y][c] for c in ("_s_v", "_n_v", "rows", "large", "n", "level"))
    assert pick(10, 1) == (2.0, 1, 2, 0, 5, 6) and pick(10, 2) == (4.0, 1, 1, 1, 5, None)
    assert pick(20, 1) == (8.0, 1, 1, 1, 7, None) and pick(20, 2) == (None, None, None, None, 7, None)
    assert pick(30, 1) == (None,) * 6 and got[30, 2]["province"] == "c"


def test_years_before_after_and_previous(spark):
    province, _ = tables(spark)
    rows = spark.createDataFrame([(10, y, 10**k) for k, y in enumerate((1, 2, 3, 4))], "province_id long, year int, v long")
    facts = Facts([2, 3])
    facts.add("built", rows, "province_id", {"done": total("v", BEFORE), "planned": total("v", AFTER)}, "year")
    facts.add("price", rows, "province_id", {"now": total("v"), "before": total("v", PREVIOUS)}, "year")
    got = {r["year"]: (r["done"], r["planned"], r["now"], r["before"]) for r in facts.wide(province).where("province_id = 10").collect()}
    assert got == {2: (11, 1100, 10, 1), 3: (111, 1000, 100, 10)}


def test_a_level_costs_one_exchange_whatever_the_facts(spark):
    province, parents = tables(spark)
    low = spark.createDataFrame([(100, 1.0)], "district_id long, v double")

    def exchanges(n):
        facts = Facts([1])
        for k in range(n):
            facts.add(f"fact {k}", low, "district_id", {f"v{k}": total("v")})
        return facts.wide(province, parents)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert exchanges(1) == exchanges(6)
