"""City tables derived from the star-schema test tables.

Every text below is plain SQL that reads the same in Spark and in the checking engine, so the two
sides start from the same rows. Derived measures are whole or dyadic numbers: their sums do not
depend on the order of addition. Geometry is built from the derived coordinates in Spark only.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citylake.functions import geometry as G
from citylake.operators.hierarchy import hierarchy

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
# The reporting period that the queries ask for; the query reporting_period lists any fact outside it.
YEARS = list(range(1995, 2002))


def _xy(key: str) -> str:
    """Scattered coordinates on the national grid; the quarter keeps them off all zone boundaries."""
    return (
        f"CAST(100000 + ({key} * 7919) % 149000 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS x, "
        f"CAST(400000 + ({key} * 104729) % 149000 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS y"
    )


_O_YEAR = "CAST(year(o_orderdate) AS INT)"

SQL: dict[str, str] = {
    # --- administrative hierarchy
    "province": """
        SELECT r_regionkey AS id, r_name AS name,
               CASE WHEN r_regionkey = 3 THEN NULL ELSE CAST(1000000 + r_regionkey * 1000 AS BIGINT) END AS population,
               CAST(CASE WHEN r_regionkey = 4 THEN 0 ELSE 3255 END AS DOUBLE) AS area_km2,
               CAST(100000 + r_regionkey * 30000 AS DOUBLE) AS x0
        FROM {region}""",
    "city": """
        SELECT n_nationkey AS id, n_regionkey AS province_id, n_name AS name,
               CAST(20000 + n_nationkey * 1370 AS BIGINT) AS population,
               CAST(n_nationkey * 10 AS DOUBLE) AS area_km2,
               CAST(101000 + (n_nationkey % 5) * 30000 AS DOUBLE) AS x0,
               CAST(400000 + floor(n_nationkey / 5) * 30000 AS DOUBLE) AS y0
        FROM {nation}""",
    "district": """
        SELECT concat(CAST(c_nationkey AS STRING), '-', c_mktsegment) AS id, c_nationkey AS city_id, c_mktsegment AS name,
               CAST(0 AS BIGINT) AS population, CAST(count(*) % 7 AS DOUBLE) AS area_km2
        FROM {customer} GROUP BY c_nationkey, c_mktsegment""",
    "neighborhood": f"""
        SELECT c_custkey AS id, concat(CAST(c_nationkey AS STRING), '-', c_mktsegment) AS district_id, c_name AS name,
               CAST(c_custkey % 900 + 100 AS BIGINT) AS population, CAST(c_custkey % 7 AS DOUBLE) AS area_km2,
               {_xy('c_custkey')}
        FROM {{customer}}""",
    # --- water
    "consumption_capita": f"""
        SELECT c_nationkey * 10000 + {_O_YEAR} AS id, c_nationkey AS city_id, {_O_YEAR} AS year,
               CAST(100 + count(*) % 50 AS DOUBLE) AS l_per_day, CAST(NULL AS DOUBLE) AS m3_yr
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
        GROUP BY c_nationkey, {_O_YEAR}""",
    "total_water_demand": f"""
        SELECT c_nationkey AS city_id, {_O_YEAR} AS year, CAST(sum(o_custkey) % 5000 AS DOUBLE) AS demand_day
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
        GROUP BY c_nationkey, {_O_YEAR}""",
    "users_location": """
        SELECT o_orderkey AS id, o_custkey AS neighborhood_id, o_orderkey % 50 + 1 AS users_total,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 120 END AS served
        FROM {orders}""",
    "metered_residential": """
        SELECT o_orderkey AS id, o_orderkey AS users_location_id, o_orderkey % 40 AS installed,
               least(o_orderkey % 39, o_orderkey % 40) AS functional,
               least(o_orderkey % 37, o_orderkey % 40) AS collected,
               CAST(1 + o_orderkey % 3 AS DOUBLE) / CAST(4 AS DOUBLE) AS tariff,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 500 AS DOUBLE) END AS consumption,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 300 AS DOUBLE) END AS recovery
        FROM {orders}""",
    "fresh_water": """
        SELECT n_nationkey AS id, n_name AS name, CAST(n_nationkey % 7 + 1 AS DOUBLE) AS quantity_mm3,
               CAST(100000 + (n_nationkey % 6) * 25000 AS DOUBLE) AS x0,
               CAST(400000 + floor(n_nationkey / 6) * 30000 AS DOUBLE) AS y0
        FROM {nation}""",
    "well": f"""
        SELECT s_suppkey AS id, s_nationkey AS source_id, CAST(s_suppkey % 50 AS DOUBLE) / CAST(64 AS DOUBLE) AS flow_m3_s,
               CAST(s_suppkey % 25 AS DOUBLE) AS hours, CAST(s_suppkey % 30 AS DOUBLE) AS kwh_h,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(0.5 AS DOUBLE) END AS co2_factor,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 700 AS DOUBLE) END AS co2_day,
               CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey % 8 AS DOUBLE) / CAST(16 AS DOUBLE) END AS opex_m3,
               CAST(s_suppkey % 5 AS DOUBLE) AS labor, CAST(s_suppkey % 6 AS DOUBLE) AS energy,
               CAST(s_suppkey % 7 AS DOUBLE) AS chemicals, CAST(1 AS DOUBLE) AS tax,
               CASE WHEN s_suppkey % 9 = 0 THEN CAST(7 AS DOUBLE) ELSE NULL END AS co2_cost,
               CAST(NULL AS DOUBLE) AS drought_damage,
               CAST(s_suppkey % 20 AS DOUBLE) / CAST(4 AS DOUBLE) AS current_mm3_yr,
               s_suppkey % 5 <> 0 AS is_active, {_xy('s_suppkey')}
        FROM {{supplier}}""",
    "imported_water": """
        SELECT s_suppkey AS id, CAST(s_suppkey % 100 AS DOUBLE) AS m3_d, CAST(1 AS DOUBLE) AS price, s_suppkey % 3 <> 0 AS is_active
        FROM {supplier}""",
    "environmental_costs": """
        SELECT CAST(count(*) % 16 AS DOUBLE) / CAST(32 AS DOUBLE) AS price_co2, CAST(count(*) % 9 AS DOUBLE) / CAST(8 AS DOUBLE) AS price_drought
        FROM {supplier}""",
    "water_treatment": f"""
        SELECT o_orderkey AS id, {_O_YEAR} AS year, CAST(90 + o_orderkey % 10 AS DOUBLE) AS efficiency,
               least(o_orderkey % 20, o_orderkey % 17) AS samples_ok, o_orderkey % 20 AS samples_taken,
               CAST(o_orderkey % 8 AS DOUBLE) / CAST(8 AS DOUBLE) AS energy, CAST(o_custkey % 100 AS DOUBLE) AS acceptance
        FROM {{orders}}""",
    "pipe": """
        SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS destination_id,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 10 * 127 AS DOUBLE) END AS diameter_mm,
               CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 9 AS DOUBLE) ELSE NULL END AS diameter_in,
               s_nationkey AS area_id,
               CAST(100000 + (s_suppkey * 7919) % 120000 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS x1,
               CAST(101000 + (s_suppkey * 7919) % 120000 + (s_suppkey % 9) * 1000 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS x2,
               CAST(400000 + (s_suppkey * 104729) % 149000 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS y
        FROM {supplier}""",
    "coverage": f"""
        SELECT o_orderkey AS id, c_nationkey AS city_id, {_O_YEAR} AS year, CAST(o_custkey % 10 AS DOUBLE) / CAST(4 AS DOUBLE) AS area_km2,
               o_orderkey % 100 AS covered, o_orderkey % 100 + o_orderkey % 50 AS total
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "loss": """
        SELECT l_orderkey * 10 + l_linenumber AS id, CAST(year(l_shipdate) AS INT) AS year,
               CASE l_linenumber WHEN 1 THEN 'CM' WHEN 2 THEN 'UA' WHEN 3 THEN 'DE' WHEN 4 THEN 'LP' WHEN 5 THEN 'LS' WHEN 6 THEN 'LM' ELSE 'OT' END AS category,
               CASE WHEN l_linenumber >= 4 THEN 'R' ELSE 'A' END AS type,
               l_quantity AS m3, CAST(l_linenumber * 5 AS DOUBLE) AS unavoidable_pct,
               CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(l_orderkey % 10 AS DOUBLE) / CAST(2 AS DOUBLE) END AS ili,
               l_shipdate AS last_updated
        FROM {lineitem}""",
    "opex": f"""
        SELECT min(o_orderkey) AS id, {_O_YEAR} AS year, o_orderpriority AS label, sum(CAST(floor(o_totalprice) AS DOUBLE)) AS total
        FROM {{orders}} GROUP BY {_O_YEAR}, o_orderpriority""",
    "drought_area": f"""
        SELECT o_orderkey AS id, n_regionkey AS province_id, {_O_YEAR} AS year, CAST(o_orderkey % 6 AS INT) AS level,
               CAST(o_orderkey % 16 AS DOUBLE) / CAST(4 AS DOUBLE) AS area_km2
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey""",
    "electricity_cost": f"""
        SELECT min(o_orderkey) AS id, CAST(o_orderkey % 4 AS INT) AS province_id, {_O_YEAR} AS year,
               CAST(count(*) % 8 AS DOUBLE) / CAST(8 AS DOUBLE) AS eur_kwh
        FROM {{orders}} GROUP BY CAST(o_orderkey % 4 AS INT), {_O_YEAR}""",
    # --- housing
    "housing_supply_demand": f"""
        SELECT o_orderkey AS id, c_nationkey AS city_id, {_O_YEAR} AS year,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS supply, 1 AS demand
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "housing_project": f"""
        SELECT o_orderkey AS id, o_custkey AS neighborhood_id, {_O_YEAR} AS year_completion, o_orderkey % 25 AS units
        FROM {{orders}}""",
    "central_bank_policy": f"""
        SELECT min(o_orderkey) AS id, n_regionkey AS province_id, {_O_YEAR} AS year, o_orderpriority AS label,
               CAST(count(*) % 9 AS DOUBLE) / CAST(2 AS DOUBLE) AS rate, CAST(90 + count(*) % 10 AS DOUBLE) AS ltv, CAST(count(*) % 6 AS DOUBLE) AS lti
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
        GROUP BY n_regionkey, {_O_YEAR}, o_orderpriority""",
    "credit_supply": f"""
        SELECT min(o_orderkey) AS id, n_regionkey AS province_id, {_O_YEAR} AS year, o_orderstatus AS label,
               CAST(count(*) % 12 AS DOUBLE) / CAST(2 AS DOUBLE) AS rate, CAST(count(*) % 100 AS DOUBLE) AS approval, CAST(count(*) % 30 AS DOUBLE) AS down_payment
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
        GROUP BY n_regionkey, {_O_YEAR}, o_orderstatus""",
    "building": f"""
        SELECT o_orderkey AS id, o_custkey AS neighborhood_id, CAST(o_orderkey % 30 AS DOUBLE) AS height,
               CAST(o_orderkey % 400 AS DOUBLE) AS footprint,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 12 END AS units,
               o_orderkey % 7 = 0 AS vacant,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 20 AS DOUBLE) END AS vacancy_rate,
               {_xy('o_orderkey')}
        FROM {{orders}}""",
    "property": """
        SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS building_id, max(l_quantity) AS living_area,
               CAST(floor(max(l_extendedprice)) AS DOUBLE) AS sale, CAST(floor(max(l_extendedprice)) AS DOUBLE) + 500 AS listing,
               CAST(floor(max(l_extendedprice) / max(l_quantity)) AS DOUBLE) AS per_sqm
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "mortgage": """
        SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey * 8 + l_linenumber AS property_id,
               CAST(floor(l_extendedprice) AS DOUBLE) AS loan, CAST(l_linenumber AS DOUBLE) AS rate, l_quantity * 8 AS monthly
        FROM {lineitem} WHERE l_returnflag = 'A'""",
    "rental": """
        SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey * 8 + l_linenumber AS property_id,
               l_quantity * 10 AS monthly, l_quantity * 120 AS annual, CAST(l_partkey % 40 AS DOUBLE) AS price_to_rent
        FROM {lineitem} WHERE l_returnflag = 'R'""",
    "house_price_index": f"""
        SELECT o_orderkey AS id, o_custkey AS neighborhood_id, {_O_YEAR} AS year, CAST(o_orderkey % 200 AS DOUBLE) AS value
        FROM {{orders}}""",
    "affordability": f"""
        SELECT o_orderkey AS id, o_custkey AS neighborhood_id, {_O_YEAR} AS year,
               CASE WHEN o_orderkey % 50 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(floor(o_totalprice) AS DOUBLE) END AS income,
               CAST(floor(o_totalprice / 2) AS DOUBLE) AS expenditure, CAST(o_orderkey % 2000 AS DOUBLE) AS rent,
               CAST(o_custkey % 1500 AS DOUBLE) AS mortgage, CAST(floor(o_totalprice) AS DOUBLE) * 4 AS price,
               CAST(floor(o_totalprice) AS DOUBLE) - CAST(floor(o_totalprice / 2) AS DOUBLE) AS disposable,
               CAST(o_orderkey % 12 AS DOUBLE) AS index,
               CASE WHEN o_orderkey % 4 = 0 THEN 'low' WHEN o_orderkey % 4 = 1 THEN 'moderate' WHEN o_orderkey % 4 = 2 THEN 'high' ELSE 'unknown' END AS stress
        FROM {{orders}}""",
    "zoning_area": """
        SELECT p_partkey AS id, p_partkey AS neighborhood_id,
               CASE p_size % 5 WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' WHEN 2 THEN 'industrial' WHEN 3 THEN 'mixed' ELSE 'other' END AS type,
               CAST(floor(p_retailprice) AS DOUBLE) AS area,
               CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size * 100 AS DOUBLE) END AS benchmark
        FROM {part}""",
    # --- heat
    "park": f"""
        SELECT p_partkey AS id, CAST(floor(p_retailprice) AS DOUBLE) AS area, {_xy('p_partkey')} FROM {{part}}""",
    "land_cover_class": "SELECT p_partkey AS id, p_name AS class_name FROM {part}",
    "land_cover": f"""
        SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_suppkey % 5 AS INT) AS province_id, l_partkey AS class_id, l_quantity / CAST(1024 AS DOUBLE) AS percentage
        FROM {{lineitem}}""",
    "street": f"SELECT o_orderkey AS id, CAST(o_orderkey % 12 AS DOUBLE) AS width, {_xy('o_orderkey + 3')} FROM {{orders}}",
    "nbs_polygon": f"SELECT p_partkey AS id, p_name AS name, CAST(p_size * 50 AS DOUBLE) AS area, {_xy('p_partkey + 11')} FROM {{part}}",
    "nbs_point": f"SELECT c_custkey AS id, c_name AS name, {_xy('c_custkey + 17')} FROM {{customer}}",
    "station": f"""
        SELECT user_id AS id, concat('station ', CAST(user_id AS STRING)) AS name, user_id % 4 <> 0 AS is_active, {_xy('user_id')}
        FROM {{events}} GROUP BY user_id""",
    "measurement": """
        SELECT user_id AS station_id, ts AS date,
               CASE WHEN event_type = 'click' THEN CAST(floor(value) AS DOUBLE) END AS temperature,
               CASE WHEN event_type = 'view' THEN CAST(floor(value) AS DOUBLE) END AS humidity,
               CASE WHEN event_type = 'error' THEN CAST(floor(value) AS DOUBLE) END AS wind,
               CASE WHEN event_type = 'signup' THEN CAST(floor(value) AS DOUBLE) END AS precipitation,
               CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS DOUBLE) END AS radiation
        FROM {events}""",
    # --- rasters
    "cells": """
        SELECT CAST(o_orderkey % 12 AS BIGINT) AS raster_id, CAST(o_orderdate AS DATE) AS date, 'b1' AS band,
               CAST(floor(o_orderkey / 12) AS BIGINT) % 50 AS col, CAST(floor(o_orderkey / 600) AS BIGINT) AS row,
               CAST((CAST(floor(o_orderkey / 12) AS BIGINT) % 50) * 3000 + 101500 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS x,
               CAST(CAST(floor(o_orderkey / 600) AS BIGINT) * 500 + 400250 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS y,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_custkey % 60 AS DOUBLE) END AS value
        FROM {orders}""",
    "heat_raster": """
        SELECT CAST(o_orderkey % 12 AS BIGINT) AS id,
               CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'lst' WHEN 1 THEN 'tmrt' WHEN 2 THEN 'pet' WHEN 3 THEN 'utci' WHEN 4 THEN 'svf' ELSE 'suhii' END AS kind,
               CAST(min(o_orderkey) AS INT) AS date_time
        FROM {orders} GROUP BY o_orderkey % 12, o_orderkey % 6""",
    "raster_meta": """
        SELECT o_orderkey AS id,
               CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'temperature' WHEN 1 THEN 'precipitation' WHEN 2 THEN 'humidity' ELSE 'wind' END AS kind,
               concat('raster ', CAST(o_orderkey AS STRING)) AS name, CAST(o_orderdate AS DATE) AS date, o_orderdate AS created_at,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'stored' END AS product_path
        FROM {orders}""",
    "exports": "SELECT DISTINCT l_orderkey AS raster_id FROM {lineitem}",
    "band_cells": """
        SELECT l_suppkey % 10 AS raster_id,
               CASE l_linenumber WHEN 1 THEN 'B02' WHEN 2 THEN 'B03' WHEN 3 THEN 'B04' WHEN 4 THEN 'B08' WHEN 5 THEN 'B8A' WHEN 6 THEN 'B11' ELSE 'B12' END AS band,
               l_orderkey % 97 AS col, l_partkey % 89 AS row, max(l_quantity) AS value
        FROM {lineitem} GROUP BY l_suppkey % 10, l_linenumber, l_orderkey % 97, l_partkey % 89""",
    "scene": """
        SELECT s_suppkey AS id, CAST((s_suppkey * 37) % 100 AS DOUBLE) AS cloud_pct,
               CAST('2024-01-01' AS DATE) + CAST(s_suppkey % 60 AS INT) AS date
        FROM {supplier}""",
    "scene_cells": """
        SELECT l_suppkey AS raster_id, CAST(l_shipdate AS DATE) AS date,
               CASE WHEN l_linenumber < 4 THEN 'label' ELSE 'tree' END AS band,
               l_partkey % 50 AS col, l_orderkey % 50 AS row,
               CAST((l_partkey % 50) * 3000 + 101500 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS x,
               CAST((l_orderkey % 50) * 3000 + 401500 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS y,
               max(l_quantity) AS value
        FROM {lineitem}
        GROUP BY l_suppkey, CAST(l_shipdate AS DATE), CASE WHEN l_linenumber < 4 THEN 'label' ELSE 'tree' END, l_partkey % 50, l_orderkey % 50""",
}

# SQL that builds on the tables above
BRIDGE_SQL = """
    SELECT n.id AS neighborhood_id, d.id AS district_id, c.id AS city_id, c.province_id
    FROM neighborhood n JOIN district d ON n.district_id = d.id JOIN city c ON d.city_id = c.id"""
YEARS_SQL = f"SELECT CAST(unnest({YEARS}) AS INT) AS year"


def _square(x: str, y: str, side: float) -> Column:
    return G.box(x, y, f"{x} + {side}", f"{y} + {side}")


def _province_shape() -> Column:
    """A strip without its upper right quarter, and with a rectangular hole."""
    x, mid, end = "x0", "x0 + 15000", "x0 + 30000"
    shell = [(x, 400000), (end, 400000), (end, 475000), (mid, 475000), (mid, 550000), (x, 550000), (x, 400000)]
    a, b = "x0 + 3000", "x0 + 9000"
    return G.polygon(shell, [[(a, 420000), (a, 440000), (b, 440000), (b, 420000), (a, 420000)]])


GEOM = {
    "province": _province_shape,
    "city": lambda: G.box("x0", "y0", "x0 + 20000", "y0 + 30000"),
    "neighborhood": lambda: _square("x", "y", 400),
    "fresh_water": lambda: _square("x0", "y0", 28001),
    "well": lambda: G.point("x", "y"),
    "pipe": lambda: G.line([("x1", "y"), ("x2", "y")]),
    "building": lambda: _square("x", "y", 40),
    "park": lambda: _square("x", "y", 300),
    "street": lambda: G.line([("x", "y"), ("x", "y + 200")]),
    "nbs_polygon": lambda: _square("x", "y", 150),
    "nbs_point": lambda: G.point("x", "y"),
    "station": lambda: G.point("x", "y"),
}


class City:
    """The city tables of one scale-factor directory: ``t["well"]``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}
        self._base: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._base:
            self._base[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._base[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.bridge if name == "bridge" else self._load(name)
        return self._cache[name]

    def _load(self, name: str) -> DataFrame:
        text = SQL[name]
        used = {b: self.base(b) for b in BASE if "{" + b + "}" in text}
        df = self.spark.sql(text, **used)
        if name not in GEOM:
            return df
        return df.withColumn("geom", GEOM[name]())

    @cached_property
    def bridge(self) -> DataFrame:
        return hierarchy(self["neighborhood"], self["district"], self["city"])


def oracle(tables: str, body: str, **extra: str) -> str:
    """Check query: the named city tables as common table expressions, then the body."""
    names = tables.split()
    if "bridge" in names:
        names = [n for n in ("neighborhood", "district", "city") if n not in names] + names
    parts = []
    for n in names:
        if n == "bridge":
            text = BRIDGE_SQL
        elif n == "years":
            text = YEARS_SQL
        else:
            text = SQL[n].format(**{b: b for b in BASE})
        parts.append(f"{n} AS ({text})")
    parts += [f"{n} AS ({text})" for n, text in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def rnd(expr: str, digits: int) -> str:
    """Half-up rounding of a double as it prints, by way of its text and a decimal."""
    return f"CAST(round(CAST(CAST(CAST(({expr}) AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 14)), {digits}) AS DOUBLE)"


def in_province(x: str, y: str, p: str = "p") -> str:
    """Point in the province shape."""
    return (
        f"({x} BETWEEN {p}.x0 AND {p}.x0 + 30000 AND {y} BETWEEN 400000 AND 550000 "
        f"AND NOT ({x} > {p}.x0 + 15000 AND {y} > 475000) "
        f"AND NOT ({x} > {p}.x0 + 3000 AND {x} < {p}.x0 + 9000 AND {y} > 420000 AND {y} < 440000))"
    )


def box_hits(x1: str, y1: str, x2: str, y2: str, p: str = "p") -> str:
    """Axis-parallel box (or segment) meets the province shape."""
    meets = lambda a, b, c, d: f"({x1} <= {c} AND {x2} >= {a} AND {y1} <= {d} AND {y2} >= {b})"
    left = meets(f"{p}.x0", "400000", f"{p}.x0 + 15000", "550000")
    right = meets(f"{p}.x0 + 15000", "400000", f"{p}.x0 + 30000", "475000")
    hole = f"({x1} > {p}.x0 + 3000 AND {x2} < {p}.x0 + 9000 AND {y1} > 420000 AND {y2} < 440000)"
    return f"(({left} OR {right}) AND NOT {hole})"


def sql_poly(terms, a: str, b: str) -> str:
    """A reprojection polynomial as text, with the terms in the same order as the library's."""
    return " + ".join(f"({' * '.join([a] * p + [b] * q + [f'CAST({c!r} AS DOUBLE)'])})" for p, q, c in terms)


def sql_lon_lat(x: str, y: str) -> tuple[str, str]:
    dx, dy = f"(({x} - 155000) * 1e-5)", f"(({y} - 463000) * 1e-5)"
    return (
        f"(({sql_poly(G._LON, dx, dy)}) / 3600 + CAST({G._LON0!r} AS DOUBLE))",
        f"(({sql_poly(G._LAT, dx, dy)}) / 3600 + CAST({G._LAT0!r} AS DOUBLE))",
    )


def sql_rd(lon: str, lat: str) -> tuple[str, str]:
    dlat, dlon = f"(({lat} - CAST({G._LAT0!r} AS DOUBLE)) * 0.36)", f"(({lon} - CAST({G._LON0!r} AS DOUBLE)) * 0.36)"
    return (
        f"(({sql_poly(G._X, dlat, dlon)}) + 155000)",
        f"(({sql_poly(G._Y, dlat, dlon)}) + 463000)",
    )
