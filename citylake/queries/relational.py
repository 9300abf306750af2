"""Scalar, selection, hierarchy, water and housing queries on the derived city tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citylake.functions import scalars as S
from citylake.operators import hierarchy as HI
from citylake.operators import housing as H
from citylake.operators import select as X
from citylake.operators import water as W
from citylake.queries.standin import YEARS, City, in_province, box_hits, oracle, rnd

QUERIES: dict = {}
ORACLES: dict = {}
YEAR_LIST = ", ".join(str(y) for y in YEARS)


def add(name, fn, sql=None):
    QUERIES[name] = lambda spark, sf, _f=fn: _f(City(spark, sf))
    if sql:
        ORACLES[name] = sql


def _case(classes, c):
    arms = " ".join(f"WHEN {c} < {b} THEN '{label}'" for b, label in classes[:-1])
    return f"CASE WHEN {c} IS NULL THEN NULL {arms} ELSE '{classes[-1][1]}' END"


# --- scalars --------------------------------------------------------------------------

add(
    "population_density",
    lambda t: t["neighborhood"].select("id", S.density("population", "area_km2").alias("density")),
    oracle("neighborhood", "SELECT id, CASE WHEN area_km2 > 0 THEN population / area_km2 END AS density FROM neighborhood"),
)
add(
    "pipe_diameters",
    lambda t: W.pipe_derived(t["pipe"].drop("geom")).select("id", "diameter_mm", "diameter_in"),
    oracle(
        "pipe",
        """SELECT id, coalesce(diameter_mm, diameter_in * CAST(25.4 AS DOUBLE)) AS diameter_mm,
                  coalesce(diameter_mm / CAST(25.4 AS DOUBLE), diameter_in) AS diameter_in FROM pipe""",
    ),
)
add(
    "well_emissions",
    lambda t: W.well_emissions(t["well"]).select("id", "co2_h", "co2_day", "co2_year"),
    oracle(
        "well",
        """SELECT id, kwh_h * co2_factor AS co2_h, kwh_h * co2_factor * hours AS co2_day,
                  kwh_h * co2_factor * hours * 365 AS co2_year FROM well""",
    ),
)
add(
    "well_opex",
    lambda t: W.well_opex(t["well"]).select("id", "opex_m3"),
    oracle("well", "SELECT id, coalesce(opex_m3, labor + energy + chemicals + tax) AS opex_m3 FROM well"),
)
add(
    "well_env_cost",
    lambda t: W.well_env_cost(t["well"], t["environmental_costs"]).select("id", "co2_cost", "drought_damage"),
    oracle(
        "well environmental_costs",
        """SELECT id, coalesce(co2_cost, co2_day * price_co2) AS co2_cost,
                  coalesce(drought_damage, co2_day * price_drought) AS drought_damage FROM well, environmental_costs""",
    ),
)
add(
    "rental_derived",
    lambda t: H.rental_derived(t["rental"], t["property"]).select("id", "monthly", "annual", "price_to_rent"),
    oracle(
        "rental property",
        """SELECT r.id, r.monthly, r.monthly * 12 AS annual,
                  CASE WHEN r.monthly * 12 = 0 THEN 0 ELSE p.sale / (r.monthly * 12) END AS price_to_rent
           FROM rental r LEFT JOIN property p ON r.property_id = p.id""",
    ),
)
add(
    "affordability_derived",
    lambda t: H.affordability_derived(t["affordability"]).select("id", "index", "disposable"),
    oracle(
        "affordability",
        """SELECT id, CASE WHEN income = 0 THEN 0 ELSE price / income END AS index,
                  income - expenditure AS disposable FROM affordability""",
    ),
)
add(
    "loss_type",
    lambda t: W.loss_types(t["loss"]).groupBy("category", "type").agg(F.count("*").alias("n")),
    oracle(
        "loss",
        """SELECT category, CASE WHEN category IN ('LP', 'LS', 'LM', 'OT') THEN 'R' ELSE 'A' END AS type, count(*) AS n
           FROM loss GROUP BY 1, 2""",
    ),
)
_temp = "CAST(o_custkey % 110 AS DOUBLE) - 50"
add(
    "classify_pet",
    lambda t: t.base("orders").select("o_orderkey", S.classify_pet(F.expr(_temp)).alias("category")),
    f"SELECT o_orderkey, {_case(S.PET_CLASSES, f'({_temp})')} AS category FROM orders",
)
add(
    "classify_utci",
    lambda t: t.base("orders").select("o_orderkey", S.classify_utci(F.expr(_temp)).alias("category")),
    f"SELECT o_orderkey, {_case(S.UTCI_CLASSES, f'({_temp})')} AS category FROM orders",
)


def _bands(t):
    v = F.col("o_custkey") % 60 / 10
    c = S.classify_pet(F.expr(_temp))
    return t.base("orders").select(
        "o_orderkey", S.band_ili(v).alias("ili"), S.band_aspect(v).alias("aspect"), S.band_suhii(v).alias("suhii"),
        S.band_thermal(c).alias("thermal"),
    )


add(
    "display_bands",
    _bands,
    f"""WITH b AS (SELECT o_orderkey, o_custkey % 60 / 10 AS v, {_case(S.PET_CLASSES, f'({_temp})')} AS c FROM orders)
        SELECT o_orderkey, CASE WHEN v <= 2 THEN 'good' WHEN v <= 4 THEN 'fair' ELSE 'poor' END AS ili,
               CASE WHEN v > 1.5 THEN 'high' WHEN v > 1 THEN 'medium' ELSE 'low' END AS aspect,
               CASE WHEN v > 4 THEN 'high' WHEN v > 2 THEN 'medium' ELSE 'low' END AS suhii,
               CASE WHEN c LIKE '%Heat%' THEN 'hot' WHEN c LIKE '%Cold%' THEN 'cold' ELSE 'neutral' END AS thermal
        FROM b""",
)
add(
    "capped_percent",
    lambda t: t.base("orders").select("o_orderkey", S.capped_pct(F.col("o_custkey"), 300).alias("pct")),
    "SELECT o_orderkey, least(CAST(o_custkey AS DOUBLE) / CAST(300 AS DOUBLE) * 100, 100) AS pct FROM orders",
)
add(
    "service_hours",
    lambda t: t.base("lineitem").select(
        "l_orderkey", "l_linenumber", S.service_hours(F.col("l_quantity"), F.col("l_partkey").cast("double")).alias("hours")
    ),
    f"""SELECT l_orderkey, l_linenumber,
               CASE WHEN l_quantity >= l_partkey THEN 24 ELSE {rnd('24 * l_quantity / l_partkey', 1)} END AS hours FROM lineitem""",
)
add(
    "annuity_payment",
    lambda t: t["mortgage"].select("id", S.annuity(F.col("loan"), F.col("rate") - 1).alias("payment")),
    oracle(
        "mortgage",
        f"""SELECT id, CASE WHEN rate - 1 > 0 THEN {rnd('loan * ((rate - 1) / 100 / 12) * pow(1 + (rate - 1) / 100 / 12, 360) / nullif(pow(1 + (rate - 1) / 100 / 12, 360) - 1, 0)', 2)}
                   ELSE {rnd('loan / 360', 2)} END AS payment FROM mortgage""",
    ),
)
add(
    "cast_values",
    lambda t: t.base("customer").select(
        "c_custkey",
        S.cast_to(F.substring("c_name", 10, 20), "long").alias("number"),
        S.cast_to(F.col("c_mktsegment"), "double").alias("not_a_number"),
        S.cast_to(F.when(F.col("c_custkey") % 2 == 0, " Yes ").otherwise("no"), "boolean").alias("flag"),
        S.cast_to(F.col("c_acctbal").cast("string"), "double").alias("balance"),
    ),
    """SELECT c_custkey, try_cast(substring(c_name, 10, 20) AS BIGINT) AS number,
              try_cast(c_mktsegment AS DOUBLE) AS not_a_number,
              c_custkey % 2 = 0 AS flag, c_acctbal AS balance FROM customer""",
)
_period = "concat(CAST(CAST(year(o_orderdate) AS INT) AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN 'JJ00' ELSE 'KW04' END)"
_short = f"CASE WHEN o_orderkey % 7 = 0 THEN '20' WHEN o_orderkey % 7 = 1 THEN 'abcdJJ' ELSE {_period} END"
add(
    "period_year",
    lambda t: t.base("orders").select("o_orderkey", S.period_year(F.expr(_short)).alias("year")),
    f"SELECT o_orderkey, CASE WHEN length({_short}) >= 4 THEN try_cast(substring({_short}, 1, 4) AS INT) END AS year FROM orders",
)
_gm = "CASE WHEN c_custkey % 9 = 0 THEN 'NL01  ' ELSE concat('GM0', CAST(c_nationkey AS STRING), '  ') END"
add(
    "municipality_code",
    lambda t: t.base("customer").select("c_custkey", S.gm_code(F.expr(_gm)).alias("code")),
    f"SELECT c_custkey, try_cast(replace(trim({_gm}), 'GM', '') AS BIGINT) AS code FROM customer",
)
add(
    "green_classes",
    lambda t: t["land_cover_class"].select("id", S.is_green("class_name").alias("green")),
    oracle("land_cover_class", f"SELECT id, regexp_matches(lower(class_name), '{'|'.join(S.GREEN_WORDS)}') AS green FROM land_cover_class"),
)
add(
    "round_or_null",
    lambda t: t.base("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", S.round_or_null(F.col("l_extendedprice") * (F.col("l_linenumber") - 1) * 0.1234567, 1).alias("v")),
    f"""SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_linenumber <> 1 THEN {rnd('l_extendedprice * (l_linenumber - 1) * CAST(0.1234567 AS DOUBLE)', 1)} END AS v FROM lineitem""",
)
add(
    "zero_default",
    lambda t: t["users_location"].select("id", S.or_zero("served").alias("served")),
    oracle("users_location", "SELECT id, coalesce(served, 0) AS served FROM users_location"),
)

# --- filters --------------------------------------------------------------------------

add("active_wells", lambda t: X.active(t["well"]).select("id"), oracle("well", "SELECT id FROM well WHERE is_active"))
add(
    "known_values",
    lambda t: X.with_value(t["measurement"], "temperature").select("station_id", "temperature"),
    oracle("measurement", "SELECT station_id, temperature FROM measurement WHERE temperature IS NOT NULL"),
)
add(
    "time_window",
    lambda t: X.in_window(t["measurement"], "date", F.lit("2024-01-15 12:00:00").cast("timestamp"), 36).groupBy("station_id").agg(F.count("*").alias("n")),
    oracle(
        "measurement",
        """SELECT station_id, count(*) AS n FROM measurement
           WHERE date BETWEEN TIMESTAMP '2024-01-14 00:00:00' AND TIMESTAMP '2024-01-17 00:00:00' GROUP BY station_id""",
    ),
)
add(
    "case_insensitive_match",
    lambda t: t.base("part").where(S.iequals(F.col("p_type"), F.lit(" economy "))).select("p_partkey"),
    "SELECT p_partkey FROM part WHERE lower(trim(p_type)) = 'economy'",
)
add(
    "year_split",
    lambda t: t["housing_project"].groupBy((F.col("year_completion") <= 1998).alias("completed")).agg(F.sum("units").alias("units"), F.count("*").alias("n")),
    oracle("housing_project", "SELECT year_completion <= 1998 AS completed, CAST(sum(units) AS BIGINT) AS units, count(*) AS n FROM housing_project GROUP BY 1"),
)

# --- hierarchy ------------------------------------------------------------------------

add("hierarchy_bridge", lambda t: t["bridge"], oracle("bridge", "SELECT * FROM bridge"))
add(
    "attach_province",
    lambda t: HI.attach_province(
        t["mortgage"],
        [(t["property"], "id", "building_id"), (t["building"], "id", "neighborhood_id"), (t["bridge"], "neighborhood_id", "province_id")],
        "property_id",
    ).groupBy("province_id").agg(F.count("*").alias("n"), F.sum("loan").alias("loan")),
    oracle(
        "bridge building property mortgage",
        """SELECT province_id, count(*) AS n, sum(loan) AS loan FROM mortgage m JOIN property p ON m.property_id = p.id
           JOIN building b ON p.building_id = b.id JOIN bridge USING (neighborhood_id) GROUP BY province_id""",
    ),
)
add(
    "provinces_with_defaults",
    lambda t: HI.from_provinces(
        t["province"], t["drought_area"].groupBy("province_id", "year").agg(F.sum("area_km2").alias("a")), [1994, *YEARS]
    ).select("province_id", "year", F.coalesce("a", F.lit(0.0)).alias("area")),
    oracle(
        "province drought_area",
        f"""SELECT p.id AS province_id, y.year, coalesce(sum(d.area_km2), 0) AS area
            FROM province p CROSS JOIN (SELECT CAST(unnest([1994, {YEAR_LIST}]) AS INT) AS year) y
            LEFT JOIN drought_area d ON d.province_id = p.id AND d.year = y.year GROUP BY 1, 2""",
    ),
)
add(
    "global_scalar",
    lambda t: HI.with_global(t["province"], t["imported_water"].agg(F.sum("m3_d").alias("m3_d")), "g").select("id", F.col("g.m3_d").alias("m3_d")),
    oracle("province imported_water", "SELECT id, (SELECT sum(m3_d) FROM imported_water) AS m3_d FROM province"),
)
add(
    "scenario_grid",
    lambda t: HI.with_scenarios(t["consumption_capita"], [90.0, 120.0, 150.0], "scenario").select(
        "city_id", "year", "scenario", (F.col("l_per_day") - F.col("scenario")).alias("gap")
    ),
    oracle(
        "consumption_capita",
        """SELECT city_id, year, CAST(scenario AS DOUBLE) AS scenario, l_per_day - CAST(scenario AS DOUBLE) AS gap
           FROM consumption_capita CROSS JOIN (SELECT unnest([90, 120, 150]) AS scenario)""",
    ),
)


def _rollup(t):
    d, c, p = HI.rollup_population(t["neighborhood"], t["district"], t["city"], t["province"])
    cols = lambda df, lv: df.select(F.lit(lv).alias("level"), F.col("id").cast("string").alias("id"), "population", "density")
    return cols(d, "district").unionByName(cols(c, "city")).unionByName(cols(p, "province"))


add(
    "population_rollup",
    _rollup,
    oracle(
        "neighborhood district city province",
        """SELECT level, CAST(id AS STRING) AS id, pop AS population, CASE WHEN area_km2 > 0 THEN pop / area_km2 END AS density FROM (
             SELECT 'district' AS level, d.id, d.area_km2, CAST(coalesce(d.pop, 0) AS BIGINT) AS pop FROM d
             UNION ALL SELECT 'city', CAST(c.id AS STRING), c.area_km2, CAST(coalesce(c.pop, 0) AS BIGINT) FROM c
             UNION ALL SELECT 'province', CAST(p.id AS STRING), p.area_km2, CAST(coalesce((SELECT sum(pop) FROM c WHERE c.province_id = p.id), 0) AS BIGINT) FROM province p)""",
        d="SELECT d.id, d.city_id, d.area_km2, (SELECT sum(population) FROM neighborhood n WHERE n.district_id = d.id) AS pop FROM district d",
        c="SELECT c.id, c.province_id, c.area_km2, (SELECT sum(pop) FROM d WHERE d.city_id = c.id) AS pop FROM city c",
    ),
)
add(
    "province_population_fallback",
    lambda t: HI.fill_province_population(t["province"], t["city"]).select("id", "population", "density"),
    oracle(
        "province city",
        """SELECT p.id, CAST(coalesce(p.population, s.t) AS BIGINT) AS population,
                  CASE WHEN area_km2 > 0 THEN coalesce(p.population, s.t) / area_km2 END AS density
           FROM province p LEFT JOIN (SELECT province_id, CAST(sum(population) AS BIGINT) AS t FROM city GROUP BY 1) s ON s.province_id = p.id""",
    ),
)

# --- first, latest, union -------------------------------------------------------------

add(
    "first_record",
    lambda t: X.first_by(t["opex"], ["year"]),
    oracle("opex", "SELECT year, id, label, total FROM opex QUALIFY row_number() OVER (PARTITION BY year ORDER BY id) = 1"),
)
add(
    "latest_record",
    lambda t: X.latest_by(t["consumption_capita"], ["city_id"], "year").select("city_id", "year", "l_per_day"),
    oracle(
        "consumption_capita",
        "SELECT city_id, year, l_per_day FROM consumption_capita QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY year DESC, id DESC) = 1",
    ),
)
add(
    "latest_leakage_index",
    lambda t: W.nrw(t["loss"], YEARS).select("year", "ili"),
    oracle(
        "years loss",
        """SELECT y.year, l.ili FROM years y LEFT JOIN (SELECT year, ili FROM loss WHERE type = 'R' AND ili IS NOT NULL
             QUALIFY row_number() OVER (PARTITION BY year ORDER BY last_updated DESC, id DESC) = 1) l ON l.year = y.year""",
    ),
)
add(
    "ordered_stations",
    lambda t: X.ordered_stations(t["station"]).select("id", "name"),
    oracle("station", "SELECT id, name FROM station ORDER BY name, id"),
)
add(
    "ordered_measurements",
    lambda t: X.ordered_measurements(t["measurement"]).select("station_id", F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")),
    oracle("measurement", "SELECT station_id, strftime(date, '%Y-%m-%d %H:%M:%S.%f') AS at FROM measurement ORDER BY date DESC, station_id"),
)
add(
    "union_of_layers",
    lambda t: X.union_layers(
        t["park"].select("id", F.lit("park").alias("kind")), t["well"].select("id", F.lit("well").alias("kind")), t["nbs_point"].select("id", "name", F.lit("nbs").alias("kind"))
    ),
    oracle("park well nbs_point", "SELECT id, 'park' AS kind, NULL AS name FROM park UNION ALL SELECT id, 'well', NULL FROM well UNION ALL SELECT id, 'nbs', name FROM nbs_point"),
)
add(
    "latest_raster_view",
    lambda t: X.latest_raster(t["raster_meta"]).select("kind", "id", "display_name"),
    oracle(
        "raster_meta",
        """SELECT kind, id, concat(name, ' (LATEST)') AS display_name FROM raster_meta
           QUALIFY row_number() OVER (PARTITION BY kind ORDER BY date DESC, created_at DESC, id DESC) = 1""",
    ),
)
add(
    "pending_exports",
    lambda t: X.pending_exports(t["raster_meta"], t["exports"]).select("id", "kind"),
    oracle("raster_meta exports", "SELECT id, kind FROM raster_meta WHERE id NOT IN (SELECT raster_id FROM exports)"),
)
add(
    "pending_export_counts",
    lambda t: X.pending_counts(t["raster_meta"], t["exports"]),
    oracle("raster_meta exports", "SELECT kind, count(*) AS pending FROM raster_meta WHERE id NOT IN (SELECT raster_id FROM exports) GROUP BY kind"),
)

# --- water ----------------------------------------------------------------------------

_SPINE = "FROM province p CROSS JOIN years y"
_cc = """SELECT c.province_id, cc.year, avg(cc.l_per_day) AS v FROM consumption_capita cc JOIN city c ON cc.city_id = c.id GROUP BY 1, 2"""
add(
    "water_consumption_capita",
    lambda t: W.consumption_capita(t["consumption_capita"], t["city"], t["province"], YEARS),
    oracle(
        "province years city consumption_capita",
        f"SELECT p.id AS province_id, y.year, coalesce(m.v, 0) AS consumption_capita {_SPINE} LEFT JOIN m ON m.province_id = p.id AND m.year = y.year",
        m=_cc,
    ),
)
add(
    "water_total_demand",
    lambda t: W.total_demand(t["consumption_capita"], t["city"], t["province"], YEARS),
    oracle(
        "province years city consumption_capita",
        f"SELECT p.id AS province_id, y.year, coalesce(m.v, 0) / 1000 * coalesce(p.population, 0) AS demand_m3_d {_SPINE} LEFT JOIN m ON m.province_id = p.id AND m.year = y.year",
        m=_cc,
    ),
)
add(
    "water_city_demand",
    lambda t: W.city_demand(t["city"], t["consumption_capita"]),
    oracle(
        "city consumption_capita",
        """SELECT city_id, year, population * l_per_day / 1000 AS demand_day, population * l_per_day / 1000 * 365 AS demand_yr
           FROM consumption_capita JOIN city ON city_id = city.id""",
    ),
)
add(
    "water_city_consumption_year",
    lambda t: W.city_consumption_yr(t["consumption_capita"], t["city"]).select("id", "m3_yr"),
    oracle(
        "city consumption_capita",
        "SELECT cc.id, l_per_day / 1000 * population * 365 AS m3_yr FROM consumption_capita cc JOIN city ON city_id = city.id",
    ),
)

_WELLS = f"""SELECT p.id AS province_id, sum(w.flow_m3_s) AS flow, sum(w.kwh_h * w.hours) AS kwh, sum(w.co2_day) AS co2
    FROM province p JOIN well w ON w.is_active AND {in_province('w.x', 'w.y')} GROUP BY 1"""
_IMP = "(SELECT coalesce(sum(m3_d), 0) FROM imported_water WHERE is_active)"
add(
    "water_total_extraction",
    lambda t: W.total_extraction(t["well"], t["province"]),
    oracle("province well", "SELECT p.id AS province_id, coalesce(flow, 0) * 86400 AS extraction_m3_d FROM province p LEFT JOIN s ON s.province_id = p.id", s=_WELLS),
)
add(
    "water_total_production",
    lambda t: W.total_production(t["well"], t["imported_water"], t["province"]),
    oracle(
        "province well imported_water",
        f"SELECT p.id AS province_id, coalesce(flow, 0) * 86400 + {_IMP} AS production_m3_d FROM province p LEFT JOIN s ON s.province_id = p.id",
        s=_WELLS,
    ),
)
add(
    "water_total_production_all",
    lambda t: W.total_production(t["well"], t["imported_water"]),
    oracle("well imported_water", f"SELECT coalesce(sum(flow_m3_s), 0) * 86400 + {_IMP} AS production_m3_d FROM well WHERE is_active"),
)
add(
    "water_supply_security",
    lambda t: W.supply_security(t["total_water_demand"], t["city"], t["well"], t["imported_water"], t["province"]),
    oracle(
        "province city well imported_water total_water_demand",
        """SELECT province_id, demand_m3_d, production_m3_d, CASE WHEN demand_m3_d <> 0 AND production_m3_d <> 0 THEN production_m3_d / demand_m3_d END AS supply_security
           FROM b""",
        s=_WELLS,
        b=f"""SELECT p.id AS province_id, coalesce((SELECT sum(demand_day) FROM total_water_demand d JOIN city c ON d.city_id = c.id WHERE c.province_id = p.id), 0) AS demand_m3_d,
                    coalesce(flow, 0) * 86400 + {_IMP} AS production_m3_d FROM province p LEFT JOIN s ON s.province_id = p.id""",
    ),
)
add(
    "water_energy_consumption",
    lambda t: W.energy_consumption(t["well"], t["water_treatment"], t["province"]),
    oracle(
        "province well water_treatment",
        "SELECT p.id AS province_id, coalesce(kwh, 0) + (SELECT sum(energy) FROM water_treatment) * 1000 AS energy_kwh_d FROM province p LEFT JOIN s ON s.province_id = p.id",
        s=_WELLS,
    ),
)
add(
    "water_co2_emission",
    lambda t: W.co2_emission(t["well"], t["province"]),
    oracle("province well", "SELECT p.id AS province_id, coalesce(co2, 0) AS co2_kg_d FROM province p LEFT JOIN s ON s.province_id = p.id", s=_WELLS),
)
add(
    "water_quality",
    lambda t: W.water_quality(t["water_treatment"], [1994, *YEARS]),
    oracle(
        "water_treatment",
        f"""SELECT y.year, coalesce(taken, 0) AS samples_taken, coalesce(ok, 0) AS samples_ok,
               CASE WHEN taken <> 0 THEN {rnd('CAST(ok AS DOUBLE) / taken * 100', 1)} END AS compliance_pct,
               CASE WHEN eff <> 0 THEN {rnd('eff', 1)} END AS treatment_efficiency,
               CASE WHEN acc <> 0 THEN {rnd('acc', 1)} END AS acceptance_rate
            FROM (SELECT CAST(unnest([1994, {YEAR_LIST}]) AS INT) AS year) y LEFT JOIN
              (SELECT year, CAST(sum(samples_taken) AS BIGINT) AS taken, CAST(sum(samples_ok) AS BIGINT) AS ok, avg(efficiency) AS eff, avg(acceptance) AS acc
               FROM water_treatment GROUP BY year) w ON w.year = y.year""",
    ),
)
_METERS = "metered_residential m JOIN users_location u ON m.users_location_id = u.id JOIN bridge b ON u.neighborhood_id = b.neighborhood_id"
add(
    "water_collection_ratio",
    lambda t: W.collection_ratio(t["metered_residential"], t["users_location"], t["bridge"], t["province"]),
    oracle(
        "province bridge users_location metered_residential",
        f"""SELECT p.id AS province_id, {rnd('CAST(s.c AS DOUBLE) / nullif(s.i, 0) * 100', 1)} AS collection_ratio FROM province p LEFT JOIN
            (SELECT province_id, sum(collected) AS c, sum(installed) AS i FROM {_METERS} GROUP BY 1) s ON s.province_id = p.id""",
    ),
)
add(
    "water_meter_recovery",
    lambda t: W.meter_recovery(t["metered_residential"], t["users_location"], t["bridge"], t["consumption_capita"]).select("id", "consumption", "recovery"),
    oracle(
        "bridge users_location metered_residential consumption_capita",
        """SELECT m.id, coalesce(use, m.consumption) AS consumption, coalesce(use * m.tariff, m.recovery) AS recovery FROM
             (SELECT m.*, CASE WHEN r.rate IS NOT NULL AND coalesce(u.served, 0) <> 0 THEN
                r.rate / 1000 * 365 * u.served * (CASE WHEN m.installed <> 0 THEN CAST(m.collected AS DOUBLE) / m.installed ELSE 0 END) END AS use
              FROM metered_residential m LEFT JOIN users_location u ON m.users_location_id = u.id
              LEFT JOIN bridge b ON u.neighborhood_id = b.neighborhood_id LEFT JOIN r ON r.city_id = b.city_id) m""",
        r="SELECT city_id, arg_max(l_per_day, year) AS rate FROM consumption_capita GROUP BY city_id",
    ),
)
add(
    "water_opex_recovery",
    lambda t: W.opex_recovery(t["metered_residential"], t["users_location"], t["bridge"], t["opex"], t["province"], [1994, *YEARS]),
    oracle(
        "province bridge users_location metered_residential opex",
        f"""SELECT p.id AS province_id, y.year, {rnd('coalesce(rev, 0)', 2)} AS revenue_eur,
              CASE WHEN o.total > 0 THEN {rnd('o.total', 2)} END AS total_opex_eur,
              CASE WHEN o.total > 0 THEN {rnd('coalesce(rev, 0) / o.total * 100', 1)} END AS recovery_pct
            FROM province p CROSS JOIN (SELECT CAST(unnest([1994, {YEAR_LIST}]) AS INT) AS year) y
            LEFT JOIN (SELECT province_id, sum(recovery) AS rev FROM {_METERS} GROUP BY 1) s ON s.province_id = p.id
            LEFT JOIN (SELECT year, arg_min(total, id) AS total FROM opex GROUP BY year) o ON o.year = y.year""",
    ),
)
add(
    "water_unit_opex",
    lambda t: W.unit_opex(t["well"], t["metered_residential"]),
    oracle(
        "well metered_residential",
        """SELECT total_opex, coalesce(total_opex / nullif(volume, 0), 0) AS unit_opex_m3, r AS opex_recovered,
                  CASE WHEN r <> 0 THEN r / total_opex * 100 END AS opex_recovered_pct
           FROM (SELECT sum(opex_m3 * (current_mm3_yr * 1000000)) AS total_opex, sum(current_mm3_yr * 1000000) AS volume FROM well WHERE is_active),
                (SELECT sum(recovery) AS r FROM metered_residential)""",
    ),
)
add(
    "water_opex_total",
    lambda t: W.opex_total(t["well"], t["imported_water"], t["province"]),
    oracle(
        "province well imported_water",
        f"""SELECT p.id AS province_id, (coalesce(flow, 0) * 86400 + {_IMP}) * 365 * (SELECT coalesce(avg(opex_m3), 0) FROM well WHERE is_active) AS opex_total_eur
            FROM province p LEFT JOIN s ON s.province_id = p.id""",
        s=_WELLS,
    ),
)
add(
    "water_imported_year",
    lambda t: W.imported_yr(t["imported_water"]),
    oracle("imported_water", f"SELECT {_IMP} * 365 AS imported_m3_yr"),
)
add(
    "water_coverage",
    lambda t: W.coverage(t["coverage"], t["city"], t["province"]),
    oracle(
        "province city coverage",
        f"""SELECT p.id AS province_id, {rnd('coalesce(a, 0)', 2)} AS covered_area_km2, coalesce(c, 0) AS households_covered,
              coalesce(t, 0) AS households_total, {rnd('CAST(c AS DOUBLE) / nullif(t, 0) * 100', 1)} AS coverage_pct
            FROM province p LEFT JOIN (SELECT province_id, sum(v.area_km2) AS a, CAST(sum(covered) AS BIGINT) AS c, CAST(sum(total) AS BIGINT) AS t
              FROM coverage v JOIN city ON v.city_id = city.id GROUP BY 1) s ON s.province_id = p.id""",
    ),
)
add(
    "water_losses",
    lambda t: W.nrw(t["loss"], [1994, *YEARS]).drop("ili"),
    oracle(
        "loss",
        f"""SELECT y.year, coalesce(a, 0) AS apparent_m3_d, coalesce(r, 0) AS real_m3_d, coalesce(a, 0) + coalesce(r, 0) AS nrw_m3_d
            FROM (SELECT CAST(unnest([1994, {YEAR_LIST}]) AS INT) AS year) y LEFT JOIN
            (SELECT year, sum(m3) FILTER (WHERE type = 'A') AS a, sum(m3) FILTER (WHERE type = 'R') AS r FROM loss GROUP BY year) l ON l.year = y.year""",
    ),
)
add(
    "water_leakage_index",
    lambda t: W.ili(t["loss"]),
    oracle(
        "loss",
        f"""SELECT year, CASE WHEN sum(m3 * unavoidable_pct) > 0 THEN {rnd('sum(m3) / (sum(m3 * unavoidable_pct) / 100)', 2)} END AS ili
            FROM loss WHERE type = 'R' GROUP BY year""",
    ),
)
add(
    "water_available_freshwater",
    lambda t: W.available_freshwater(t["fresh_water"], t["province"]),
    oracle(
        "province fresh_water",
        f"""SELECT p.id AS province_id, coalesce(sum(f.quantity_mm3), 0) AS available_mm3 FROM province p
            LEFT JOIN fresh_water f ON {box_hits('f.x0', 'f.y0', 'f.x0 + 28001', 'f.y0 + 28001')} GROUP BY 1""",
    ),
)
add(
    "water_drought_area",
    lambda t: W.drought_area(t["drought_area"], t["province"], [1994, *YEARS]),
    oracle(
        "province drought_area",
        f"""SELECT p.id AS province_id, y.year, {rnd('coalesce(sum(d.area_km2), 0)', 2)} AS drought_area_km2, coalesce(max(d.level), 0) AS max_sensibility
            FROM province p CROSS JOIN (SELECT CAST(unnest([1994, {YEAR_LIST}]) AS INT) AS year) y
            LEFT JOIN drought_area d ON d.province_id = p.id AND d.year = y.year GROUP BY 1, 2""",
    ),
)
add(
    "water_source_production",
    lambda t: W.source_production(t["fresh_water"], t["well"], t["province"], t["electricity_cost"], YEARS).select(
        "source_id", "year", F.round("production_day", 9).alias("production_day"), F.round("cost_day", 6).alias("cost_day"), F.round("cost_yr", 4).alias("cost_yr")
    ),
    oracle(
        "province years fresh_water well electricity_cost",
        f"""SELECT f.id AS source_id, y.year, {rnd('coalesce(w.fh, 0) * 3600 / 1e6', 9)} AS production_day,
              {rnd('coalesce(w.kwh, 0) * coalesce(e.eur_kwh, 0.15)', 6)} AS cost_day, {rnd('coalesce(w.kwh, 0) * coalesce(e.eur_kwh, 0.15) * 365', 4)} AS cost_yr
            FROM fresh_water f CROSS JOIN years y
            LEFT JOIN (SELECT source_id, sum(flow_m3_s * hours) AS fh, sum(kwh_h * hours) AS kwh FROM well GROUP BY 1) w ON w.source_id = f.id
            LEFT JOIN province p ON {in_province('f.x0 + 14000.5', 'f.y0 + 14000.5')}
            LEFT JOIN electricity_cost e ON e.province_id = p.id AND e.year = y.year""",
    ),
)

# --- housing --------------------------------------------------------------------------

_BAL = lambda s, d: f"{s} AS supply_units, {d} AS demand_units, {d} - {s} AS deficit, {rnd(f'CAST({d} - {s} AS DOUBLE) / nullif({d}, 0) * 100', 1)} AS deficit_pct"
add(
    "housing_supply_demand",
    lambda t: H.supply_demand(t["housing_supply_demand"], t["city"], t["province"], YEARS),
    oracle(
        "province years city housing_supply_demand",
        f"SELECT province_id, year, {_BAL('s', 'd')} FROM b",
        b=f"""SELECT p.id AS province_id, y.year, CAST(coalesce(sum(h.supply), 0) AS BIGINT) AS s, CAST(coalesce(sum(h.demand), 0) AS BIGINT) AS d {_SPINE}
              LEFT JOIN (SELECT c.province_id, h.* FROM housing_supply_demand h JOIN city c ON h.city_id = c.id) h ON h.province_id = p.id AND h.year = y.year GROUP BY 1, 2""",
    ),
)
add(
    "housing_supply_demand_city",
    lambda t: H.supply_demand_city(t["housing_supply_demand"], t["city"], YEARS),
    oracle(
        "years city housing_supply_demand",
        f"SELECT city_id, year, {_BAL('s', 'd')} FROM b",
        b="""SELECT c.id AS city_id, y.year, coalesce(h.supply, 0) AS s, coalesce(h.demand, 0) AS d FROM city c CROSS JOIN years y
             LEFT JOIN (SELECT city_id, year, arg_min(supply, id) AS supply, arg_min(demand, id) AS demand FROM housing_supply_demand GROUP BY 1, 2) h
             ON h.city_id = c.id AND h.year = y.year""",
    ),
)


def _pipeline_sql(dim):
    pick = lambda op, v: f"CAST(coalesce(sum({v}) FILTER (WHERE h.year_completion {op} y.year), 0) AS BIGINT)"
    return oracle(
        f"{'province' if dim == 'province' else ''} years bridge housing_project",
        f"""SELECT p.id AS {dim}_id, y.year, {pick('<=', 'h.u')} AS completed_units, {pick('<=', 'h.n')} AS completed_projects,
               {pick('>', 'h.u')} AS pipeline_units, {pick('>', 'h.n')} AS pipeline_projects
            FROM {dim} p CROSS JOIN years y LEFT JOIN (SELECT b.{dim}_id AS k, year_completion, sum(units) AS u, count(*) AS n
              FROM housing_project h JOIN bridge b USING (neighborhood_id) GROUP BY 1, 2) h ON h.k = p.id GROUP BY 1, 2""",
    )


add("housing_new_units_city", lambda t: H.new_units_city(t["housing_project"], t["bridge"], t["city"], YEARS), _pipeline_sql("city"))
add("housing_new_units", lambda t: H.new_units(t["housing_project"], t["bridge"], t["province"], YEARS), _pipeline_sql("province"))

_PROP = "JOIN property pr ON x.property_id = pr.id JOIN building bu ON pr.building_id = bu.id JOIN bridge b ON bu.neighborhood_id = b.neighborhood_id"
_NZ = lambda e, n: f"CASE WHEN {e} <> 0 THEN {rnd(e, n)} END"
add(
    "housing_mortgages",
    lambda t: H.mortgage_indicators(
        t["mortgage"], t["property"], t["building"], t["bridge"], t["central_bank_policy"], t["credit_supply"], t["province"], YEARS
    ),
    oracle(
        "province years bridge building property mortgage central_bank_policy credit_supply",
        f"""SELECT p.id AS province_id, y.year, po.rate AS interest_rate, po.ltv AS ltv_limit, po.lti AS lti_limit,
              cr.rate AS mortgage_rate, cr.approval AS approval_rate, cr.down_payment AS avg_down_payment_pct,
              {_NZ('m.mo', 2)} AS avg_monthly_payment, {_NZ('m.ra', 2)} AS avg_interest_rate, {_NZ('m.lo', 2)} AS avg_loan_amount, coalesce(m.n, 0) AS total_mortgages
            {_SPINE}
            LEFT JOIN (SELECT * FROM central_bank_policy QUALIFY row_number() OVER (PARTITION BY province_id, year ORDER BY id) = 1) po ON po.province_id = p.id AND po.year = y.year
            LEFT JOIN (SELECT * FROM credit_supply QUALIFY row_number() OVER (PARTITION BY province_id, year ORDER BY id) = 1) cr ON cr.province_id = p.id AND cr.year = y.year
            LEFT JOIN (SELECT b.province_id, avg(x.monthly) AS mo, avg(x.rate) AS ra, avg(x.loan) AS lo, count(*) AS n FROM mortgage x {_PROP} GROUP BY 1) m ON m.province_id = p.id""",
    ),
)
add(
    "housing_rents",
    lambda t: H.rent_indicators(t["rental"], t["property"], t["building"], t["bridge"], t["province"]),
    oracle(
        "province bridge building property rental",
        f"""SELECT p.id AS province_id, {_NZ('m.mo', 2)} AS avg_monthly_rent, {_NZ('m.an', 2)} AS avg_annual_rent, {_NZ('m.pr', 1)} AS avg_price_to_rent_ratio, coalesce(m.n, 0) AS total_rentals
            FROM province p LEFT JOIN (SELECT b.province_id, avg(x.monthly) AS mo, avg(x.annual) AS an, avg(x.price_to_rent) AS pr, count(*) AS n FROM rental x {_PROP} GROUP BY 1) m ON m.province_id = p.id""",
    ),
)
add(
    "housing_price_index",
    lambda t: H.house_price_index(t["house_price_index"], t["bridge"], t["province"], YEARS),
    oracle(
        "province years bridge house_price_index",
        f"""SELECT p.id AS province_id, y.year, {_NZ('c.v', 1)} AS avg_index,
              CASE WHEN c.v <> 0 AND q.v > 0 THEN {rnd('(c.v - q.v) / q.v * 100', 1)} END AS yoy_change_pct, coalesce(c.n, 0) AS neighborhoods_reported
            {_SPINE} LEFT JOIN h c ON c.province_id = p.id AND c.year = y.year LEFT JOIN h q ON q.province_id = p.id AND q.year = y.year - 1""",
        h="SELECT province_id, year, avg(value) AS v, count(*) AS n FROM house_price_index JOIN bridge USING (neighborhood_id) GROUP BY 1, 2",
    ),
)
_VAC = """SELECT b.province_id, CAST(sum(units) AS BIGINT) AS u, count(*) FILTER (WHERE vacant) AS v, count(*) AS n, avg(vacancy_rate) AS r
    FROM building JOIN bridge b USING (neighborhood_id) GROUP BY 1"""
_VAC_COLS = f"coalesce(va.u, 0) AS total_units, coalesce(va.v, 0) AS vacant_buildings, coalesce(va.n, 0) AS total_buildings, {_NZ('va.r', 1)} AS avg_vacancy_rate"
add(
    "housing_properties",
    lambda t: H.property_indicators(t["property"], t["building"], t["bridge"], t["province"]),
    oracle(
        "province bridge building property",
        f"""SELECT p.id AS province_id, {_NZ('m.sa', 2)} AS avg_sale_price, {_NZ('m.li', 2)} AS avg_listing_price, {_NZ('m.sq', 2)} AS avg_price_sqm,
              {_NZ('m.ar', 1)} AS avg_living_area, coalesce(m.n, 0) AS total_properties, {_VAC_COLS}
            FROM province p LEFT JOIN va ON va.province_id = p.id LEFT JOIN (SELECT b.province_id, avg(sale) AS sa, avg(listing) AS li, avg(per_sqm) AS sq, avg(living_area) AS ar, count(*) AS n
              FROM property pr JOIN building bu ON pr.building_id = bu.id JOIN bridge b ON bu.neighborhood_id = b.neighborhood_id GROUP BY 1) m ON m.province_id = p.id""",
        va=_VAC,
    ),
)
add(
    "housing_vacancy",
    lambda t: H.vacancy(t["building"], t["bridge"], t["province"]),
    oracle("province bridge building", f"SELECT p.id AS province_id, {_VAC_COLS} FROM province p LEFT JOIN va ON va.province_id = p.id", va=_VAC),
)
_zone_cols = ", ".join(
    f"""coalesce(sum(area) FILTER (WHERE type = '{z}'), 0) AS {z}_area_sqm, count(*) FILTER (WHERE type = '{z}') AS {z}_count,
        coalesce({rnd(f"coalesce(sum(area) FILTER (WHERE type = '{z}'), 0) / nullif(coalesce(sum(area), 0), 0) * 100", 1)}, 0) AS {z}_area_pct,
        CASE WHEN avg(benchmark) FILTER (WHERE type = '{z}') <> 0 THEN {rnd(f"avg(benchmark) FILTER (WHERE type = '{z}')", 2)} END AS {z}_avg_benchmark"""
    for z in H.ZONE_TYPES
)
add(
    "housing_zoning",
    lambda t: H.zoning(t["zoning_area"], t["bridge"], t["province"]),
    oracle(
        "province bridge zoning_area",
        f"""SELECT p.id AS province_id, coalesce(sum(area), 0) AS total_area_sqm, {_zone_cols}
            FROM province p LEFT JOIN (SELECT b.province_id, z.* FROM zoning_area z JOIN bridge b USING (neighborhood_id)) z ON z.province_id = p.id GROUP BY 1""",
    ),
)
_aff = {
    "index": "avg_affordability_index", "income": "avg_median_income", "expenditure": "avg_median_expenditure", "disposable": "avg_median_disposable",
    "price": "avg_median_house_price", "rent": "avg_median_rent", "mortgage": "avg_median_mortgage",
}
_aff_cols = ", ".join(f"CASE WHEN avg(a.{c}) <> 0 THEN {rnd(f'avg(a.{c})', 2)} END AS {n}" for c, n in _aff.items())
_aff_levels = ", ".join(f"count(*) FILTER (WHERE stress = '{lv}') AS stress_{lv}" for lv in H.STRESS_LEVELS)
_aff_from = f"""{_SPINE} LEFT JOIN (SELECT b.province_id, a.* FROM affordability a JOIN bridge b USING (neighborhood_id)) a
    ON a.province_id = p.id AND a.year = y.year GROUP BY 1, 2"""
add(
    "housing_affordability",
    lambda t: H.affordability(t["affordability"], t["bridge"], t["province"], YEARS),
    oracle(
        "province years bridge affordability",
        f"SELECT p.id AS province_id, y.year, {_aff_cols}, {_aff_levels}, count(a.id) AS neighborhoods_reported {_aff_from}",
    ),
)
add(
    "housing_stress_distribution",
    lambda t: H.stress_distribution(H.affordability(t["affordability"], t["bridge"], t["province"], [1994, 1999])).select(
        "province_id", "year", F.to_json("stress_distribution").alias("stress")
    ),
    oracle(
        "province bridge affordability",
        f"""SELECT p.id AS province_id, y.year, CASE WHEN count(a.id) = 0 THEN '{{}}' ELSE
              '{{"low":' || count(*) FILTER (WHERE stress = 'low') || ',"moderate":' || count(*) FILTER (WHERE stress = 'moderate') || ',"high":' || count(*) FILTER (WHERE stress = 'high') || '}}' END AS stress
            FROM province p CROSS JOIN (SELECT CAST(unnest([1994, 1999]) AS INT) AS year) y
            LEFT JOIN (SELECT b.province_id, a.* FROM affordability a JOIN bridge b USING (neighborhood_id)) a ON a.province_id = p.id AND a.year = y.year GROUP BY 1, 2""",
    ),
)

add(
    "reporting_period",
    lambda t: t["housing_supply_demand"].select("year").unionByName(t["consumption_capita"].select("year")).unionByName(t["loss"].select("year"))
    .groupBy("year").agg(F.count("*").alias("facts")).withColumn("reported", F.col("year").isin(YEARS)),
    oracle(
        "housing_supply_demand consumption_capita loss",
        """SELECT year, count(*) AS facts, year BETWEEN 1995 AND 2001 AS reported FROM (
             SELECT year FROM housing_supply_demand UNION ALL SELECT year FROM consumption_capita UNION ALL SELECT year FROM loss) GROUP BY 1""",
    ),
)
