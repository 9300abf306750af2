"""Indicator dashboards and what-if scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from citylake.functions import scalars as S
from citylake.operators import housing as H
from citylake.plans import dashboards as D
from citylake.queries import raster, relational, spatial
from citylake.queries.standin import YEARS, City, rnd

QUERIES: dict = {}
ORACLES: dict = {}


def add(name, fn, sql=None):
    QUERIES[name] = lambda spark, sf, _f=fn: _f(City(spark, sf))
    if sql:
        ORACLES[name] = sql


def _sub(*modules_and_names) -> str:
    """The check SQL of other queries as named sub-selects."""
    return "WITH " + ",\n".join(f"q_{n} AS ({m.ORACLES[n]})" for m, n in modules_and_names)


def _left(base: str, *joins: tuple[str, str]) -> str:
    return base + "".join(f" LEFT JOIN q_{n} {n} USING ({keys})" for n, keys in joins)


# --- water ----------------------------------------------------------------------------

_W = [
    (relational, n)
    for n in (
        "water_consumption_capita", "water_total_extraction", "water_total_production", "water_energy_consumption", "water_co2_emission", "water_opex_total",
        "water_available_freshwater", "water_losses", "latest_leakage_index", "water_quality", "water_collection_ratio", "water_opex_recovery", "water_coverage", "water_drought_area",
    )
] + [(spatial, "water_network_length")]
_water_from = _left(
    "q_water_consumption_capita c JOIN (SELECT r_regionkey AS province_id, r_name AS province, CASE WHEN r_regionkey = 3 THEN 0 ELSE 1000000 + r_regionkey * 1000 END AS population FROM region) p USING (province_id)",
    ("water_total_extraction", "province_id"), ("water_total_production", "province_id"), ("water_energy_consumption", "province_id"), ("water_co2_emission", "province_id"),
    ("water_opex_total", "province_id"), ("water_available_freshwater", "province_id"), ("water_network_length", "province_id"), ("water_losses", "year"),
    ("latest_leakage_index", "year"), ("water_quality", "year"), ("water_collection_ratio", "province_id"), ("water_opex_recovery", "province_id, year"),
    ("water_coverage", "province_id"), ("water_drought_area", "province_id, year"),
)


def _water_sql(scenario: bool) -> str:
    use = "coalesce(nullif(scenario, 0), consumption_capita)" if scenario else "consumption_capita"
    src = _water_from + (" CROSS JOIN (SELECT CAST(unnest([0, 90, 150]) AS DOUBLE) AS scenario) s" if scenario else "")
    share = lambda v: f"coalesce({rnd(f'least({v} / nullif(available_mm3, 0) * 100, 100)', 1)}, 0)"
    sy, dy = "(production_m3_d * 365 / 1000000)", "(demand * 365 / 1000000)"
    hours = f"CASE WHEN production_m3_d >= demand THEN 24 ELSE {rnd('24 * production_m3_d / nullif(demand, 0)', 1)} END"
    return (
        _sub(*_W)
        + f""", b AS (SELECT *, {use} AS use, {use} / 1000 * population AS demand FROM {src})
        SELECT province_id, province, year, {'scenario,' if scenario else ''} use AS consumption_capita, least(use / 300 * 100, 100) AS consumption_percent,
          {rnd(sy, 2)} AS total_supply_mm3, {rnd(dy, 2)} AS total_demand_mm3, {share(sy)} AS total_supply_percent, {share(dy)} AS total_demand_percent,
          {rnd(f'coalesce({sy} / nullif({dy}, 0) * 100, 0)', 6)} AS supply_security, {hours} AS service_time, {rnd(f'({hours}) / 24 * 100', 1)} AS service_time_percent,
          network_km AS network_length, {rnd('opex_total_eur', 4)} AS opex, {rnd('least(opex_total_eur / 10000000 * 100, 100)', 6)} AS opex_percent, {rnd('nrw_m3_d', 1)} AS nrw_m3_d,
          coalesce({rnd('nrw_m3_d / nullif(production_m3_d, 0) * 100', 1)}, 0) AS nrw_percent, {rnd('apparent_m3_d', 1)} AS apparent_losses_m3_d, {rnd('real_m3_d', 1)} AS real_losses_m3_d, ili,
          {rnd('extraction_m3_d', 1)} AS extraction_m3_d, {rnd('energy_kwh_d', 1)} AS energy_kwh_day, {rnd('co2_kg_d', 1)} AS co2_kg_day, {rnd('co2_kg_d * 365 / 1000', 2)} AS co2_ton_yr,
          samples_taken, samples_ok, compliance_pct, treatment_efficiency, acceptance_rate, collection_ratio, revenue_eur AS opex_revenue_eur, recovery_pct AS opex_recovery_pct,
          covered_area_km2, households_covered, households_total, coverage_pct, drought_area_km2, max_sensibility AS drought_sensibility FROM b"""
    )


def _trim(df):
    """Unrounded quotients are compared to fixed places."""
    return df.withColumns(
        {
            "supply_security": F.round("supply_security", 6), "network_length": F.round("network_length", 6),
            "opex": F.round("opex", 4), "opex_percent": F.round("opex_percent", 6),
        }
    )


add("water_dashboard", lambda t: _trim(D.water_indicators(t, YEARS)), _water_sql(False))
add("water_scenarios", lambda t: _trim(D.water_scenarios(t, YEARS, [0.0, 90.0, 150.0])), _water_sql(True))

# --- housing --------------------------------------------------------------------------

_H = [
    (relational, n)
    for n in (
        "housing_supply_demand", "housing_new_units", "housing_mortgages", "housing_rents", "housing_price_index", "housing_properties", "housing_zoning", "housing_affordability",
    )
]
_housing_from = (
    "q_housing_supply_demand s JOIN (SELECT r_regionkey AS province_id, r_name AS province FROM region) p USING (province_id)"
    " JOIN q_housing_new_units u USING (province_id, year) JOIN q_housing_mortgages m USING (province_id, year) JOIN q_housing_rents r USING (province_id)"
    " JOIN (SELECT province_id, year, avg_index, yoy_change_pct, neighborhoods_reported AS hpi_neighborhoods FROM q_housing_price_index) h USING (province_id, year)"
    " JOIN q_housing_properties pr USING (province_id) JOIN q_housing_zoning z USING (province_id) JOIN q_housing_affordability a USING (province_id, year)"
)


def _housing_sql(scenario: bool) -> str:
    pay, rate, src = "avg_monthly_payment", "mortgage_rate", _housing_from
    if scenario:
        src += " CROSS JOIN (SELECT CAST(unnest([0, 3.5, 6]) AS DOUBLE) AS scenario) sc"
        r = "(scenario / 100 / 12)"
        pay = f"""CASE WHEN scenario <> 0 AND avg_loan_amount > 0
            THEN {rnd(f'avg_loan_amount * {r} * pow(1 + {r}, 360) / nullif(pow(1 + {r}, 360) - 1, 0)', 2)} ELSE avg_monthly_payment END"""
        rate = "coalesce(nullif(scenario, 0), mortgage_rate)"
    zones = ", ".join(f"{z}_area_pct AS zoning_{z}_pct" for z in H.ZONE_TYPES)
    return (
        _sub(*_H)
        + f""", b AS (SELECT * EXCLUDE (mortgage_rate), {rate} AS mortgage_rate, {pay} AS pay FROM {src})
        SELECT province_id, province, year, {'scenario,' if scenario else ''} supply_units, demand_units, deficit, coalesce(deficit_pct, 0) AS deficit_pct,
          completed_units, completed_projects, pipeline_units, pipeline_projects, interest_rate, mortgage_rate, ltv_limit, lti_limit, approval_rate,
          pay AS avg_monthly_payment, avg_loan_amount, total_mortgages, avg_monthly_rent, avg_annual_rent, avg_price_to_rent_ratio, total_rentals,
          avg_index AS hpi_value, yoy_change_pct AS hpi_yoy_change, hpi_neighborhoods, avg_sale_price, avg_listing_price, avg_price_sqm, avg_living_area, total_properties,
          total_units, vacant_buildings, total_buildings, avg_vacancy_rate AS vacancy_rate, total_area_sqm AS zoning_total_area_sqm, {zones},
          avg_affordability_index AS affordability_index, avg_median_income AS median_income, avg_median_expenditure AS median_expenditure, avg_median_disposable AS median_disposable_income,
          avg_median_house_price AS median_house_price, CASE WHEN avg_median_income > 0 AND pay <> 0 THEN {rnd('pay * 12 / nullif(avg_median_income, 0) * 100', 1)} END AS cost_burden_pct,
          stress_low, stress_moderate, stress_high, stress_low + stress_moderate + stress_high AS stress_total, neighborhoods_reported FROM b"""
    )


add("housing_dashboard", lambda t: D.housing_indicators(t, YEARS), _housing_sql(False))
add("housing_scenarios", lambda t: D.housing_scenarios(t, YEARS, [0.0, 3.5, 6.0]), _housing_sql(True))

# --- heat -----------------------------------------------------------------------------

_U = [(raster, "heat_thermal_indices")] + [
    (spatial, n) for n in ("heat_vegetation", "heat_morphology", "heat_nature_based_solutions", "heat_latest_meteorology")
]
_kind = ", ".join(
    f"max(mean) FILTER (WHERE kind = '{k}') AS {k}_mean, max(min) FILTER (WHERE kind = '{k}') AS {k}_min, max(max) FILTER (WHERE kind = '{k}') AS {k}_max"
    for k in ("lst", "tmrt", "pet", "utci", "svf", "suhii")
)
_pct = lambda c, limit: f"CASE WHEN {c} <> 0 THEN {rnd(f'least({c} / {limit} * 100, 100)', 1)} ELSE 0 END"
_three = lambda k: f"{k}_mean, {k}_min, {k}_max"
_HEAT = (
    _sub(*_U)
    + f""", th AS (SELECT province_id, {_kind} FROM q_heat_thermal_indices GROUP BY 1),
    b AS (SELECT p.r_regionkey AS province_id, p.r_name AS province, th.* EXCLUDE (province_id), v.* EXCLUDE (province_id), m.* EXCLUDE (province_id), n.* EXCLUDE (province_id), w.* EXCLUDE (province_id)
      FROM region p LEFT JOIN th ON th.province_id = p.r_regionkey LEFT JOIN q_heat_vegetation v ON v.province_id = p.r_regionkey LEFT JOIN q_heat_morphology m ON m.province_id = p.r_regionkey
      LEFT JOIN q_heat_nature_based_solutions n ON n.province_id = p.r_regionkey LEFT JOIN q_heat_latest_meteorology w ON w.province_id = p.r_regionkey),
    heat AS (SELECT province_id, province, {_three('lst')}, {_pct('lst_mean', 50)} AS lst_pct, {_three('tmrt')}, {_three('pet')}, {_pct('pet_mean', 41)} AS pet_pct,
      {relational._case(S.PET_CLASSES, 'pet_mean')} AS pet_category, {_three('utci')}, {_pct('utci_mean', 46)} AS utci_pct, {relational._case(S.UTCI_CLASSES, 'utci_mean')} AS utci_category,
      {_three('svf')}, coalesce({rnd('svf_mean * 100', 1)}, 0) AS svf_pct, {_three('suhii')}, vegetation_coverage_pct AS vegetation_pct, park_area_km2, green_lc_km2, total_green_km2,
      building_count, avg_building_height_m AS avg_height_m, max_building_height_m AS max_height_m, total_footprint_km2 AS footprint_km2, avg_street_width_m, aspect_ratio,
      total_count AS nbs_count, total_area_km2 AS nbs_area_km2, total_area_m2 AS nbs_area_m2, temperature AS air_temp_c, humidity AS humidity_pct, wind AS wind_speed_m_s, radiation AS solar_radiation FROM b)
    """
)
add("heat_dashboard", lambda t: D.heat_indicators(t), _HEAT + "SELECT * FROM heat")
add(
    "heat_scenarios",
    lambda t: D.heat_scenarios(D.heat_indicators(t), [0.0, 25.0, 60.0]),
    _HEAT + "SELECT heat.* EXCLUDE (vegetation_pct), CAST(scenario AS DOUBLE) AS scenario, CAST(scenario AS DOUBLE) AS vegetation_pct FROM heat CROSS JOIN (SELECT unnest([0, 25, 60]) AS scenario) s",
)
add(
    "heat_bands",
    lambda t: D.heat_bands(D.heat_indicators(t)),
    _HEAT
    + """SELECT province_id, CASE WHEN pet_category LIKE '%Heat%' THEN 'hot' WHEN pet_category LIKE '%Cold%' THEN 'cold' WHEN pet_category IS NOT NULL THEN 'neutral' END AS pet_band,
        CASE WHEN utci_category LIKE '%Heat%' THEN 'hot' WHEN utci_category LIKE '%Cold%' THEN 'cold' WHEN utci_category IS NOT NULL THEN 'neutral' END AS utci_band,
        CASE WHEN aspect_ratio > 1.5 THEN 'high' WHEN aspect_ratio > 1 THEN 'medium' ELSE 'low' END AS aspect_band,
        CASE WHEN suhii_mean > 4 THEN 'high' WHEN suhii_mean > 2 THEN 'medium' WHEN suhii_mean IS NOT NULL THEN 'low' END AS suhii_band FROM heat""",
)

# --- output forms ---------------------------------------------------------------------

add(
    "indicators_json",
    lambda t: D.to_json(H.supply_demand(t["housing_supply_demand"], t["city"], t["province"], YEARS).withColumn("province", F.col("province_id").cast("string"))).select(
        "province", "year", F.get_json_object("indicators", "$.supply_units").cast("long").alias("supply"), F.get_json_object("indicators", "$.deficit_pct").cast("double").alias("pct")
    ),
    f"WITH s AS ({relational.ORACLES['housing_supply_demand']}) SELECT CAST(province_id AS STRING) AS province, year, supply_units AS supply, deficit_pct AS pct FROM s",
)
add(
    "indicators_long",
    lambda t: D.to_long(H.supply_demand(t["housing_supply_demand"], t["city"], t["province"], YEARS), ["supply_units", "demand_units", "deficit"]),
    f"""WITH s AS ({relational.ORACLES['housing_supply_demand']})
        SELECT province_id, year, indicator, CAST(value AS DOUBLE) AS value FROM (SELECT province_id, year, supply_units, demand_units, deficit FROM s) UNPIVOT (value FOR indicator IN (supply_units, demand_units, deficit))""",
)
