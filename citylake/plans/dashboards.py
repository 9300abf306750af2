"""Indicator rows per province and year, what-if scenarios, and their JSON form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylake.functions import scalars as S
from citylake.operators import heat as U
from citylake.operators import housing as H
from citylake.operators import spatial as J
from citylake.operators import water as W
from citylake.operators.hierarchy import mean, with_scenarios
from citylake.plans.facts import AFTER, BEFORE, PREVIOUS, Facts, greatest, means, number, number_if, total

# Service hours of a full day and display limits.
FULL_HOURS, MAX_OPEX_EUR, MAX_CONSUMPTION = 24.0, 10_000_000, 300
MAX_LST, MAX_PET, MAX_UTCI = 50, 41, 46

Tables = dict[str, DataFrame]


def _join(base: DataFrame, *parts: DataFrame) -> DataFrame:
    for p in parts:
        base = base.join(p, [c for c in ("province_id", "year") if c in p.columns and c in base.columns], "left")
    return base


# --- water ----------------------------------------------------------------------------

def water_base(t: Tables, years: Sequence[int]) -> DataFrame:
    """Everything the water dashboard reads, one row per province and year: one pass over all facts, another over
    those without a place, and the records that count only as the first or latest of a year."""
    facts = Facts(years)
    facts.add("consumption", t["consumption_capita"], "city_id", means(["l_per_day"]), "year")
    facts.add("coverage", t["coverage"], "city_id", {"_area": total("area_km2"), "_covered": total("covered"), "_total": total("total")})
    facts.add("drought", t["drought_area"], "province_id", {"_drought": total("area_km2"), "_level": greatest("level")}, "year")
    facts.add(
        "meters", t["metered_residential"], "users_location_id",
        {"_installed": total("installed"), "_collected": total("collected"), "_revenue": total("recovery")},
    )
    facts.add("network", J.clip_length(t["pipe"], t["province"].select(F.col("id").alias("province_id"), "geom"), "id", "province_id"), "province_id", {"_length": total("length")})
    facts.place("wells", W.pumping(t["well"]), {"_flow": total("flow_m3_s"), "_kwh": total("_kwh"), "_co2": total("co2_day")})
    facts.place("fresh water", t["fresh_water"], {"_fresh": total("quantity_mm3")})
    name = [F.col("name").alias("province"), S.or_zero("population").alias("population")]
    parents = [("users_location_id", t["users_location"], "id", "neighborhood_id"), *climbed(t)]
    base = facts.wide(t["province"], parents, name)

    # a treatment counts for the quality of its year, and in all years for the energy
    everywhere = F.lit("").alias("everywhere")
    uses = F.expr("array(named_struct('year', CAST(year AS INT), 'always', false), named_struct('year', CAST(NULL AS INT), 'always', true))")
    treated = t["water_treatment"].withColumn("_use", F.explode(uses)).where("_use.always OR _use.year IS NOT NULL")
    only = lambda always, c: F.when(F.col("_use.always") == always, F.col(c)).alias(c)
    treated = treated.select(
        everywhere, "_use.year", *[only(False, c) for c in ("samples_taken", "samples_ok", "efficiency", "acceptance")], only(True, "energy")
    )
    measures = {"_taken": total("samples_taken"), "_ok": total("samples_ok"), **means(["efficiency", "acceptance"]), "_energy": total("energy")}
    shared = Facts(years)
    shared.add("treatment", treated, "everywhere", measures, "year")
    shared.add("imports", W.active(t["imported_water"]).withColumn("everywhere", everywhere), "everywhere", {"_imported": total("m3_d")})
    shared.add("opex", W.active(t["well"]).withColumn("everywhere", everywhere), "everywhere", means(["opex_m3"]))
    base = _join(base, shared.overall(), W.first_opex(t["opex"], years), W.nrw(t["loss"], years))

    well = W.well_columns("_flow", "_kwh", "_co2")
    zero = F.lit(0.0)
    return base.withColumns({"extraction_m3_d": well[0], "pump_kwh_d": well[1], "co2_kg_d": well[2]}).select(
        "province_id", "province", "year", "population", "extraction_m3_d", "co2_kg_d", "nrw_m3_d", "apparent_m3_d", "real_m3_d", "ili",
        W.consumption_column("_s_l_per_day", "_n_l_per_day"),
        (F.col("extraction_m3_d") + F.coalesce("_imported", zero)).alias("supply_m3_d"),
        (F.col("pump_kwh_d") + F.coalesce("_energy", zero) * 1000).alias("energy_kwh_d"),
        F.coalesce(mean("_s_opex_m3", "_n_opex_m3"), zero).alias("_avg_opex"),
        F.coalesce("_fresh", zero).alias("available_mm3"),
        F.coalesce(F.col("_length") / 1000, zero).alias("network_km"),
        *W.quality_columns("_taken", "_ok", mean("_s_efficiency", "_n_efficiency"), mean("_s_acceptance", "_n_acceptance")),
        W.collection_column("_collected", "_installed"),
        *W.recovery_columns("_revenue", "_opex"),
        *W.coverage_columns("_area", "_covered", "_total"),
        *W.drought_columns("_drought", "_level"),
    )


def climbed(t: Tables) -> list[tuple[str, DataFrame, str, str]]:
    """The hierarchy above the neighborhoods, level by level."""
    return [
        ("neighborhood_id", t["neighborhood"], "id", "district_id"), ("district_id", t["district"], "id", "city_id"),
        ("city_id", t["city"], "id", "province_id"),
    ]


def water_row(base: DataFrame, consumption: Column | None = None) -> DataFrame:
    """Dashboard columns. An override of 0 or NULL falls back to the measured consumption."""
    use = F.col("consumption_capita")
    if consumption is not None:
        use = F.coalesce(F.when(consumption != 0, consumption), use)
    supply, available = F.col("supply_m3_d"), F.col("available_mm3")
    demand = use / 1000 * F.col("population")
    supply_yr, demand_yr = supply * 365 / 1_000_000, demand * 365 / 1_000_000
    hours = S.service_hours(supply, demand, 1, FULL_HOURS)
    opex = supply * 365 * F.col("_avg_opex")
    share = lambda v: F.coalesce(S.rounded(F.least(S.ratio(v, available) * 100, F.lit(100.0)), 1), F.lit(0.0))
    extra = ["scenario"] if "scenario" in base.columns else []
    return base.select(
        "province_id", "province", "year", *extra,
        use.alias("consumption_capita"),
        S.capped_pct(use, MAX_CONSUMPTION).alias("consumption_percent"),
        S.rounded(supply_yr, 2).alias("total_supply_mm3"),
        S.rounded(demand_yr, 2).alias("total_demand_mm3"),
        share(supply_yr).alias("total_supply_percent"),
        share(demand_yr).alias("total_demand_percent"),
        F.coalesce(S.ratio(supply_yr, demand_yr) * 100, F.lit(0.0)).alias("supply_security"),
        hours.alias("service_time"),
        S.rounded(hours / FULL_HOURS * 100, 1).alias("service_time_percent"),
        F.col("network_km").alias("network_length"),
        opex.alias("opex"),
        S.capped_pct(opex, MAX_OPEX_EUR).alias("opex_percent"),
        S.rounded("nrw_m3_d", 1).alias("nrw_m3_d"),
        F.coalesce(S.percent(F.col("nrw_m3_d"), supply, 1), F.lit(0.0)).alias("nrw_percent"),
        S.rounded("apparent_m3_d", 1).alias("apparent_losses_m3_d"),
        S.rounded("real_m3_d", 1).alias("real_losses_m3_d"),
        "ili",
        S.rounded("extraction_m3_d", 1).alias("extraction_m3_d"),
        S.rounded("energy_kwh_d", 1).alias("energy_kwh_day"),
        S.rounded("co2_kg_d", 1).alias("co2_kg_day"),
        S.rounded(F.col("co2_kg_d") * 365 / 1000, 2).alias("co2_ton_yr"),
        "samples_taken", "samples_ok", "compliance_pct", "treatment_efficiency", "acceptance_rate",
        "collection_ratio",
        F.col("revenue_eur").alias("opex_revenue_eur"),
        F.col("recovery_pct").alias("opex_recovery_pct"),
        "covered_area_km2", "households_covered", "households_total", "coverage_pct", "drought_area_km2",
        F.col("max_sensibility").alias("drought_sensibility"),
    )


def water_indicators(t: Tables, years: Sequence[int]) -> DataFrame:
    return water_row(water_base(t, years))


def water_scenarios(t: Tables, years: Sequence[int], consumption: Sequence[float]) -> DataFrame:
    """The dashboard once per consumption scenario (litres per person and day)."""
    return water_row(with_scenarios(water_base(t, years), consumption, "scenario"), F.col("scenario"))


# --- housing --------------------------------------------------------------------------

def housing_base(t: Tables, years: Sequence[int]) -> DataFrame:
    """Everything the housing dashboard reads, one row per province and year, in one pass over all facts; only
    the first policy and credit records are joined to it."""
    wanted = sorted({int(y) for y in years} | {int(y) - 1 for y in years})
    in_years = lambda df, ys: df.where(F.col("year").isin([int(y) for y in ys]))
    facts = Facts(years)
    facts.add("supply and demand", in_years(t["housing_supply_demand"], years), "city_id", {"_s": total("supply"), "_d": total("demand")}, "year")
    facts.add(
        "projects", t["housing_project"].where("year_completion IS NOT NULL"), "neighborhood_id",
        {
            "_done_u": total("units", BEFORE), "_done_n": number(at=BEFORE), "_planned_u": total("units", AFTER), "_planned_n": number(at=AFTER),
        },
        "year_completion",
    )
    facts.add(
        "price index", in_years(t["house_price_index"], wanted), "neighborhood_id",
        {**means(["value"]), "_n_hpi": number(), **means(["value"], "p", PREVIOUS)}, "year",
    )
    zones = {"_zone": total("area")}
    for z in H.ZONE_TYPES:
        of = lambda c, z=z: F.when(F.col("type") == z, F.col(c))
        zones |= {f"_zone_{z}": total(of("area")), f"_zone_n_{z}": number_if(F.col("type") == z)}
        zones |= {f"_zone_s_{z}": total(of("benchmark")), f"_zone_c_{z}": number(of("benchmark"))}
    facts.add("zoning", t["zoning_area"], "neighborhood_id", zones)
    stress = {f"_l_{lv}": number_if(F.col("stress") == lv) for lv in H.STRESS_LEVELS}
    facts.add("affordability", in_years(t["affordability"], years), "neighborhood_id", {**means(list(H.AFFORDABILITY)), "_n_aff": number(), **stress}, "year")
    estate = H.estate_sums(t["mortgage"], t["rental"], t["property"], t["building"])
    facts.add("estate", estate, "neighborhood_id", {c: total(c) for c in estate.columns if c != "neighborhood_id"})
    base = facts.wide(t["province"], climbed(t), [F.col("name").alias("province")])
    base = _join(base, H.policy_terms(t["central_bank_policy"], years), H.credit_records(t["credit_supply"], years))

    return base.select(
        "province_id", "province", "year", "interest_rate", "ltv_limit", "lti_limit", "mortgage_rate", "approval_rate",
        *H.balance(S.or_zero("_s"), S.or_zero("_d")),
        S.or_zero("_done_u").alias("completed_units"), S.or_zero("_done_n").alias("completed_projects"),
        S.or_zero("_planned_u").alias("pipeline_units"), S.or_zero("_planned_n").alias("pipeline_projects"),
        *H.estate_columns(),
        *H.index_columns(mean("_s_value", "_n_value"), mean("p_s_value", "p_n_value")), S.or_zero("_n_hpi").alias("hpi_neighborhoods"),
        *H.zone_columns("_zone", "_zone_{}", "_zone_n_{}", lambda z: mean(f"_zone_s_{z}", f"_zone_c_{z}")),
        *H.affordability_columns(), S.or_zero("_n_aff").alias("_aff_n"),
    )


def housing_row(base: DataFrame, rate: Column | None = None) -> DataFrame:
    """Dashboard columns. A rate override (0 or NULL means none) recomputes the monthly payment."""
    monthly, mortgage_rate = F.col("avg_monthly_payment"), F.col("mortgage_rate")
    if rate is not None:
        given = F.when(rate != 0, rate)
        loan = F.col("avg_loan_amount")
        monthly = F.when(given.isNotNull() & (loan > 0), S.annuity(loan, given)).otherwise(monthly)
        mortgage_rate = F.coalesce(given, mortgage_rate)
    income = F.col("avg_median_income")
    burden = F.when((income > 0) & (monthly != 0), S.rounded(S.ratio(monthly * 12, income) * 100, 1))
    stress = [F.col(f"stress_{lv}") for lv in H.STRESS_LEVELS]
    extra = ["scenario"] if "scenario" in base.columns else []
    return base.select(
        "province_id", "province", "year", *extra,
        "supply_units", "demand_units", "deficit", F.coalesce("deficit_pct", F.lit(0.0)).alias("deficit_pct"),
        "completed_units", "completed_projects", "pipeline_units", "pipeline_projects",
        "interest_rate", mortgage_rate.alias("mortgage_rate"), "ltv_limit", "lti_limit", "approval_rate",
        monthly.alias("avg_monthly_payment"), "avg_loan_amount", "total_mortgages",
        "avg_monthly_rent", "avg_annual_rent", "avg_price_to_rent_ratio", "total_rentals",
        F.col("avg_index").alias("hpi_value"), F.col("yoy_change_pct").alias("hpi_yoy_change"), "hpi_neighborhoods",
        "avg_sale_price", "avg_listing_price", "avg_price_sqm", "avg_living_area", "total_properties",
        "total_units", "vacant_buildings", "total_buildings", F.col("avg_vacancy_rate").alias("vacancy_rate"),
        F.col("total_area_sqm").alias("zoning_total_area_sqm"),
        *[F.col(f"{z}_area_pct").alias(f"zoning_{z}_pct") for z in H.ZONE_TYPES],
        F.col("avg_affordability_index").alias("affordability_index"),
        income.alias("median_income"),
        F.col("avg_median_expenditure").alias("median_expenditure"),
        F.col("avg_median_disposable").alias("median_disposable_income"),
        F.col("avg_median_house_price").alias("median_house_price"),
        burden.alias("cost_burden_pct"),
        *[F.col(f"stress_{lv}") for lv in H.STRESS_LEVELS],
        sum(stress[1:], stress[0]).alias("stress_total"),
        F.col("_aff_n").alias("neighborhoods_reported"),
    )


def housing_indicators(t: Tables, years: Sequence[int]) -> DataFrame:
    return housing_row(housing_base(t, years))


def housing_scenarios(t: Tables, years: Sequence[int], rates: Sequence[float]) -> DataFrame:
    """The dashboard once per interest-rate scenario (percent)."""
    return housing_row(with_scenarios(housing_base(t, years), rates, "scenario"), F.col("scenario"))


# --- heat -----------------------------------------------------------------------------

def heat_indicators(t: Tables) -> DataFrame:
    p, once = t["province"], 0  # no fact has a year
    facts = Facts([once])
    facts.place("parks", t["park"], {"_park": total("area")})
    facts.place("buildings", t["building"], {"_nb": number(), **means(["height"]), "_hmax": greatest("height"), "_foot": total("footprint")})
    facts.place("streets", t["street"], {"_ns": number(), **means(["width"])})
    facts.place("green polygons", t["nbs_polygon"], {"_np": number(), "_np_area": total("area")})
    facts.place("green points", t["nbs_point"], {"_npt": number()})
    facts.add("land cover", U.green_cover(t["land_cover"], t["land_cover_class"]), "province_id", {"_pct": total("_pct")})
    base = facts.wide(p, more=[F.col("name").alias("province"), F.col("area_km2").alias("_km2")])
    green = U.green_columns("_park", "_pct", "_km2")
    base = base.select(
        "province_id", "province", *green, U.vegetation_column(green[2], "_km2"),
        *U.morphology_columns("_nb", mean("_s_height", "_n_height"), "_hmax", "_foot", "_ns", mean("_s_width", "_n_width")),
        *U.nbs_columns("_np", "_npt", "_np_area"),
    )
    b = _join(
        base, U.thermal_wide(U.thermal_indices(t["cells"], t["heat_raster"], p)),
        U.station_weather(t["measurement"], t["station"], p),
    )
    share = lambda c, limit: F.coalesce(F.when(F.col(c) != 0, S.capped_pct(c, limit, 1)), F.lit(0.0))
    three = lambda k: [F.col(f"{k}_{m}") for m in ("mean", "min", "max")]
    return b.select(
        "province_id", "province",
        *three("lst"), share("lst_mean", MAX_LST).alias("lst_pct"),
        *three("tmrt"),
        *three("pet"), share("pet_mean", MAX_PET).alias("pet_pct"), S.classify_pet("pet_mean").alias("pet_category"),
        *three("utci"), share("utci_mean", MAX_UTCI).alias("utci_pct"), S.classify_utci("utci_mean").alias("utci_category"),
        *three("svf"), F.coalesce(S.rounded(F.col("svf_mean") * 100, 1), F.lit(0.0)).alias("svf_pct"),
        *three("suhii"),
        F.col("vegetation_coverage_pct").alias("vegetation_pct"), "park_area_km2", "green_lc_km2", "total_green_km2",
        "building_count", F.col("avg_building_height_m").alias("avg_height_m"), F.col("max_building_height_m").alias("max_height_m"),
        F.col("total_footprint_km2").alias("footprint_km2"), "avg_street_width_m", "aspect_ratio",
        F.col("total_count").alias("nbs_count"), F.col("total_area_km2").alias("nbs_area_km2"), F.col("total_area_m2").alias("nbs_area_m2"),
        F.col("temperature").alias("air_temp_c"), F.col("humidity").alias("humidity_pct"),
        F.col("wind").alias("wind_speed_m_s"), F.col("radiation").alias("solar_radiation"),
    )


def heat_scenarios(indicators: DataFrame, vegetation: Sequence[float | None]) -> DataFrame:
    """The heat rows once per vegetation scenario; only the vegetation share changes, and 0 is a valid share."""
    s = with_scenarios(indicators, vegetation, "scenario")
    return s.withColumn("vegetation_pct", F.coalesce("scenario", "vegetation_pct"))


def heat_bands(indicators: DataFrame) -> DataFrame:
    """Display bands of the heat rows."""
    return indicators.select(
        "province_id", S.band_thermal("pet_category").alias("pet_band"), S.band_thermal("utci_category").alias("utci_band"),
        S.band_aspect("aspect_ratio").alias("aspect_band"), S.band_suhii("suhii_mean").alias("suhii_band"),
    )


# --- output forms ---------------------------------------------------------------------

def to_json(indicators: DataFrame) -> DataFrame:
    """Programmatic form: province, year and one JSON object of the indicators."""
    keys = [c for c in ("province", "year") if c in indicators.columns]
    body = [c for c in indicators.columns if c not in ("province_id", *keys)]
    return indicators.select(*keys, F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("indicators"))


def to_long(indicators: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per indicator, for numeric columns."""
    keys = [c for c in ("province_id", "year") if c in indicators.columns]
    typed = indicators.select(*keys, *[F.col(n).cast("double").alias(n) for n in names])
    return typed.unpivot(keys, list(names), "indicator", "value")


