"""Water supply operators. Every one returns all provinces (and years) in a single plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylake.functions import geometry as G
from citylake.functions import scalars as S
from citylake.operators import spatial as J
from citylake.operators.hierarchy import by_city, climb, from_provinces, mean, with_global
from citylake.operators.select import active, first_by, latest_by


def _years(df: DataFrame, years: Sequence[int] | None) -> DataFrame:
    return df if years is None else df.where(F.col("year").isin(*[int(y) for y in years]))


def _year_rows(df: DataFrame, years: Sequence[int] | None) -> DataFrame:
    """Left join from the listed years, so that a year without facts shows its defaults."""
    if years is None:
        return df
    spark = df.sparkSession
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(int(y)) for y in years])).alias("year"))
    return listed.join(df, "year", "left")


# --- demand ---------------------------------------------------------------------------

def consumption_capita(cc: DataFrame, city: DataFrame, province: DataFrame, years: Sequence[int]) -> DataFrame:
    """Unweighted mean of the cities' litres per person and day; 0 without records."""
    t = by_city(_years(cc, years), city, {"_s": F.sum("l_per_day"), "_n": F.count("l_per_day")}, ["year"])
    return from_provinces(province, t, years).select("province_id", "year", consumption_column("_s", "_n"))


def consumption_column(total: str, count: str) -> Column:
    return F.coalesce(mean(total, count), F.lit(0.0)).alias("consumption_capita")


def total_demand(cc: DataFrame, city: DataFrame, province: DataFrame, years: Sequence[int]) -> DataFrame:
    """m³/day = mean litres / 1000 × province population."""
    p = province.select(F.col("id").alias("province_id"), S.or_zero("population").alias("_pop"))
    return consumption_capita(cc, city, province, years).join(p, "province_id").select(
        "province_id", "year", (F.col("consumption_capita") / 1000 * F.col("_pop")).alias("demand_m3_d")
    )


def city_demand(city: DataFrame, cc: DataFrame) -> DataFrame:
    """Stored demand of a city and year, in m³."""
    day = F.col("population") * F.col("l_per_day") / 1000
    c = city.select(F.col("id").alias("city_id"), "population")
    return cc.join(c, "city_id").select(
        "city_id", "year", day.alias("demand_day"), (day * S.DAYS_PER_YEAR).alias("demand_yr")
    )


def city_consumption_yr(cc: DataFrame, city: DataFrame) -> DataFrame:
    """Consumption records with their yearly m³ refreshed from the city's population."""
    c = city.select(F.col("id").alias("city_id"), "population")
    rest = [x for x in cc.columns if x != "m3_yr"]
    return cc.join(c, "city_id").select(
        *rest, (F.col("l_per_day") / 1000 * F.col("population") * S.DAYS_PER_YEAR).alias("m3_yr")
    )


# --- wells ----------------------------------------------------------------------------

def pipe_derived(pipe: DataFrame) -> DataFrame:
    """Length in km and both diameters."""
    out = pipe
    if "geom" in pipe.columns:
        out = out.withColumn("length_km", G.length("geom") / 1000)
    inch = S.pipe_diameter_in("diameter_mm", "diameter_in")
    mm = S.pipe_diameter_mm("diameter_mm", "diameter_in")
    return out.withColumns({"diameter_in": inch, "diameter_mm": mm})


def well_emissions(well: DataFrame) -> DataFrame:
    rate = F.col("kwh_h") * F.col("co2_factor")
    return well.withColumns(
        {"co2_h": rate, "co2_day": rate * F.col("hours"), "co2_year": rate * F.col("hours") * S.DAYS_PER_YEAR}
    )


def well_opex(well: DataFrame) -> DataFrame:
    parts = F.col("labor") + F.col("energy") + F.col("chemicals") + F.col("tax")
    return well.withColumn("opex_m3", F.coalesce(F.col("opex_m3"), parts))


def well_env_cost(well: DataFrame, costs: DataFrame) -> DataFrame:
    """CO₂ cost and drought damage where they are missing, from the one-row price table."""
    priced = with_global(well, costs.agg(F.max("price_co2").alias("co2"), F.max("price_drought").alias("drought")), "_price")
    return priced.withColumns(
        {
            "co2_cost": F.coalesce(F.col("co2_cost"), F.col("co2_day") * F.col("_price.co2")),
            "drought_damage": F.coalesce(F.col("drought_damage"), F.col("co2_day") * F.col("_price.drought")),
        }
    ).drop("_price")


def well_totals(wells: DataFrame, province: DataFrame, cells: J.Cells | None = None) -> DataFrame:
    """Flow, pump energy and CO₂ of the active wells of each province: one spatial join for all three."""
    w = pumping(wells)
    p = province.select(F.col("id").alias("province_id"), "geom")
    pairs = J.spatial_join(w, p, "id", "province_id", keep=["flow_m3_s", "_kwh", "co2_day"], cells=cells)
    t = pairs.groupBy("province_id").agg(
        F.sum("flow_m3_s").alias("_flow"), F.sum("_kwh").alias("_kwh"), F.sum("co2_day").alias("_co2")
    )
    return from_provinces(province, t).select("province_id", *well_columns("_flow", "_kwh", "_co2"))


def pumping(wells: DataFrame) -> DataFrame:
    """Active wells with their pump energy of a day."""
    return active(wells).withColumn("_kwh", F.col("kwh_h") * F.col("hours"))


def well_columns(flow: str, kwh: str, co2: str) -> list[Column]:
    return [
        (S.or_zero(flow) * S.SECONDS_PER_DAY).alias("extraction_m3_d"), S.or_zero(kwh).alias("pump_kwh_d"), S.or_zero(co2).alias("co2_kg_d"),
    ]


def total_extraction(wells: DataFrame, province: DataFrame) -> DataFrame:
    return well_totals(wells, province).select("province_id", "extraction_m3_d")


def _imported_day(imports: DataFrame) -> DataFrame:
    return active(imports).agg(F.coalesce(F.sum("m3_d"), F.lit(0.0)).alias("m3_d"))


def imported_yr(imports: DataFrame) -> DataFrame:
    return _imported_day(imports).select((F.col("m3_d") * S.DAYS_PER_YEAR).alias("imported_m3_yr"))


def total_production(wells: DataFrame, imports: DataFrame, province: DataFrame | None = None) -> DataFrame:
    """Extraction plus the (global) active imports; without provinces, over all active wells."""
    if province is None:
        all_wells = active(wells).agg((F.coalesce(F.sum("flow_m3_s"), F.lit(0.0)) * S.SECONDS_PER_DAY).alias("extraction_m3_d"))
        out = with_global(all_wells, _imported_day(imports), "_imp")
        return out.select((F.col("extraction_m3_d") + F.col("_imp.m3_d")).alias("production_m3_d"))
    out = with_global(total_extraction(wells, province), _imported_day(imports), "_imp")
    return out.select("province_id", (F.col("extraction_m3_d") + F.col("_imp.m3_d")).alias("production_m3_d"))


def demand_by_province(demand: DataFrame, city: DataFrame, province: DataFrame) -> DataFrame:
    """Stored city demand of all years."""
    t = by_city(demand, city, {"_d": F.sum("demand_day")})
    return from_provinces(province, t).select("province_id", S.or_zero("_d").alias("demand_m3_d"))


def supply_security(
    demand: DataFrame, city: DataFrame, wells: DataFrame, imports: DataFrame, province: DataFrame
) -> DataFrame:
    """Production over demand; NULL when either is zero."""
    both = demand_by_province(demand, city, province).join(total_production(wells, imports, province), "province_id")
    d, s = F.col("demand_m3_d"), F.col("production_m3_d")
    return both.select(
        "province_id", "demand_m3_d", "production_m3_d", F.when((d != 0) & (s != 0), S.ratio(s, d)).alias("supply_security")
    )


def energy_consumption(wells: DataFrame, treatment: DataFrame, province: DataFrame) -> DataFrame:
    """Pump energy plus the (global) treatment energy, kWh/day."""
    wt = treatment.agg(F.coalesce(F.sum("energy"), F.lit(0.0)).alias("e"))
    out = with_global(well_totals(wells, province), wt, "_wt")
    return out.select("province_id", (F.col("pump_kwh_d") + F.col("_wt.e") * 1000).alias("energy_kwh_d"))


def co2_emission(wells: DataFrame, province: DataFrame) -> DataFrame:
    return well_totals(wells, province).select("province_id", "co2_kg_d")


# --- quality, meters, cost ------------------------------------------------------------

def water_quality(treatment: DataFrame, years: Sequence[int] | None = None, digits: int | None = 1) -> DataFrame:
    t = _years(treatment, years).groupBy("year").agg(
        F.sum("samples_taken").alias("_taken"),
        F.sum("samples_ok").alias("_ok"),
        F.avg("efficiency").alias("_eff"),
        F.avg("acceptance").alias("_acc"),
    )
    return _year_rows(t, years).select("year", *quality_columns("_taken", "_ok", F.col("_eff"), F.col("_acc"), digits))


def quality_columns(taken: str, passed: str, efficiency: Column, acceptance: Column, digits: int | None = 1) -> list[Column]:
    taken, passed = S.or_zero(taken), S.or_zero(passed)
    return [
        taken.alias("samples_taken"),
        passed.alias("samples_ok"),
        S.percent(passed, taken, digits).alias("compliance_pct"),
        S.round_or_null(efficiency, digits).alias("treatment_efficiency"),
        S.round_or_null(acceptance, digits).alias("acceptance_rate"),
    ]


def _meters_up(meters: DataFrame, users: DataFrame, bridge: DataFrame, measures: dict) -> DataFrame:
    return climb(
        meters, "users_location_id", measures,
        [(users, "id", "neighborhood_id"), (bridge, "neighborhood_id", "province_id")],
    )


def collection_ratio(
    meters: DataFrame, users: DataFrame, bridge: DataFrame, province: DataFrame, digits: int | None = 1
) -> DataFrame:
    t = _meters_up(meters, users, bridge, {"_i": F.sum("installed"), "_c": F.sum("collected")})
    return from_provinces(province, t).select("province_id", collection_column("_c", "_i", digits))


def collection_column(collected: str, installed: str, digits: int | None = 1) -> Column:
    return S.percent(S.or_zero(collected), S.or_zero(installed), digits).alias("collection_ratio")


def meter_recovery(meters: DataFrame, users: DataFrame, bridge: DataFrame, cc: DataFrame) -> DataFrame:
    """Metered consumption and revenue; rows without a rate or a served population stay as they are.

    The city's latest rate is pushed down to the neighborhoods first, so the meters need one join.
    """
    rate = latest_by(cc, ["city_id"], "year").select("city_id", F.col("l_per_day").alias("_rate"))
    local = bridge.select("neighborhood_id", "city_id").join(rate, "city_id").select("neighborhood_id", "_rate")
    u = users.select(F.col("id").alias("users_location_id"), "neighborhood_id", F.col("served").alias("_served"))
    u = u.join(local, "neighborhood_id", "left").select("users_location_id", "_served", "_rate")
    share = F.when(F.col("installed") != 0, F.col("collected") / F.col("installed")).otherwise(F.lit(0.0))
    use = F.col("_rate") / 1000 * S.DAYS_PER_YEAR * F.col("_served") * share
    known = F.col("_rate").isNotNull() & (S.or_zero("_served") != 0)
    out = meters.join(u, "users_location_id", "left").withColumn("_use", F.when(known, use))
    rest = [c for c in meters.columns if c not in ("consumption", "recovery")]
    return out.select(
        *rest,
        F.coalesce("_use", "consumption").alias("consumption"),
        F.coalesce(F.col("_use") * F.col("tariff"), F.col("recovery")).alias("recovery"),
    )


def opex_recovery(
    meters: DataFrame, users: DataFrame, bridge: DataFrame, opex: DataFrame, province: DataFrame,
    years: Sequence[int], digits: tuple = (2, 1),
) -> DataFrame:
    """Revenue of the province against the first OPEX record of the year."""
    revenue = _meters_up(meters, users, bridge, {"_rev": F.sum("recovery")})
    return _recovered(from_provinces(province, revenue), opex, years, digits)


def _recovered(base: DataFrame, opex: DataFrame, years: Sequence[int], digits: tuple) -> DataFrame:
    base = base.withColumn("year", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    return base.join(first_opex(opex, years), "year", "left").select("province_id", "year", *recovery_columns("_rev", "_opex", digits))


def first_opex(opex: DataFrame, years: Sequence[int]) -> DataFrame:
    """Total of the first OPEX record of each year."""
    return first_by(_years(opex, years).select("year", "id", "total"), ["year"]).select("year", F.col("total").alias("_opex"))


def recovery_columns(revenue: str, opex: str, digits: tuple = (2, 1)) -> list[Column]:
    rev, known = S.or_zero(revenue), F.when(F.col(opex) > 0, F.col(opex))
    return [
        S.rounded(rev, digits[0]).alias("revenue_eur"),
        S.rounded(known, digits[0]).alias("total_opex_eur"),
        S.percent(rev, known, digits[1]).alias("recovery_pct"),
    ]


def unit_opex(wells: DataFrame, meters: DataFrame) -> DataFrame:
    """Volume-weighted OPEX per m³ over active wells, and the share that the meters recover."""
    volume = F.col("current_mm3_yr") * 1_000_000
    w = active(wells).agg(F.sum(F.col("opex_m3") * volume).alias("total_opex"), F.sum(volume).alias("volume_m3"))
    out = with_global(w, meters.agg(F.sum("recovery").alias("r")), "_m")
    return out.select(
        "total_opex",
        S.or_zero(S.ratio(F.col("total_opex"), F.col("volume_m3"))).alias("unit_opex_m3"),
        F.col("_m.r").alias("opex_recovered"),
        F.when(F.col("_m.r") != 0, S.ratio(F.col("_m.r"), F.col("total_opex")) * 100).alias("opex_recovered_pct"),
    )


def opex_total(wells: DataFrame, imports: DataFrame, province: DataFrame) -> DataFrame:
    """Mean OPEX of the active wells × yearly supply."""
    avg = active(wells).agg(F.coalesce(F.avg("opex_m3"), F.lit(0.0)).alias("v"))
    out = with_global(total_production(wells, imports, province), avg, "_o")
    return out.select("province_id", (F.col("production_m3_d") * S.DAYS_PER_YEAR * F.col("_o.v")).alias("opex_total_eur"))


# --- network and coverage -------------------------------------------------------------

def coverage(cov: DataFrame, city: DataFrame, province: DataFrame, digits: tuple = (2, 1)) -> DataFrame:
    t = by_city(cov, city, {"_a": F.sum("area_km2"), "_c": F.sum("covered"), "_t": F.sum("total")})
    return from_provinces(province, t).select("province_id", *coverage_columns("_a", "_c", "_t", digits))


def coverage_columns(area: str, covered: str, total: str, digits: tuple = (2, 1)) -> list[Column]:
    covered, total = S.or_zero(covered), S.or_zero(total)
    return [
        S.rounded(F.coalesce(F.col(area), F.lit(0.0)), digits[0]).alias("covered_area_km2"),
        covered.alias("households_covered"),
        total.alias("households_total"),
        S.percent(covered, total, digits[1]).alias("coverage_pct"),
    ]


def city_pipes(city: DataFrame, pipes: DataFrame, users: DataFrame, bridge: DataFrame) -> DataFrame:
    """(city_id, id, geom): pipes that end in the city, or that cross it when none ends there."""
    ends = users.select(F.col("id").alias("destination_id"), "neighborhood_id").join(
        bridge.select("neighborhood_id", "city_id"), "neighborhood_id"
    )
    by_end = pipes.where(F.col("destination_id").isNotNull()).join(ends, "destination_id").select("city_id", "id", "geom")
    served = by_end.select("city_id").distinct()
    others = city.select(F.col("id").alias("city_id"), "geom").join(served, "city_id", "left_anti")
    crossing = J.spatial_join(pipes, others, "id", "city_id").join(pipes.select("id", "geom"), "id")
    return by_end.unionByName(crossing.select("city_id", "id", "geom"))


def build_coverage(
    city: DataFrame, pipes: DataFrame, users: DataFrame, neighborhood: DataFrame, bridge: DataFrame,
    d: float = 500.0, step: float = 50.0, digits: tuple = (4, 1),
) -> DataFrame:
    """Coverage per city. Households are exact; the area is counted on a grid of ``step`` metres."""
    lines = city_pipes(city, pipes, users, bridge)
    area = J.buffer_area(lines, "city_id", d, step)
    homes = users.groupBy("neighborhood_id").agg(F.sum("users_total").alias("_u"))
    homes = bridge.select("neighborhood_id", "city_id").join(homes, "neighborhood_id")
    total = homes.groupBy("city_id").agg(F.sum("_u").alias("_total"))
    zones = neighborhood.select(F.col("id").alias("neighborhood_id"), "geom")
    zones = zones.join(homes.select("neighborhood_id", "city_id").distinct(), "neighborhood_id")
    near = J.distance_join(lines, zones, "city_id", "neighborhood_id", d, within="city_id")
    covered = homes.join(near, ["neighborhood_id", "city_id"]).groupBy("city_id").agg(F.sum("_u").alias("_cov"))
    out = city.select(F.col("id").alias("city_id")).join(area, "city_id", "left").join(total, "city_id", "left").join(covered, "city_id", "left")
    cov, tot = S.or_zero("_cov"), S.or_zero("_total")
    return out.select(
        "city_id",
        S.rounded(F.coalesce(F.col("area"), F.lit(0.0)) / 1e6, digits[0]).alias("area_km2"),
        cov.alias("covered"),
        tot.alias("total"),
        F.coalesce(S.percent(cov, tot, digits[1]), F.lit(0.0)).alias("pct"),
    )


def network_length(pipes: DataFrame, province: DataFrame, cell: float = J.CELL) -> DataFrame:
    """Pipe length inside each province, km."""
    p = province.select(F.col("id").alias("province_id"), "geom")
    t = J.clip_length(pipes, p, "id", "province_id", cell=cell)
    return from_provinces(province, t).select(
        "province_id", F.coalesce(F.col("length") / 1000, F.lit(0.0)).alias("network_km")
    )


# --- losses, sources, drought ---------------------------------------------------------

def nrw(losses: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Apparent, real and total losses of a year, with the latest known leakage index."""
    real = F.col("type") == "R"
    rows = _years(losses, years)
    t = rows.groupBy("year").agg(
        F.sum(F.when(F.col("type") == "A", F.col("m3"))).alias("_a"),
        F.sum(F.when(real, F.col("m3"))).alias("_r"),
        F.max_by(
            F.when(real, F.col("ili")), F.when(real & F.col("ili").isNotNull(), F.struct("last_updated", "id"))
        ).alias("ili"),
    )
    a, r = F.coalesce("_a", F.lit(0.0)), F.coalesce("_r", F.lit(0.0))
    return _year_rows(t, years).select(
        "year", a.alias("apparent_m3_d"), r.alias("real_m3_d"), (a + r).alias("nrw_m3_d"), "ili"
    )


def loss_types(losses: DataFrame) -> DataFrame:
    """Loss records with their type set from the category."""
    rest = [c for c in losses.columns if c != "type"]
    return losses.select(*rest, S.loss_type("category").alias("type"))


def ili(losses: DataFrame, digits: int | None = 2) -> DataFrame:
    """Infrastructure leakage index per year over the real losses."""
    t = losses.where(F.col("type") == "R").groupBy("year").agg(
        F.sum("m3").alias("_m"), (F.sum(F.col("m3") * F.col("unavoidable_pct")) / 100).alias("_u")
    )
    return t.select("year", F.when(F.col("_u") > 0, S.rounded(S.ratio(F.col("_m"), F.col("_u")), digits)).alias("ili"))


def available_freshwater(sources: DataFrame, province: DataFrame) -> DataFrame:
    p = province.select(F.col("id").alias("province_id"), "geom")
    t = J.spatial_join(sources, p, "id", "province_id", keep=["quantity_mm3"]).groupBy("province_id").agg(
        F.sum("quantity_mm3").alias("_q")
    )
    return from_provinces(province, t).select("province_id", F.coalesce("_q", F.lit(0.0)).alias("available_mm3"))


def drought_area(drought: DataFrame, province: DataFrame, years: Sequence[int], digits: int | None = 2) -> DataFrame:
    t = _years(drought, years).groupBy("province_id", "year").agg(
        F.sum("area_km2").alias("_a"), F.max("level").alias("_l")
    )
    return from_provinces(province, t, years).select("province_id", "year", *drought_columns("_a", "_l", digits))


def drought_columns(area: str, level: str, digits: int | None = 2) -> list[Column]:
    return [S.rounded(F.coalesce(F.col(area), F.lit(0.0)), digits).alias("drought_area_km2"), S.or_zero(level).alias("max_sensibility")]


def source_production(
    sources: DataFrame, wells: DataFrame, province: DataFrame, tariff: DataFrame, years: Sequence[int],
    default_tariff: float = 0.15, seconds_per_hour: int = 3600,
) -> DataFrame:
    """Production (Mm³) and energy cost (EUR) of each source and year, from the wells that use it."""
    w = wells.groupBy(F.col("source_id").alias("id")).agg(
        F.sum(F.col("flow_m3_s") * F.col("hours")).alias("_fh"), F.sum(F.col("kwh_h") * F.col("hours")).alias("_kwh")
    )
    where = J.assign_by_centroid(sources, province.select(F.col("id").alias("province_id"), "geom"), "id", "province_id")
    base = sources.select("id").join(w, "id", "left").join(where.select("id", "province_id"), "id", "left")
    base = base.withColumn("year", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    price = tariff.groupBy("province_id", "year").agg(F.min_by("eur_kwh", "id").alias("_p"))
    day = F.coalesce("_fh", F.lit(0.0)) * seconds_per_hour / 1e6
    cost = F.coalesce("_kwh", F.lit(0.0)) * F.coalesce("_p", F.lit(default_tariff))
    return base.join(price, ["province_id", "year"], "left").select(
        F.col("id").alias("source_id"), "year", "province_id",
        day.alias("production_day"), (day * S.DAYS_PER_YEAR).alias("production_yr"),
        cost.alias("cost_day"), (cost * S.DAYS_PER_YEAR).alias("cost_yr"),
    )


