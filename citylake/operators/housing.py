"""Housing operators: supply and demand, pipeline, mortgages, rent, prices, vacancy, zoning, affordability."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylake.functions import scalars as S
from citylake.operators.hierarchy import by_city, by_neighborhood, climb, from_provinces, mean, spine
from citylake.operators.select import first_by

# Zone types and stress levels that are reported.
ZONE_TYPES = ("residential", "commercial", "industrial", "mixed")
STRESS_LEVELS = ("low", "moderate", "high")
# measure → reported mean
AFFORDABILITY = {
    "index": "avg_affordability_index", "income": "avg_median_income", "expenditure": "avg_median_expenditure",
    "disposable": "avg_median_disposable", "price": "avg_median_house_price", "rent": "avg_median_rent", "mortgage": "avg_median_mortgage",
}


def _in_years(df: DataFrame, years: Sequence[int]) -> DataFrame:
    return df.where(F.col("year").isin(*[int(y) for y in years]))


def balance(supply: Column, demand: Column, digits: int | None = 1) -> tuple[Column, ...]:
    deficit = demand - supply
    return (
        supply.alias("supply_units"), demand.alias("demand_units"), deficit.alias("deficit"),
        S.percent(deficit, demand, digits).alias("deficit_pct"),
    )


def rental_derived(rental: DataFrame, prop: DataFrame) -> DataFrame:
    """Annual rent and price-to-rent ratio of each rental."""
    p = prop.select(F.col("id").alias("property_id"), F.col("sale").alias("_price"))
    annual = F.col("monthly") * 12
    rest = [c for c in rental.columns if c not in ("annual", "price_to_rent")]
    return rental.join(p, "property_id", "left").select(
        *rest, annual.alias("annual"), S.price_to_rent(F.col("_price"), annual).alias("price_to_rent")
    )


def affordability_derived(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "index": S.affordability_index(F.col("price"), F.col("income")),
            "disposable": F.col("income") - F.col("expenditure"),
        }
    )


# --- supply, demand, pipeline ---------------------------------------------------------

def supply_demand_city(sd: DataFrame, city: DataFrame, years: Sequence[int], digits: int | None = 1) -> DataFrame:
    """First record of every city and year."""
    rows = _in_years(sd, years).where(F.col("city_id").isNotNull())
    first = first_by(rows.select("city_id", "year", "id", "supply", "demand"), ["city_id", "year"])
    out = spine(city, years, name="city_id").join(first, ["city_id", "year"], "left")
    return out.select("city_id", "year", *balance(S.or_zero("supply"), S.or_zero("demand"), digits))


def supply_demand(
    sd: DataFrame, city: DataFrame, province: DataFrame, years: Sequence[int], digits: int | None = 1
) -> DataFrame:
    """Sums over the cities of each province."""
    t = by_city(_in_years(sd, years), city, {"_s": F.sum("supply"), "_d": F.sum("demand")}, ["year"])
    return from_provinces(province, t, years).select(
        "province_id", "year", *balance(S.or_zero("_s"), S.or_zero("_d"), digits)
    )


def _pipeline(done: DataFrame, dim: DataFrame, name: str, years: Sequence[int]) -> DataFrame:
    """Completed up to a year against planned after it, from units per completion year."""
    out = spine(dim, years, name=name).join(done, name, "left")
    before = F.col("year_completion") <= F.col("year")
    after = F.col("year_completion") > F.col("year")
    pick = lambda cond, c: S.or_zero(F.sum(F.when(cond, F.col(c))))
    return out.groupBy(name, "year").agg(
        pick(before, "_u").alias("completed_units"),
        pick(before, "_n").alias("completed_projects"),
        pick(after, "_u").alias("pipeline_units"),
        pick(after, "_n").alias("pipeline_projects"),
    )


def _projects(projects: DataFrame, bridge: DataFrame, to: str) -> DataFrame:
    return by_neighborhood(
        projects, bridge, {"_u": F.sum("units"), "_n": F.count("*")}, ["year_completion"], to
    )


def new_units_city(projects: DataFrame, bridge: DataFrame, city: DataFrame, years: Sequence[int]) -> DataFrame:
    return _pipeline(_projects(projects, bridge, "city_id"), city, "city_id", years)


def new_units(projects: DataFrame, bridge: DataFrame, province: DataFrame, years: Sequence[int]) -> DataFrame:
    return _pipeline(_projects(projects, bridge, "province_id"), province, "province_id", years)


# --- markets --------------------------------------------------------------------------

def _property_chain(prop: DataFrame, building: DataFrame, bridge: DataFrame) -> list:
    return [(prop, "id", "building_id"), *_building_chain(building, bridge)]


def _building_chain(building: DataFrame, bridge: DataFrame) -> list:
    return [(building, "id", "neighborhood_id"), (bridge, "neighborhood_id", "province_id")]


def _means(cols: Sequence[str]) -> dict:
    out = {}
    for c in cols:
        out[f"_s_{c}"], out[f"_n_{c}"] = F.sum(c), F.count(c)
    return out


def _mean(c: str, prefix: str = ""):
    return mean(f"{prefix}_s_{c}", f"{prefix}_n_{c}")


def _loan_sums() -> dict:
    return {**_means(["monthly", "rate", "loan"]), "_n": F.count("*")}


def _loan_columns(digits: int | None, prefix: str = "") -> list:
    return [
        S.round_or_null(_mean("monthly", prefix), digits).alias("avg_monthly_payment"),
        S.round_or_null(_mean("rate", prefix), digits).alias("avg_interest_rate"),
        S.round_or_null(_mean("loan", prefix), digits).alias("avg_loan_amount"),
        S.or_zero(f"{prefix}_n").alias("total_mortgages"),
    ]


def _rent_sums() -> dict:
    return {**_means(["monthly", "annual", "price_to_rent"]), "_n": F.count("*")}


def _rent_columns(digits: tuple, prefix: str = "") -> list:
    return [
        S.round_or_null(_mean("monthly", prefix), digits[0]).alias("avg_monthly_rent"),
        S.round_or_null(_mean("annual", prefix), digits[0]).alias("avg_annual_rent"),
        S.round_or_null(_mean("price_to_rent", prefix), digits[1]).alias("avg_price_to_rent_ratio"),
        S.or_zero(f"{prefix}_n").alias("total_rentals"),
    ]


def _market_sums() -> dict:
    return {**_means(["sale", "listing", "per_sqm", "living_area"]), "_n": F.count("*")}


def _market_columns(digits: tuple, prefix: str = "") -> list:
    return [
        S.round_or_null(_mean("sale", prefix), digits[0]).alias("avg_sale_price"),
        S.round_or_null(_mean("listing", prefix), digits[0]).alias("avg_listing_price"),
        S.round_or_null(_mean("per_sqm", prefix), digits[0]).alias("avg_price_sqm"),
        S.round_or_null(_mean("living_area", prefix), digits[1]).alias("avg_living_area"),
        S.or_zero(f"{prefix}_n").alias("total_properties"),
    ]


def _vacancy_sums() -> dict:
    return {"_u": F.sum("units"), "_v": F.count_if(F.col("vacant")), "_b": F.count("*"), **_means(["vacancy_rate"])}


def _vacancy_columns(digits: int | None, prefix: str = "") -> list:
    return [
        S.or_zero(f"{prefix}_u").alias("total_units"), S.or_zero(f"{prefix}_v").alias("vacant_buildings"),
        S.or_zero(f"{prefix}_b").alias("total_buildings"),
        S.round_or_null(_mean("vacancy_rate", prefix), digits).alias("avg_vacancy_rate"),
    ]


def _named(measures: dict, prefix: str) -> list:
    return [c.alias(f"{prefix}{k}") for k, c in measures.items()]


def estate_sums(mortgage: DataFrame, rental: DataFrame, prop: DataFrame, building: DataFrame) -> DataFrame:
    """Sums and counts of loans, rents, prices and vacancy, one row a building with its neighborhood: loans and
    rents are summed by property, properties by building, and each table is read once."""
    sums = lambda df, *keys: [F.sum(c).alias(c) for c in df.columns if c not in keys]
    m = mortgage.groupBy(F.col("property_id").alias("id")).agg(*_named(_loan_sums(), "m"))
    r = rental.groupBy(F.col("property_id").alias("id")).agg(*_named(_rent_sums(), "r"))
    p = prop.groupBy("building_id", "id").agg(*_named(_market_sums(), "p")).join(m, "id", "left").join(r, "id", "left").drop("id")
    p = p.groupBy(F.col("building_id").alias("id")).agg(*sums(p, "building_id"))
    return building.groupBy("neighborhood_id", "id").agg(*_named(_vacancy_sums(), "b")).join(p, "id", "left").drop("id")


def estate_columns(digits: tuple = (2, 1)) -> list[Column]:
    return [*_loan_columns(digits[0], "m"), *_rent_columns(digits, "r"), *_market_columns(digits, "p"), *_vacancy_columns(digits[1], "b")]


def credit_terms(policy: DataFrame, credit: DataFrame, province: DataFrame, years: Sequence[int]) -> DataFrame:
    """First policy and credit record of each province and year."""
    keys = ["province_id", "year"]
    return from_provinces(province, policy_terms(policy, years), years).join(credit_records(credit, years), keys, "left")


def policy_terms(policy: DataFrame, years: Sequence[int]) -> DataFrame:
    keys = ["province_id", "year"]
    first = first_by(_in_years(policy, years).select(*keys, "id", "rate", "ltv", "lti"), keys)
    return first.select(*keys, F.col("rate").alias("interest_rate"), F.col("ltv").alias("ltv_limit"), F.col("lti").alias("lti_limit"))


def credit_records(credit: DataFrame, years: Sequence[int]) -> DataFrame:
    keys = ["province_id", "year"]
    first = first_by(_in_years(credit, years).select(*keys, "id", "rate", "approval", "down_payment"), keys)
    return first.select(
        *keys, F.col("rate").alias("mortgage_rate"), F.col("approval").alias("approval_rate"),
        F.col("down_payment").alias("avg_down_payment_pct"),
    )


def mortgage_indicators(
    mortgage: DataFrame, prop: DataFrame, building: DataFrame, bridge: DataFrame,
    policy: DataFrame, credit: DataFrame, province: DataFrame, years: Sequence[int], digits: int | None = 2,
) -> DataFrame:
    loans = climb(mortgage, "property_id", _loan_sums(), _property_chain(prop, building, bridge))
    out = credit_terms(policy, credit, province, years).join(loans, "province_id", "left")
    return out.select(
        "province_id", "year", "interest_rate", "ltv_limit", "lti_limit", "mortgage_rate", "approval_rate", "avg_down_payment_pct",
        *_loan_columns(digits),
    )


def house_price_index(
    hpi: DataFrame, bridge: DataFrame, province: DataFrame, years: Sequence[int], digits: int | None = 1
) -> DataFrame:
    """Mean index and its change on the year before; a gap year has no change."""
    wanted = sorted({int(y) for y in years} | {int(y) - 1 for y in years})
    t = by_neighborhood(_in_years(hpi, wanted), bridge, {**_means(["value"]), "_n": F.count("*")}, ["year"])
    t = t.select("province_id", "year", _mean("value").alias("_avg"), "_n")
    prev = t.select("province_id", (F.col("year") + 1).alias("year"), F.col("_avg").alias("_prev"))
    keys = ["province_id", "year"]
    out = from_provinces(province, t, years).join(prev, keys, "left")
    return out.select(*keys, *index_columns(F.col("_avg"), F.col("_prev"), digits), S.or_zero("_n").alias("neighborhoods_reported"))


def index_columns(value: Column, previous: Column, digits: int | None = 1) -> list[Column]:
    change = F.when((value != 0) & (previous > 0), S.rounded(S.ratio(value - previous, previous) * 100, digits))
    return [S.round_or_null(value, digits).alias("avg_index"), change.alias("yoy_change_pct")]


def rent_indicators(
    rental: DataFrame, prop: DataFrame, building: DataFrame, bridge: DataFrame, province: DataFrame,
    digits: tuple = (2, 1),
) -> DataFrame:
    t = climb(rental, "property_id", _rent_sums(), _property_chain(prop, building, bridge))
    return from_provinces(province, t).select("province_id", *_rent_columns(digits))


def vacancy(building: DataFrame, bridge: DataFrame, province: DataFrame, digits: int | None = 1) -> DataFrame:
    """Units, vacant buildings and mean known vacancy rate; one row per building, so no fan-out."""
    t = by_neighborhood(building, bridge, _vacancy_sums())
    return from_provinces(province, t).select("province_id", *_vacancy_columns(digits))


def property_indicators(
    prop: DataFrame, building: DataFrame, bridge: DataFrame, province: DataFrame, digits: tuple = (2, 1)
) -> DataFrame:
    t = climb(prop, "building_id", _market_sums(), _building_chain(building, bridge))
    market = from_provinces(province, t).select("province_id", *_market_columns(digits))
    return market.join(vacancy(building, bridge, province, digits[1]), "province_id")


# --- zoning, affordability ------------------------------------------------------------

def zoning(zones: DataFrame, bridge: DataFrame, province: DataFrame, digits: tuple = (1, 2)) -> DataFrame:
    """Total area and, for each reported type, area, count, share and mean benchmark price."""
    measures = {"_area": F.sum("area")}
    for t in ZONE_TYPES:
        hit = F.col("type") == t
        measures[f"_a_{t}"] = F.sum(F.when(hit, F.col("area")))
        measures[f"_n_{t}"] = F.count_if(hit)
        measures[f"_s_b_{t}"] = F.sum(F.when(hit, F.col("benchmark")))
        measures[f"_n_b_{t}"] = F.count(F.when(hit, F.col("benchmark")))
    rows = from_provinces(province, by_neighborhood(zones, bridge, measures))
    return rows.select("province_id", *zone_columns("_area", "_a_{}", "_n_{}", lambda t: _mean(f"b_{t}"), digits))


def zone_columns(
    total: str, area: str, count: str, benchmark: Callable[[str], Column], digits: tuple = (1, 2)
) -> list[Column]:
    """Columns of each zone type, from the columns named by these patterns."""
    zero = F.lit(0.0)
    total = F.coalesce(F.col(total), zero)
    cols = [total.alias("total_area_sqm")]
    for t in ZONE_TYPES:
        a = F.coalesce(F.col(area.format(t)), zero)
        cols += [
            a.alias(f"{t}_area_sqm"),
            S.or_zero(count.format(t)).alias(f"{t}_count"),
            F.coalesce(S.percent(a, total, digits[0]), zero).alias(f"{t}_area_pct"),
            S.round_or_null(benchmark(t), digits[1]).alias(f"{t}_avg_benchmark"),
        ]
    return cols


def affordability(
    aff: DataFrame, bridge: DataFrame, province: DataFrame, years: Sequence[int], digits: int | None = 2
) -> DataFrame:
    """Means of the yearly records with the number of neighborhoods at each stress level."""
    measures = {**_means(list(AFFORDABILITY)), "_n": F.count("*")}
    for level in STRESS_LEVELS:
        measures[f"_l_{level}"] = F.count_if(F.col("stress") == level)
    t = by_neighborhood(_in_years(aff, years), bridge, measures, ["year"])
    return from_provinces(province, t, years).select(
        "province_id", "year", *affordability_columns(digits), S.or_zero("_n").alias("neighborhoods_reported")
    )


def affordability_columns(digits: int | None = 2) -> list[Column]:
    return [
        *[S.round_or_null(_mean(c), digits).alias(n) for c, n in AFFORDABILITY.items()],
        *[S.or_zero(f"_l_{lv}").alias(f"stress_{lv}") for lv in STRESS_LEVELS],
    ]


def stress_distribution(aff_row: DataFrame) -> DataFrame:
    """The stress counts as one map per row; empty when nothing was reported."""
    pairs = F.map_from_arrays(
        F.array(*[F.lit(lv) for lv in STRESS_LEVELS]), F.array(*[F.col(f"stress_{lv}") for lv in STRESS_LEVELS])
    )
    empty = F.map_filter(pairs, lambda k, v: F.lit(False))
    return aff_row.withColumn(
        "stress_distribution", F.when(F.col("neighborhoods_reported") > 0, pairs).otherwise(empty)
    )
