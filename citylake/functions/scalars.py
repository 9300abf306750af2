"""Scalar rules used by the indicator operators. Every function takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors and display limits.
SECONDS_PER_DAY = 86400
DAYS_PER_YEAR = 365
MM_PER_INCH = 25.4

# The words that mark a land-cover class as green.
GREEN_WORDS = ("forest", "grass", "green", "vegetation", "tree", "park", "nature")

# Loss categories that count as real losses.
REAL_LOSS_CATEGORIES = ("LP", "LS", "LM", "OT")
APPARENT_LOSS_CATEGORIES = ("CM", "UA", "DE", "OT")

# Fixed values: (upper bound, class) in ascending order; the last class has no bound.
PET_CLASSES = (
    (4, "Very Cold Stress"),
    (8, "Cold Stress"),
    (13, "Slight Cold Stress"),
    (18, "No Thermal Stress (cool)"),
    (23, "Comfortable"),
    (29, "No Thermal Stress (warm)"),
    (35, "Slight Heat Stress"),
    (41, "Moderate Heat Stress"),
    (None, "Extreme Heat Stress"),
)
UTCI_CLASSES = (
    (-40, "Extreme Cold Stress"),
    (-27, "Very Strong Cold Stress"),
    (-13, "Strong Cold Stress"),
    (0, "Moderate Cold Stress"),
    (9, "Slight Cold Stress"),
    (26, "No Thermal Stress"),
    (32, "Moderate Heat Stress"),
    (38, "Strong Heat Stress"),
    (46, "Very Strong Heat Stress"),
    (None, "Extreme Heat Stress"),
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- missing values -------------------------------------------------------------------

def or_zero(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0))


def rounded(c: Column | str, digits: int | None) -> Column:
    """Half-up rounding; ``digits=None`` leaves the value as it is."""
    return col(c) if digits is None else F.round(col(c).cast("double"), digits)


def round_or_null(c: Column | str, digits: int | None) -> Column:
    """Round, but report a value of exactly zero as missing."""
    return F.when(col(c) != 0, rounded(c, digits))


def ratio(num: Column, den: Column) -> Column:
    """num / den as a double, NULL when den is 0 or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent(num: Column, den: Column, digits: int | None = 1) -> Column:
    """num / den * 100, rounded; NULL when den is 0 or NULL."""
    return rounded(ratio(num, den) * 100, digits)


def capped_pct(x: Column | str, limit: float, digits: int | None = None) -> Column:
    return rounded(F.least(col(x) / F.lit(float(limit)) * 100, F.lit(100.0)), digits)


# --- derived quantities ---------------------------------------------------------------

def density(population: Column | str, area_km2: Column | str) -> Column:
    """Inhabitants per km²; NULL unless the area is positive."""
    return F.when(col(area_km2) > 0, ratio(col(population), col(area_km2)))


def pipe_diameter_in(mm: Column | str, inch: Column | str) -> Column:
    """Inches follow millimetres whenever millimetres are known."""
    return F.coalesce(col(mm) / F.lit(MM_PER_INCH), col(inch))


def pipe_diameter_mm(mm: Column | str, inch: Column | str) -> Column:
    return F.coalesce(col(mm), col(inch) * F.lit(MM_PER_INCH))


def service_hours(supply: Column, demand: Column, digits: int | None = 1, full: float = 24.0) -> Column:
    """Hours per day that the supply can meet the demand."""
    return F.when(supply >= demand, F.lit(full)).otherwise(rounded(ratio(F.lit(full) * supply, demand), digits))


def annuity(loan: Column, rate_pct: Column, months: int = 360, digits: int | None = 2) -> Column:
    """Monthly payment of an annuity loan; a zero rate spreads the loan evenly."""
    r = rate_pct / 100 / 12
    growth = F.pow(1 + r, F.lit(months))
    return rounded(
        F.when(r > 0, F.try_divide(loan * r * growth, growth - 1)).otherwise(loan / F.lit(float(months))), digits
    )


def price_to_rent(price: Column, annual: Column) -> Column:
    return F.when(annual == 0, F.lit(0.0)).otherwise(F.try_divide(price, annual))


def affordability_index(price: Column, income: Column) -> Column:
    return F.when(income == 0, F.lit(0.0)).otherwise(F.try_divide(price, income))


# --- classes --------------------------------------------------------------------------

def loss_type(category: Column | str) -> Column:
    """'R' (real) or 'A' (apparent)."""
    return F.when(col(category).isin(*REAL_LOSS_CATEGORIES), F.lit("R")).otherwise(F.lit("A"))


def _classify(value: Column, classes) -> Column:
    out = None
    for bound, label in classes[:-1]:
        cond = value < bound
        out = F.when(cond, label) if out is None else out.when(cond, label)
    # the last class must not catch NULL
    return out.when(value.isNotNull(), classes[-1][1])


def classify_pet(value: Column | str) -> Column:
    return _classify(col(value), PET_CLASSES)


def classify_utci(value: Column | str) -> Column:
    return _classify(col(value), UTCI_CLASSES)


def band_ili(ili: Column | str) -> Column:
    c = col(ili)
    return F.when(c <= 2, "good").when(c <= 4, "fair").when(c.isNotNull(), "poor")


def band_aspect(aspect: Column | str) -> Column:
    c = col(aspect)
    return F.when(c > 1.5, "high").when(c > 1.0, "medium").when(c.isNotNull(), "low")


def band_suhii(suhii: Column | str) -> Column:
    c = col(suhii)
    return F.when(c > 4, "high").when(c > 2, "medium").when(c.isNotNull(), "low")


def band_thermal(category: Column | str) -> Column:
    """Hot, cold or neutral, read from the class name."""
    c = col(category)
    return F.when(c.contains("Heat"), "hot").when(c.contains("Cold"), "cold").when(c.isNotNull(), "neutral")


def is_green(class_name: Column | str) -> Column:
    return col(class_name).rlike("(?i)" + "|".join(GREEN_WORDS))


# --- coercion of source text ----------------------------------------------------------

def cast_to(c: Column | str, type_name: str) -> Column:
    """Typed value of a raw text column; NULL when it cannot be read, NaN counts as NULL."""
    c = col(c)
    if type_name == "boolean":
        return F.when(c.isNotNull(), F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y"))
    if type_name in ("double", "float"):
        value = c.cast("string").try_cast(type_name)
        return F.when(~F.isnan(value), value)
    if type_name == "string":
        return c.cast("string")
    return F.trim(c.cast("string")).try_cast(type_name)


def period_year(period: Column | str) -> Column:
    """Year of a period code such as 2023JJ00; NULL when shorter than four characters."""
    p = F.trim(col(period))
    return F.when(F.length(p) >= 4, F.substring(p, 1, 4).try_cast("int"))


def gm_code(region: Column | str) -> Column:
    """Municipality number of a region code such as 'GM0363  '; NULL when it is not one."""
    return F.replace(F.trim(col(region)), F.lit("GM"), F.lit("")).try_cast("long")


def iequals(a: Column | str, b: Column | str) -> Column:
    return F.lower(F.trim(col(a))) == F.lower(F.trim(col(b)))
