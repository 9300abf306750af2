"""Administrative hierarchy: bridges, climbing aggregates, dimension spines, population roll-up."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylake.functions.scalars import density, or_zero


def hierarchy(neighborhood: DataFrame, district: DataFrame, city: DataFrame) -> DataFrame:
    """Bridge (neighborhood_id, district_id, city_id, province_id); incomplete chains drop out."""
    c = city.select(F.col("id").alias("city_id"), "province_id")
    d = district.select(F.col("id").alias("district_id"), "city_id")
    n = neighborhood.select(F.col("id").alias("neighborhood_id"), "district_id")
    return n.join(d.join(c, "city_id"), "district_id").select(
        "neighborhood_id", "district_id", "city_id", "province_id"
    )


def climb(
    facts: DataFrame,
    key: str,
    measures: dict[str, Column],
    steps: Sequence[tuple[DataFrame, str, str]],
    by: Iterable[str] = (),
) -> DataFrame:
    """Aggregate facts up a chain of parent tables.

    ``measures`` are sums or counts over the fact rows; ``steps`` lists (parent, its key, its
    own parent key). The facts are aggregated on their own key before the first join and again
    on every level, so a join never sees more than one row per key and group: a parent that
    owns a third of all facts is reduced before the shuffle instead of landing in one task.
    """
    by = list(by)
    out = facts.groupBy(F.col(key).alias("_k"), *by).agg(*[m.alias(n) for n, m in measures.items()])
    for i, (parent, pk, fk) in enumerate(steps):
        last = i == len(steps) - 1
        up = parent.select(F.col(pk).alias("_k"), F.col(fk).alias("_up"))
        out = (
            out.join(up, "_k")
            .groupBy(F.col("_up").alias(fk if last else "_k"), *by)
            .agg(*[F.sum(n).alias(n) for n in measures])
        )
    return out


def by_city(facts: DataFrame, city: DataFrame, measures: dict[str, Column], by: Iterable[str] = ()) -> DataFrame:
    return climb(facts, "city_id", measures, [(city, "id", "province_id")], by)


def by_neighborhood(
    facts: DataFrame, bridge: DataFrame, measures: dict[str, Column], by: Iterable[str] = (), to: str = "province_id"
) -> DataFrame:
    return climb(facts, "neighborhood_id", measures, [(bridge, "neighborhood_id", to)], by)


def mean(total: str, count: str) -> Column:
    """Mean from its parts; NULL when nothing was counted."""
    return F.try_divide(F.col(total).cast("double"), F.col(count).cast("double"))


def attach_province(facts: DataFrame, steps: Sequence[tuple[DataFrame, str, str]], key: str) -> DataFrame:
    """Fact rows with the province reached over unique parent keys; rows without one drop out."""
    parent, pk, fk = steps[-1]
    path = parent.select(F.col(pk).alias("_k"), F.col(fk).alias("province_id"))
    for parent, pk, fk in reversed(steps[:-1]):
        up = parent.select(F.col(pk).alias("_c"), F.col(fk).alias("_k"))
        path = up.join(path, "_k").select(F.col("_c").alias("_k"), "province_id")
    return facts.join(path.withColumnRenamed("_k", key), key)


def spine(dim: DataFrame, years: Sequence[int] | None = None, id_col: str = "id", name: str = "province_id") -> DataFrame:
    """One row per dimension member, or per member and listed year. No join is needed for the years."""
    out = dim.select(F.col(id_col).alias(name))
    if years is not None:
        out = out.withColumn("year", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    return out


def from_provinces(
    province: DataFrame, facts: DataFrame, years: Sequence[int] | None = None, name: str = "province_id"
) -> DataFrame:
    """Left join from the dimension, so that members without facts stay in the result."""
    keys = [name] if years is None else [name, "year"]
    return spine(province, years, name=name).join(facts, keys, "left")


def with_global(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Attach a one-row aggregate as a struct column. A scalar subquery, so no join takes place."""
    return df.withColumn(name, one_row.select(F.struct(*one_row.columns)).scalar())


def with_scenarios(df: DataFrame, values: Sequence[float], name: str) -> DataFrame:
    """Every row once per scenario value; scenarios come from the caller, so no join takes place."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v).cast("double") for v in values])))


def sum_children(children: DataFrame, parent_key: str) -> DataFrame:
    return children.groupBy(F.col(parent_key).alias("id")).agg(F.sum("population").alias("_total"))


def _recompute(parent: DataFrame, children: DataFrame, parent_key: str) -> DataFrame:
    total = or_zero("_total").cast("long")
    rest = [c for c in parent.columns if c not in ("population", "density")]
    return parent.join(sum_children(children, parent_key), "id", "left").select(
        *rest, total.alias("population"), density(total, "area_km2").alias("density")
    )


def rollup_population(
    neighborhood: DataFrame, district: DataFrame, city: DataFrame, province: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(district, city, province) with population summed bottom-up and density recomputed."""
    d = _recompute(district, neighborhood, "district_id")
    c = _recompute(city, d, "city_id")
    p = _recompute(province, c, "province_id")
    return d, c, p


def fill_province_population(province: DataFrame, city: DataFrame) -> DataFrame:
    """A missing province population is the sum of its cities."""
    rest = [c for c in province.columns if c not in ("population", "density")]
    population = F.coalesce(F.col("population").cast("long"), F.col("_total"))
    return province.join(sum_children(city, "province_id"), "id", "left").select(
        *rest, population.alias("population"), density(population, "area_km2").alias("density")
    )
