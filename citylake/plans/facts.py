"""One long table of facts, climbed once through the hierarchy and turned wide once.

Each source adds its rows as they are: the fact's name, the key they are known by, a year (or none), and
measures in numbered slots that all facts share. The rows of one level are one union, so a level costs one
aggregate and one join with its parent table, however many facts there are, and no table is read twice. At
the provinces a conditional aggregate gives every measure its own column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylake.operators import spatial as J

OPS = {"sum": F.sum, "max": F.max}
# which years of a fact count for a year of the result: that year, those up to it, those after it, the one before
SAME, BEFORE, AFTER, PREVIOUS = "same", "before", "after", "previous"


def total(c: str | Column, at: str = SAME) -> tuple:
    return "sum", F.col(c) if isinstance(c, str) else c, at


def number(c: str | Column | None = None, at: str = SAME) -> tuple:
    """Rows, or rows in which the column is known."""
    if c is None:
        return "sum", F.lit(1).cast("long"), at
    return "sum", (F.col(c) if isinstance(c, str) else c).isNotNull().cast("int").cast("long"), at


def number_if(condition: Column, at: str = SAME) -> tuple:
    return "sum", F.coalesce(condition, F.lit(False)).cast("int").cast("long"), at


def greatest(c: str) -> tuple:
    return "max", F.col(c), SAME


def means(columns: Sequence[str], prefix: str = "", at: str = SAME) -> dict[str, tuple]:
    """What the means of columns are made of, by the names that ``hierarchy.mean`` asks for."""
    out = {}
    for c in columns:
        out[f"{prefix}_s_{c}"], out[f"{prefix}_n_{c}"] = total(c, at), number(c, at)
    return out


@dataclass
class Facts:
    """Facts by the level of their key. ``years`` are those of the result."""

    years: Sequence[int]
    rows: dict[str, list[DataFrame]] = field(default_factory=dict)
    placed: list[DataFrame] = field(default_factory=list)
    measures: dict[str, tuple[str, str, str, str]] = field(default_factory=dict)  # column → fact, slot, operation, years

    def _slots(self, fact: str, df: DataFrame, measures: dict[str, tuple]) -> list[Column]:
        """The measures in slots; one of the same operation and type as another fact's shares its slot."""
        types = df.select(*[c.alias(n) for n, (_, c, _) in measures.items()]).schema
        known: dict[tuple, str] = {}
        used: dict[str, int] = {}
        out = []
        for name, (op, column, at) in measures.items():
            kind = types[name].dataType.simpleString()
            kind = "bigint" if op == "sum" and kind in ("tinyint", "smallint", "int") else kind
            same = (op, str(column), kind)
            if same not in known:
                base = f"{op}_{kind}"
                used[base] = used.get(base, 0) + 1
                known[same] = f"{base}_{used[base]}".replace("(", "_").replace(",", "_").replace(")", "")
                out.append(column.cast(kind).alias(known[same]))
            self.measures[name] = (fact, known[same], op, at)
        return out

    def add(self, fact: str, df: DataFrame, key: str, measures: dict[str, tuple], year: str | None = None) -> Facts:
        """Rows of a fact, known by ``key``; without a year they count for each."""
        when = F.lit(None) if year is None else F.col(year)
        columns = [F.lit(fact).alias("fact"), F.col(key), when.cast("int").alias("year"), *self._slots(fact, df, measures)]
        self.rows.setdefault(key, []).append(df.select(*columns))
        return self

    def place(self, fact: str, df: DataFrame, measures: dict[str, tuple], id_col: str = "id", geom: str = "geom") -> Facts:
        """Rows of a fact that count for every province which their geometry meets."""
        feature = F.struct(F.lit(fact).alias("fact"), F.col(id_col).cast("string").alias("id")).alias("feature")
        self.placed.append(df.select(feature, F.col(geom).alias("geom"), *self._slots(fact, df, measures)))
        return self

    def wide(self, province: DataFrame, parents: Sequence[tuple[str, DataFrame, str, str]] = (), more: Sequence[Column] = ()) -> DataFrame:
        """One row for each province and year, with every measure and ``more`` columns of the province.

        ``parents`` lists (key, parent table, its own key, the key it leads to) from the lowest level up, to
        ``province_id``. Rows whose parent is missing drop out.
        """
        rows = dict(self.rows)
        if self.placed:
            features = _union(self.placed)
            slots = [c for c in features.columns if c not in ("feature", "geom")]
            zones = province.select(F.col("id").alias("province_id"), "geom")
            pairs = J.spatial_join(features, zones, "feature", "province_id", keep=slots)
            met = pairs.select("feature.fact", "province_id", F.lit(None).cast("int").alias("year"), *slots)
            rows["province_id"] = [*rows.get("province_id", []), met]
        below = None
        for key, parent, own, up in parents:
            parts = rows.get(key, []) + ([below] if below is not None else [])
            if parts:
                level = self._added(_union(parts), key)
                above = parent.select(F.col(own).alias(key), F.col(up).alias("_up"))
                below = level.join(above, key).drop(key).withColumnRenamed("_up", up)
        parts = rows.get("province_id", []) + ([below] if below is not None else [])
        base = province.select(F.col("id").alias("province_id"), *more, F.explode(_listed(self.years)).alias("year"))
        turned = self._turned(self._added(_union(parts), "province_id"), "province_id")
        return base.join(turned, ["province_id", "year"], "left")

    def overall(self, key: str = "everywhere") -> DataFrame:
        """The facts without a place, added under a constant ``key``: one row for each year."""
        added = self._added(_union(self.rows[key]), key)
        return self._turned(added, key).drop(key)

    def _added(self, df: DataFrame, key: str) -> DataFrame:
        slots = [c for c in df.columns if c not in ("fact", key, "year")]
        return df.groupBy("fact", key, "year").agg(*[OPS[c.split("_")[0]](c).alias(c) for c in slots])

    def _turned(self, added: DataFrame, key: str) -> DataFrame:
        """Rows of (fact, key, year) as one row for each key and listed year."""
        named = {n: m for n, m in self.measures.items() if m[1] in added.columns}
        ways: dict[str, set[str]] = {}
        for fact, _, _, at in named.values():
            ways.setdefault(fact, set()).add(at)
        every = [f for f, w in ways.items() if w & {BEFORE, AFTER}]
        next_too = [f for f, w in ways.items() if PREVIOUS in w]
        counts = F.when(F.col("year").isNull() | F.col("fact").isin(every), _listed(self.years))
        counts = counts.when(F.col("fact").isin(next_too), F.array("year", F.col("year") + 1)).otherwise(F.array("year"))
        rows = added.withColumn("_y", F.explode(counts)).where(F.col("_y").isin([int(y) for y in self.years]))
        then, year = F.col("year"), F.col("_y")
        true = {
            SAME: then.isNull() | (then == year), BEFORE: then <= year, AFTER: then > year, PREVIOUS: then == year - 1,
        }
        columns = [OPS[op](F.when((F.col("fact") == fact) & true[at], F.col(slot))).alias(n) for n, (fact, slot, op, at) in named.items()]
        return rows.groupBy(key, F.col("_y").alias("year")).agg(*columns)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _listed(years: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(y)) for y in years])
