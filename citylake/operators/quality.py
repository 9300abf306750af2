"""Import mapping, foreign keys, upserts, row outcomes, reports and validation rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylake.functions import scalars as S

MAX_SAMPLE_ERRORS = 10

# File kinds that can be uploaded, and the accepted range of EPSG codes.
UPLOAD_EXTENSIONS = (".geojson", ".json", ".zip", ".shp", ".tif", ".tiff")
EPSG_RANGE = (1000, 100000)


# --- mapping --------------------------------------------------------------------------

def map_columns(df: DataFrame, mapping: dict[str, str], types: dict[str, str], source: str = "properties") -> DataFrame:
    """Target columns read from a map column of source text, trimmed and typed.

    A value that cannot be read becomes NULL and is named in ``errors``.
    """
    raw = {t: F.trim(F.col(source)[s]) for s, t in mapping.items()}
    typed = {t: S.cast_to(c, types.get(t, "string")) for t, c in raw.items()}
    bad = [
        F.when(raw[t].isNotNull() & typed[t].isNull(), F.lit(f"cannot read {t} as {types.get(t, 'string')}"))
        for t in typed
    ]
    errors = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    rest = [c for c in df.columns if c != source]
    return df.select(*rest, *[c.alias(t) for t, c in typed.items()], errors.alias("errors"))


# --- foreign keys ---------------------------------------------------------------------

def resolve_fk(
    df: DataFrame, col: str, parent: DataFrame, name_cols: Sequence[str] = ("name",), out: str | None = None,
    required: bool = False,
) -> DataFrame:
    """Parent id found by name (trimmed, any case; earlier name columns win), then by integer id.

    With ``required`` a miss is written to an error column, else it is just NULL.
    """
    out = out or f"{col}_id"
    key = F.lower(F.trim(F.col(col)))
    res = df.withColumn("_key", key)
    found = []
    for i, nc in enumerate(name_cols):
        names = parent.groupBy(F.lower(F.trim(F.col(nc))).alias("_key")).agg(F.min("id").alias(f"_by{i}"))
        res = res.join(names, "_key", "left")
        found.append(F.col(f"_by{i}"))
    ids = parent.select(F.col("id").alias("_pid")).distinct()
    id_type = parent.schema["id"].dataType
    res = res.withColumn("_raw", F.trim(F.col(col)).try_cast(id_type)).join(ids, F.col("_raw") == F.col("_pid"), "left")
    found.append(F.col("_pid"))
    value = F.coalesce(*found)
    cols = [*df.columns, value.alias(out)]
    if required:
        cols.append(F.when(value.isNull(), F.concat(F.lit(f"no match for {col}: "), F.coalesce(F.col(col), F.lit("NULL")))).alias("fk_error"))
    return res.select(*cols)


def join_city(df: DataFrame, city: DataFrame, code: str) -> DataFrame:
    """City of a municipality number; rows whose city is unknown are left out."""
    c = city.select(F.col("id").cast("long").alias("_cid"))
    return df.join(c, F.col(code) == F.col("_cid")).withColumnRenamed("_cid", "city_id")


# --- writes ---------------------------------------------------------------------------

def last_per_key(updates: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: for each column its last given value, as repeated updates would leave it.

    Runs as a partial aggregate, so a key that repeats very often is reduced before the shuffle.
    """
    rest = [c for c in updates.columns if c not in keys and c != order]
    return updates.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest]
    )


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """New snapshot of the target. Only columns that the updates carry are changed, and a value
    missing in an update leaves the old one.

    ``order`` ranks repeated updates of one key (the highest wins); without it keys must be unique.
    """
    keys = list(keys)
    u = last_per_key(updates, keys, order) if order else updates
    changed = [c for c in u.columns if c not in keys]
    unknown = set(changed) - set(target.columns)
    if unknown:
        raise ValueError(f"not in the target: {sorted(unknown)}")
    u = u.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in changed])
    out = target.join(u, keys, "full_outer")
    return out.select(
        *[
            F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c)
            for c in target.columns
        ]
    )


def append(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Load without a key: rows are added, columns they lack are NULL."""
    return target.unionByName(rows, allowMissingColumns=True)


# --- outcomes and reports -------------------------------------------------------------

def classify_rows(
    updates: DataFrame, target: DataFrame, keys: Sequence[str], compare: Sequence[str],
    required_geom: str | None = None, errors: str | None = None,
) -> DataFrame:
    """Updates with ``outcome`` (created, updated, skipped, error) and ``reasons``.

    Rows are compared before anything is written. A value missing in the update does not count as
    a change. A required geometry that is missing skips the row; a missing key or a listed error
    rejects it.
    """
    keys = list(keys)
    t = target.select(*keys, F.lit(True).alias("_there"), *[F.col(c).alias(f"_old_{c}") for c in compare])
    no_key = [F.when(F.col(k).isNull(), F.lit(f"missing key {k}")) for k in keys]
    reasons = F.array_compact(F.array(*no_key))
    if errors:
        reasons = F.concat(reasons, F.coalesce(F.col(errors), F.array().cast("array<string>")))
    changed = F.lit(False)
    for c in compare:
        changed = changed | (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_old_{c}")))
    outcome = F.when(F.size("reasons") > 0, "error")
    if required_geom:
        outcome = outcome.when(F.col(required_geom).isNull(), "skipped")
    outcome = outcome.when(F.col("_there").isNull(), "created").when(changed, "updated").otherwise("skipped")
    return (
        updates.withColumn("reasons", reasons)
        .join(t, keys, "left")
        .withColumn("outcome", outcome)
        .select(*updates.columns, "outcome", "reasons")
    )


def import_report(outcomes: DataFrame, order: str | None = None, max_errors: int | None = None) -> DataFrame:
    """One row: total, created, updated, skipped, errors, up to ten sample errors, stopped.

    Counts are one aggregate. The samples are a top-k over the error rows. ``max_errors`` marks a
    run that has to stop because more rows than that failed.
    """
    n = lambda o: F.count_if(F.col("outcome") == o)
    counts = outcomes.agg(
        F.count("*").alias("total_rows"), n("created").alias("created"), n("updated").alias("updated"),
        n("skipped").alias("skipped"), n("error").alias("errors"),
    )
    bad = outcomes.where(F.col("outcome") == "error").withColumn("_text", F.array_join("reasons", "; "))
    bad = bad.orderBy(order) if order else bad.orderBy("_text")
    sample = bad.limit(MAX_SAMPLE_ERRORS).agg(F.array_sort(F.collect_list("_text")).alias("s"))
    out = counts.withColumn("sample_errors", sample.scalar())
    stop = F.lit(False) if max_errors is None else F.col("errors") > max_errors
    return out.withColumn("stopped", stop)


def run_import(
    target: DataFrame, updates: DataFrame, keys: Sequence[str], compare: Sequence[str], order: str,
    dry_run: bool = True, required_geom: str | None = None, errors: str | None = None, max_errors: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(snapshot, report). A dry run leaves the snapshot as the target was."""
    marked = classify_rows(updates, target, keys, compare, required_geom, errors)
    report = import_report(marked, order, max_errors)
    if dry_run:
        return target, report
    good = marked.where(F.col("outcome").isin("created", "updated")).select(order, *keys, *compare)
    if max_errors is not None:
        # more failures than allowed: nothing is written
        failed = marked.agg((F.count_if(F.col("outcome") == "error") > max_errors)).scalar()
        good = good.where(~failed)
    return upsert(target, good, keys, order), report


# --- validation -----------------------------------------------------------------------

def validate(df: DataFrame, rules: dict[str, Column], id_col: str = "id") -> DataFrame:
    """Violations (id, rule): every row for every rule whose condition is not met. NULL passes."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(id_col, F.explode(broken).alias("rule"))


def consumption_rules() -> dict[str, Column]:
    return {"per-capita consumption must not be negative": F.col("l_per_day") >= 0}


def loss_rules() -> dict[str, Column]:
    fits = F.when(F.col("type") == "A", F.col("category").isin(*S.APPARENT_LOSS_CATEGORIES)).when(
        F.col("type") == "R", F.col("category").isin(*S.REAL_LOSS_CATEGORIES)
    )
    return {"loss category does not fit the loss type": fits}


def stress_category_rules() -> dict[str, Column]:
    filled = lambda c: F.coalesce(F.length(F.col(c)) > 0, F.lit(False))
    return {"a stress category lacks its name": filled("category"), "a stress category lacks its description": filled("description")}


def upload_rules() -> dict[str, Column]:
    name = F.lower("file_name")
    known = None
    for e in UPLOAD_EXTENSIONS:
        hit = name.endswith(e)
        known = hit if known is None else known | hit
    return {
        "unsupported file extension": known,
        "EPSG code out of range": F.col("source_crs").between(*EPSG_RANGE),
    }


def member_rule(c: str, allowed: Sequence) -> dict[str, Column]:
    return {f"{c} is not an allowed value": F.col(c).isin(*allowed)}


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


