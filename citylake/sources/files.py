"""Readers for landed files. Parallelism is the number of files or splits; nothing is read on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citylake.functions import geometry as G
from citylake.functions import scalars as S

_FEATURE = "geometry struct<type:string,coordinates:string>, properties map<string,string>"
_MEASUREMENT = (
    "station_id long, date timestamp, precipitation double, wind double, temperature double, "
    "radiation double, humidity double, vapor_pressure double"
)
_CELL = "raster_id long, date date, band string, col long, row long, x double, y double, value double"


def _with_geom(df: DataFrame, srid: int, order: Sequence[Column]) -> DataFrame:
    geom = G.from_geojson("_f.geometry.type", "_f.geometry.coordinates", srid)
    return df.select(F.col("_f.properties").alias("properties"), geom.alias("geom"), *order)


def read_geojson(
    spark: SparkSession, path: str | Sequence[str], srid: int = G.WGS84, multiline: bool = True, pages: bool = False,
    delivery: str | None = None,
) -> DataFrame:
    """Features as (properties map, geom). With ``multiline`` each file is one FeatureCollection (a page),
    with ``pages`` each line is one; without them each line is one Feature, which also splits large files.
    ``arrival`` orders the features, see ``arrival_order``; those of one page by their place in it."""
    if multiline or pages:
        read = spark.read.schema(f"features array<struct<{_FEATURE}>>").option("multiLine", not pages).json(path)
        rows = read.select(arrival_order(delivery).alias("_o"), F.posexplode("features").alias("_pos", "_f"))
        return _with_geom(rows, srid, [F.struct("_o", F.col("_pos").alias("row")).alias("arrival")])
    lines = spark.read.schema(_FEATURE).json(path)
    rows = lines.select(F.struct("geometry", "properties").alias("_f"), arrival_order(delivery).alias("_o"))
    return _with_geom(rows, srid, [F.col("_o").alias("arrival")])


def arrival_order(delivery: str | None = None) -> Column:
    """A value of each row read from files that grows with its arrival: by delivery, by the time at which the
    file was last written, by the file's name, and by the row's place in it.

    ``delivery`` is a pattern whose first group is a number in the file's path, for files whose times say
    nothing (copies, say); files without one come first. Numbers in names count as numbers, so page-10 comes
    after page-9. A place is the start of the block that a task reads and the row's number in the task, which
    only grows.
    """
    path = F.col("_metadata.file_path")
    given = F.lit(None) if delivery is None else F.regexp_extract(path, delivery, 1)
    return F.struct(
        given.try_cast("decimal(38,0)").alias("delivery"), F.col("_metadata.file_modification_time").alias("time"), _natural(path).alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("position"),
    )


def _natural(name: Column) -> Column:
    """A name as an array of its texts and numbers, in which the numbers are led by their count of digits."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda p: F.ltrim(p, F.lit("0"))
    return F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 5, "0"), digits(p))).otherwise(p))


def read_odata(
    spark: SparkSession, path: str | Sequence[str], where: Column | None = None, select: Sequence[str] | None = None,
    multiline: bool = True, delivery: str | None = None,
) -> DataFrame:
    """Rows of landed OData pages as a map column ``properties``, or as the selected text columns.

    A page is a file, or a line when ``multiline`` is off. ``arrival`` orders the rows, see ``arrival_order``;
    those of one page by their place in it.
    """
    rows = spark.read.schema("value array<map<string,string>>").option("multiLine", multiline).json(path)
    rows = rows.select(arrival_order(delivery).alias("_o"), F.posexplode("value").alias("_pos", "properties"))
    arrival = F.struct("_o", F.col("_pos").alias("row")).alias("arrival")
    if select is not None:
        rows = rows.select(*[F.col("properties")[c].alias(c) for c in select], arrival)
    else:
        rows = rows.select("properties", arrival)
    return rows if where is None else rows.where(where)


def filter_periods(df: DataFrame, col: str, date_from: int | None = None, date_to: int | None = None) -> DataFrame:
    """Keep the years from..to of a period code; one end alone means that year only."""
    if date_from is None and date_to is None:
        return df
    year = F.substring(F.col(col), 1, 4).try_cast("int")
    low = date_from if date_from is not None else date_to
    high = date_to if date_to is not None else date_from
    return df.where(year.between(int(low), int(high)))


def filter_any_of(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    return df.where(F.col(col).isin(*values))


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a tile feed: url, position and the box in lon/lat (NULL when the entry has none)."""
    schema = (
        "link array<struct<_rel:string,_href:string>>, `georss:box` string, `id` string"
    )
    feed = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    alt = F.filter("link", lambda k: k["_rel"] == "alternate")
    c = F.transform(F.split(F.trim("georss:box"), r"\s+"), lambda v: v.try_cast("double"))
    ok = F.size(c) == 4
    # the feed writes latitude before longitude
    sides = [c[i].alias(n) for i, n in ((1, "xmin"), (0, "ymin"), (3, "xmax"), (2, "ymax"))]
    box = F.when(ok, F.struct(*sides))
    return feed.where(F.size(alt) > 0).select(
        alt[0]["_href"].alias("url"), box.alias("box"), (F.col("georss:box").isNotNull() & ~ok).alias("bad_box")
    ).where(~F.coalesce("bad_box", F.lit(False))).drop("bad_box")


def select_tiles(entries: DataFrame, bbox: tuple[float, float, float, float], max_tiles: int | None = None, order: str = "url") -> DataFrame:
    """Entries whose box meets the area; entries without a box are kept. With ``max_tiles`` the first ones by ``order``."""
    x0, y0, x1, y1 = (float(v) for v in bbox)
    b = F.col("box")
    meets = (b["xmin"] <= x1) & (b["xmax"] >= x0) & (b["ymin"] <= y1) & (b["ymax"] >= y0)
    kept = entries.where(b.isNull() | meets)
    return kept if max_tiles is None else kept.orderBy(order).limit(max_tiles)


def read_table(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Tabular snapshot; CSV needs a declared schema to be typed (no inference pass)."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path)


def read_cells(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", nodata: float | None = None) -> DataFrame:
    """Raster cells; the nodata value becomes NULL."""
    cells = read_table(spark, path, fmt, _CELL)
    return cells if nodata is None else null_nodata(cells, nodata)


def null_nodata(cells: DataFrame, nodata: float) -> DataFrame:
    return cells.withColumn("value", F.when(F.col("value") != nodata, F.col("value")))


def acquisition_date(tag: Column, acquired: Column, loaded: Column) -> Column:
    """Date of a raster: the image tag (2024:05:31 10:20:30), else the given date, else the load date."""
    from_tag = F.to_date(F.try_to_timestamp(tag, F.lit("yyyy:MM:dd HH:mm:ss")))
    given = acquired.cast("string").try_cast("date")
    return F.coalesce(from_tag, given, loaded.cast("date"))


def raster_metadata(cells: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Bounds, width, height, band and nodata counts of each raster, with its date when tags are given.

    ``tags`` has raster_id, datetime_tag, acquisition_date and load_date.
    """
    m = cells.groupBy("raster_id").agg(
        F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"),
        (F.max("col") - F.min("col") + 1).alias("width"), (F.max("row") - F.min("row") + 1).alias("height"),
        F.count_if(F.col("value").isNull()).alias("nodata_cells"), F.count("*").alias("cells"),
    )
    if tags is None:
        return m
    t = tags.select("raster_id", acquisition_date(F.col("datetime_tag"), F.col("acquisition_date"), F.col("load_date")).alias("date"))
    return m.join(t, "raster_id", "left")


def read_measurements(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, fmt, _MEASUREMENT)


def stream_measurements_source(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The same table as a stream of arriving files."""
    return spark.readStream.format(fmt).schema(_MEASUREMENT).load(path)


def housing_rows(odata: DataFrame) -> DataFrame:
    """Rows of the housing lifecycle table that count: dwellings, municipalities, fourth quarter."""
    return odata.where(
        (F.col("Gebruiksfunctie") == "A045364") & F.col("RegioS").startswith("GM") & F.col("Perioden").contains("KW04")
    )


def housing_updates(odata: DataFrame) -> DataFrame:
    """(code, year, supply, demand, error) of housing rows; rows without a valid period drop out."""
    code = S.gm_code("RegioS")
    return odata.select(
        code.alias("code"), S.period_year("Perioden").alias("year"),
        S.cast_to("EindstandVoorraad_22", "long").alias("supply"), S.cast_to("VergundeNieuwbouw_2", "long").alias("demand"),
        F.when(code.isNull(), F.concat(F.lit("Invalid GM code: "), F.coalesce(F.trim("RegioS"), F.lit("")))).alias("error"),
        *(["arrival"] if "arrival" in odata.columns else []),
    ).where(F.col("year").isNotNull())
