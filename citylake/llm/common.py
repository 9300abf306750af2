"""What the operators of this subpackage share: tables in the shared folder, sorted runs, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that all nodes see, as the session names it. Only a local session may go without."""
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        found = tempfile.mkdtemp(prefix="citylake-llm-")
        spark.conf.set(key, found)
    return found


@functools.lru_cache(maxsize=8)
def _shipped(application: str, spark: SparkSession) -> None:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/citylake_code", "zip", root, "citylake"))


def ship(spark: SparkSession) -> None:
    """Send this package to the tasks of a session, once; workers need not have it installed. Texts are long
    rows, so a session that has not chosen the size of its batches for Python gets smaller ones."""
    _shipped(spark.sparkContext.applicationId, spark)
    key, usual = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key, None) == usual:
        spark.conf.set(key, "4194304b")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to a new table in the shared folder and read them back: a cut in the lineage that
    outlives any executor. The driver then collects its garbage, upon which Spark deletes the shuffle
    files of steps that are over."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def as_row(docs: DataFrame) -> Column:
    """All columns of a table as one struct, so that none of their names can meet one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def of_row(docs: DataFrame, without: Sequence[str] = ()) -> list[Column]:
    """The columns of ``as_row`` again, but for those named in ``without``."""
    return [F.col("row").getField(c).alias(c) for c in docs.columns if c not in without]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInPandas that gives its memory back at the end of each task. Python workers outlive
    their tasks, and what their allocators keep would stand beside the memory of the stages after them."""

    def whole(frames: Iterator) -> Iterator:
        try:
            yield from run(frames)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole


def whole_groups(frames: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Regroup the frames of a sorted partition so that no group of equal keys is cut."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        same = np.ones(len(frame), bool)
        for k in keys:
            values = frame[k].to_numpy()
            same &= values == values[-1]
        cut = len(frame) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut or (rest and not all(rest[-1][k].iloc[-1] == frame[k].iloc[0] for k in keys)):
            yield pd.concat([*rest, frame.iloc[:cut]], ignore_index=True)
            rest = []
        rest.append(frame.iloc[cut:])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def group_starts(frame: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """First positions of the groups of a sorted frame, and its length at the end."""
    new = np.zeros(len(frame), bool)
    new[:1] = True
    for k in keys:
        values = frame[k].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), len(frame))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars: each linked value with the smallest value that it reaches, itself left out."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], least)
        np.minimum.at(new, root[right], least)
        new = new[new]
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    away = root != np.arange(len(nodes))
    return nodes[away], nodes[root[away]]


def in_block_pairs(df: DataFrame, keys: Sequence[str], item: str, block: int, join: str | None = None) -> DataFrame:
    """Rows of keys that hold two or more items, for tests inside each key by blocks of about ``block`` rows.

    A key with n items is cut into n / block parts by the item's hash. Each row gets its ``part`` and is
    listed for every pair (lo, hi) of parts that it belongs to, so any two items of a key meet in just one
    group (key, lo, hi): that of their own parts. A group has about 2 * block rows, whatever n is. The
    counts are a table of their own, so that Spark can split a hot key where rows meet them. ``join`` names a
    join strategy, where the rows are made anew by a broadcast join's repeated scan, say.
    """
    counts = stored(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "counts")
    parts = F.ceil(F.col("_n") / block).cast("int")
    rows = (df if join is None else df.hint(join)).join(counts, list(keys)).withColumn("_parts", parts).drop("_n")
    rows = rows.withColumn("part", F.pmod(F.xxhash64(item), F.col("_parts")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    rows = rows.withColumns({"lo": F.least("part", "_o"), "hi": F.greatest("part", "_o")}).drop("_o", "_parts")
    order = [*keys, "lo", "hi"]
    return rows.repartition(*order).sortWithinPartitions(*order)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that is linked to a smaller one; root is the smallest it reaches.

    ``links`` has two columns of one sortable type. Large-star and small-star rounds: every node passes
    its least neighbour to the others, until nothing changes. Each step is a minimum by node (combined
    before the shuffle) and a join, so a node with very many links is never held in one place; each round
    is a table in the shared folder. Null ends are dropped.
    """
    a, b = links.columns
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now, seen = stored(now, "links"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
