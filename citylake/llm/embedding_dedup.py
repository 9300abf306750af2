"""Embedding near-duplicates through a pivot-permutation index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylake.llm.common import components, forest, group_starts, in_block_pairs, stored, whole_groups

MOST_PIVOTS = 4096  # of one label; the documented bound of the sample that the index is fitted on
SLICE = 8192  # vectors that are described at once
SPACE = ["label", "width"]  # vectors are compared within these


def vectors(rows: DataFrame) -> DataFrame:
    """(label, width, key, vec, weight, least): each different usable vector of a label once, with how many rows have
    it and their smallest vec_id. Usable: label and vector not null, all components finite, not all zero.
    width is the length, vec is in doubles, key is the hash of (label, vec); copies are combined before they move."""
    vec = F.col("embedding").cast("array<double>")
    usable = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vec", lambda x: x != 0)
    good = rows.select("vec_id", "label", vec.alias("vec")).where(F.col("label").isNotNull() & F.col("vec").isNotNull() & usable)
    keyed = good.where(some).withColumns({"key": F.xxhash64("label", "vec"), "width": F.size("vec")})
    return keyed.groupBy(*SPACE, "key").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))


def pivots(distinct: DataFrame, least: float) -> DataFrame:
    """(label, width, pivot, pvec): the reference points, a sample of each label's different vectors: about four
    times the root of their number, at most MOST_PIVOTS, those whose keys hash lowest and that lie apart.

    No two are within twice the link angle, so the vectors around which others link are described by one pivot
    or a few, however many they are: in proportion to density, a large group of near copies would get hundreds,
    its members would choose different ones and not meet.
    """
    counts = distinct.groupBy(*SPACE).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("m", F.least(F.lit(MOST_PIVOTS), F.ceil(4 * F.sqrt("n"))).cast("long"))
    # about twice as many as wanted are drawn; only they are ranked, not a whole label
    share = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    near = distinct.join(counts, SPACE).where(share < (2.0 * F.col("m") + 32.0) / F.col("n"))
    most = 2 * least * least - 1 if least > 0 else -1.0  # cosine of twice the angle

    def run(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["share", "key"])
        unit, m, taken = _unit(np.stack(some["vec"].to_list())), int(some["m"].iloc[0]), []
        held = np.zeros((min(m, len(unit)), unit.shape[1]))
        for k, v in enumerate(unit):
            if len(taken) == len(held):
                break
            if not taken or (held[: len(taken)] @ v).max() < most:
                held[len(taken)] = v
                taken.append(k)
        out = some.iloc[taken]
        return out[SPACE].assign(pivot=np.arange(1, len(out) + 1, dtype=np.int32), pvec=out["vec"])

    kind = distinct.schema["label"].dataType.simpleString()
    drawn = near.select(*SPACE, "m", share.alias("share"), "key", "vec")
    return drawn.groupBy(*SPACE).applyInPandas(run, f"label {kind}, width int, pivot int, pvec array<double>")


def described(distinct: DataFrame, points: DataFrame, nearest: int) -> DataFrame:
    """Each vector with its ``nearest`` pivots, nearest first: label, width, key, vec, weight, near.

    A label's vectors are dealt out in slices of about SLICE, and its pivots, a bounded table, go to each.
    """
    kind = distinct.schema["label"].dataType.simpleString()
    counts = distinct.groupBy(*SPACE).agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    rows = distinct.join(counts, SPACE).withColumn("slice", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int"))
    rows = rows.select(*SPACE, "slice", "key", "vec", "weight")
    points = stored(points, "pivots").join(counts, SPACE).select(*SPACE, "pivot", "pvec", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))

    def run(some: pd.DataFrame, reference: pd.DataFrame) -> pd.DataFrame:
        if not len(some):
            return pd.DataFrame({c: [] for c in (*SPACE, "key", "vec", "weight", "near")})
        reference = reference.sort_values("pivot")
        target = _unit(np.stack(reference["pvec"].to_list()))
        own, m = _unit(np.stack(some["vec"].to_list())), min(nearest, len(target))
        near = []
        for k in range(0, len(own), 1024):
            close = own[k : k + 1024] @ target.T
            top = np.argpartition(-close, m - 1, axis=1)[:, :m]
            order = np.argsort(-np.take_along_axis(close, top, 1), axis=1, kind="stable")
            near += list((np.take_along_axis(top, order, 1) + 1).astype(np.int32))
        return some[[*SPACE, "key", "vec", "weight"]].assign(near=near)

    by = [*SPACE, "slice"]
    schema = f"label {kind}, width int, key long, vec array<double>, weight long, near array<int>"
    return rows.groupBy(*by).cogroup(points.groupBy(*by)).applyInPandas(run, schema)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def search(index: DataFrame, least: float, shared: int, block: int) -> DataFrame:
    """What the index finds, task by task: rows (kind 0, key, weight) with the rows that a vector links to, to
    be summed, and rows (kind 1, key, other) with links that connect the same vectors as all links do.

    Inverted lists: each vector is listed under each of its nearest pivots. In a list, the pivots that two
    vectors share are counted; pairs with ``shared`` or more are taken up in the list of the first pivot
    they share, and kept if their cosine is at least ``least``. Long lists are tested by pairs of blocks.
    """
    order = [*SPACE, "pivot", "lo", "hi"]

    def run(frames):
        for frame in whole_groups(frames, order):
            cuts = group_starts(frame, order)
            for s, e in zip(cuts[:-1], cuts[1:]):
                group = frame.iloc[s:e]
                yield from _group(group, least, shared)

    listed = index.select(*SPACE, "key", "vec", "weight", "near", F.explode("near").alias("pivot"))
    rows = in_block_pairs(listed, [*SPACE, "pivot"], "key", block)
    return rows.select(*order, "part", "key", "vec", "weight", "near").mapInPandas(run, "kind int, key long, other long, weight long")


def _group(group: pd.DataFrame, least: float, shared: int):
    """One list, or one pair of blocks of it."""
    key, weight, part = (group[c].to_numpy() for c in ("key", "weight", "part"))
    pivot, across = int(group["pivot"].iloc[0]), group["lo"].iloc[0] != group["hi"].iloc[0]
    unit = _unit(np.stack(group["vec"].to_list()))
    near = [np.asarray(n) for n in group["near"]]
    names = np.unique(np.concatenate(near))
    has = np.zeros((len(group), len(names)), np.float32)
    for k, n in enumerate(near):
        has[k, np.searchsorted(names, n)] = 1
    before = has[:, names < pivot]  # a pair that shares an earlier pivot is that list's
    wanted = min(shared, min(map(len, near)))
    total, ends = np.zeros(len(group), np.int64), []
    for a in range(0, len(group), 256):
        rows = np.arange(a, min(a + 256, len(group)))
        ok = (has[rows] @ has.T >= wanted) & (before[rows] @ before.T == 0)
        ok &= unit[rows] @ unit.T >= least
        ok[np.arange(len(rows)), rows] = False
        if across:
            ok &= part[rows][:, None] != part[None, :]
        total[rows] += ok @ weight
        i, j = np.nonzero(ok)
        ends.append(np.stack(forest(key[rows[i]], key[j])))
    x, y = forest(*np.concatenate(ends, axis=1))
    hit = total > 0
    yield pd.DataFrame({"kind": 0, "key": key[hit], "other": 0, "weight": total[hit]})
    yield pd.DataFrame({"kind": 1, "key": x, "other": y, "weight": 0})


def near_duplicates(
    rows: DataFrame, least: float = 0.93, nearest: int = 10, shared: int = 2, block: int = 2048
) -> DataFrame:
    """vec_id, label, n_links, component_id and kept of every row.

    rows: vec_id, embedding (array of numbers) and label; other columns are left out. Two vectors link if
    their labels are equal and not null and their cosine, in doubles, is at least ``least``. Vectors that
    are null or zero or hold null or non-finite components link with nothing; so do vectors of different
    lengths with each other. n_links: other rows linked directly, copies included. component_id: smallest
    vec_id over links, its own included; kept: the row is that one. Null vec_ids are never the smallest.
    Repeated rows link as copies. An empty table gives no rows.

    Every link that is reported is exact; a link is found if the two share ``shared`` of their ``nearest``
    pivots (recall is measured in the tests and the README). Copies are one vector in the index. The number
    of pivots grows with the root of a label's vectors, so lists and descriptions grow alike; a large group of
    near copies has long lists, which are tested by pairs of blocks.
    """
    distinct = stored(vectors(rows), "vectors")
    index = stored(described(distinct, pivots(distinct, least), nearest), "index")
    found = stored(search(index, least, shared, block), "found")
    roots = components(found.where("kind = 1").select("key", "other"))
    sums = found.where("kind = 0").groupBy("key").agg(F.sum("weight").alias("to_others"))
    named = distinct.select("key", "weight", "least").join(roots, F.col("key") == F.col("node"), "left").join(sums, "key", "left")
    named = named.select("key", "least", F.coalesce("root", "key").alias("root"), (F.coalesce("to_others", F.lit(0)) + F.col("weight") - 1).alias("n"))
    best = named.groupBy("root").agg(F.min("least").alias("component"))
    named = stored(named.join(best, "root").select("key", "n", "component"), "classes")
    vec = F.col("embedding").cast("array<double>")
    own = rows.select("vec_id", "label", F.xxhash64("label", vec).alias("_key"))
    usable = named.withColumnRenamed("key", "_of")
    marked = own.join(usable, F.col("_key") == F.col("_of"), "left")
    component = F.coalesce("component", "vec_id")
    return marked.select(
        "vec_id", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
