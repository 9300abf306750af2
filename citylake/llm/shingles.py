"""Near-duplicates by Jaccard similarity of word shingles: SimHash and a MinHash index find them, whole texts decide."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylake.llm import simhash
from citylake.llm.common import components, forest, group_starts, in_block_pairs, released, stored, whole_groups

BANDS, ROWS = 20, 5  # two texts of similarity s share a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8
SEEDS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def text_key(text: str = "text") -> Column:
    """A hash of a text's words; words are runs without ASCII white space, A-Z in lower case. Null has none."""
    low = F.translate(F.col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.xxhash64(F.coalesce(F.trim(F.regexp_replace(low, "[ \\t\\n\\x0b\\f\\r]+", " ")), F.lit("")))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Hashes of the different runs of ``width`` words, sorted; of all words if there are fewer."""
    found = (text if isinstance(text, str) else "").encode().lower().split()
    line, at, ends = b" ".join(found), -1, []
    for w in found:
        at += 1 + len(w)
        ends.append(at)
    digest = xxhash.xxh64_intdigest
    if len(found) <= width:
        return np.array([digest(line, 42)], np.uint64)
    starts = [0, *(e + 1 for e in ends)]
    return np.unique(np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :])], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A text's keys in the index: one for every ROWS least values under as many orders of all hashes."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(hashes), 1024):
        x = (hashes[k : k + 1024, None] ^ SEEDS[0]) * (SEEDS[1] | np.uint64(1))
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * MIX).min(axis=0))
    least = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ least[:, k]) * MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _similar(sets: list[np.ndarray], least: float):
    """Pairs (i, j), i < j, of sets whose Jaccard similarity is at least ``least``, by i."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    held, first = owner[order], np.searchsorted(code[order], np.arange(code.max() + 2))
    at = np.append(0, np.cumsum(size))
    for i in range(len(sets)):
        own = code[at[i] : at[i + 1]]
        n = first[own + 1] - first[own]
        shared = np.bincount(held[np.repeat(first[own] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())], minlength=len(sets))
        ok = shared >= least * (size + size[i] - shared) - 1e-9
        ok[: i + 1] = False
        yield i, np.flatnonzero(ok)


def near_prints(marked: DataFrame, max_bits: int) -> DataFrame:
    """Links (key, first) between texts, given as (key, fp), whose SimHash fingerprints differ in at most
    ``max_bits`` bits: texts of one fingerprint with the smallest of them, and these with each other."""
    prints = stored(marked.groupBy("fp").agg(F.min("key").alias("first")), "prints")
    same = marked.join(prints, "fp").where("key > first").select("key", "first")
    one = prints.select(F.col("fp").alias("a"), F.col("first").alias("key"))
    other = prints.select(F.col("fp").alias("b"), "first")
    return same.unionByName(simhash.links(prints, max_bits).join(one, "a").join(other, "b").select("key", "first"))


def components_of(docs: DataFrame, width: int = 5, least: float = 0.8, block: int = 512, max_bits: int = 4) -> DataFrame:
    """(node, root): the ``text_key`` of every text that is linked to one with a smaller key, and the smallest
    key it reaches. Texts link if the Jaccard similarity of their word shingles is at least ``least``.

    Equal word lists are one text. Texts whose SimHash fingerprints, of the same shingles, differ in at most
    ``max_bits`` bits and texts that share a band are connected, unproven; inside each connected set
    all pairs are tested exactly on the whole texts, in pairs of blocks. So no false link is possible, and a
    link is missed only if no chain of near fingerprints and shared bands joins the two. What leaves a task is a
    spanning forest.
    """
    texts = docs.select(text_key().alias("key"), F.col("text").cast("string").alias("text"))

    def index(frames):
        for frame in frames:
            prints = np.array([simhash.fingerprint(t if isinstance(t, str) else "", width) for t in frame["text"]], np.uint64)
            found = [bands(shingles(t, width)) for t in frame["text"]]
            yield pd.DataFrame({"key": frame["key"], "fp": prints.view(np.int64), "bands": found})

    listed = stored(texts.mapInPandas(released(index), "key long, fp long, bands array<long>").dropDuplicates(["key"]), "bands")
    posted = listed.select("key", F.explode("bands").alias("band"))
    shared = posted.groupBy("band").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    banded = posted.join(shared, "band").where("key > first").select("key", "first")
    roots = components(banded.unionByName(near_prints(listed.select("key", "fp"), max_bits)))
    members = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "members")
    # the same plan at every size: the members of large inputs outgrow a broadcast
    own = stored(texts.hint("merge").join(members, F.col("key") == F.col("node")).select("key", "text", "root").dropDuplicates(["key"]), "candidates")
    by = ["root", "lo", "hi"]

    def test(frames):
        for frame in whole_groups(frames, by):
            cuts = group_starts(frame, by)
            for s, e in zip(cuts[:-1], cuts[1:]):
                key, part = frame["key"].to_numpy()[s:e], frame["part"].to_numpy()[s:e]
                across, found = frame["lo"].iloc[s] != frame["hi"].iloc[s], [np.zeros((2, 0), np.int64)]
                for i, j in _similar([shingles(t, width) for t in frame["text"].iloc[s:e]], least):
                    j = j[part[j] != part[i]] if across else j
                    found.append(np.stack([np.full(len(j), key[i]), key[j]]))
                a, b = forest(*np.concatenate(found, axis=1))
                yield pd.DataFrame({"a": a, "b": b})

    rows = in_block_pairs(own, ["root"], "key", block).select(*by, "part", "key", "text")
    return components(rows.mapInPandas(released(test), "a long, b long"))
