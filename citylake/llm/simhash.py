"""SimHash near-duplicates through an inverted index on byte positions."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylake.llm.common import components, forest, group_starts, in_block_pairs, stored, whole_groups

BYTES = 8


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """64 bits; bit k is 1 if it is set in over half of the hashes of the text's word shingles."""
    words = text.encode().lower().split()  # on bytes: A-Z alone, and the six white-space characters
    if not words:
        return 0
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        digest = xxhash.xxh64_intdigest
        starts = [0, *(e + 1 for e in ends)]
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :])]
    return _majority(np.array(hashes, np.uint64))


def _majority(hashes: np.ndarray) -> int:
    total, step = np.zeros(64, np.int64), 1 << 16
    for k in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[k : k + step].view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of every whole text; a null text has no words."""

    def run(frames):
        for frame in frames:
            values = [fingerprint(t, width, seed) if isinstance(t, str) else 0 for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": np.array(values, np.uint64).view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInPandas(run, f"doc_id {kind}, fp long")


def _indexed(max_bits: int) -> int:
    """Byte positions in the index. One of the eight can be left out while a match elsewhere stays certain."""
    return BYTES - 1 if max_bits < BYTES - 1 else BYTES


def _places(positions: int, matches: int) -> np.ndarray:
    return np.array(list(combinations(range(positions), matches)))


def postings(fps: DataFrame, positions: int, matches: int) -> DataFrame:
    """The index: for each fingerprint one entry (key, fp) for every choice of ``matches`` of the first
    ``positions`` bytes, with the bytes there. Fingerprints that share that many of them meet under at least one
    key. The fingerprints are dealt over all tasks first: they are few bytes, their entries are many."""
    places = _places(positions, matches)

    def run(frames):
        for frame in frames:
            for k in range(0, len(frame), 20_000):
                fp = frame["fp"].to_numpy(np.int64)[k : k + 20_000]
                parts = fp.view(np.uint8).reshape(-1, BYTES).astype(np.int64)[:, places]  # row, choice, position
                key = np.zeros(parts.shape[:2], np.int64)
                for m in range(matches):
                    key = key << 8 | parts[:, :, m]
                key |= np.arange(len(places)) << 8 * matches
                yield pd.DataFrame({"key": key.ravel(), "fp": np.repeat(fp, len(places))})

    return fps.select("fp").repartition("fp").mapInPandas(run, "key long, fp long")


def links(fps: DataFrame, max_bits: int = 4, block: int = 2048) -> DataFrame:
    """Links (a, b) that connect the same distinct fingerprints as all pairs within ``max_bits`` would.

    Two fingerprints of 8 bytes that differ in at most max_bits bits share at least 8 - max_bits bytes at
    their places, and of any 7 places at least one less. The index holds 7 places, so that it has half the
    entries. Under each of its keys the shared bytes of every pair, all 8, are tallied; pairs with the
    guaranteed count are verified by Hamming distance. A pair is taken up under one key only, the first of
    those that its shared bytes make. Keys with many fingerprints are tested by pairs of blocks. What
    leaves a task is a spanning forest of its links, not the links.
    """
    matches = BYTES - max_bits
    if not 1 <= matches < BYTES:
        raise ValueError("max_bits must be 1 to 7: fingerprints further apart need not share a byte")
    positions = _indexed(max_bits)
    chosen = positions - max_bits
    places = _places(positions, chosen)
    masks = (1 << places).sum(axis=1)
    canonical = np.array([next((k for k, m in enumerate(masks) if m & e == m), -1) for e in range(256)])
    bit = (1 << np.arange(BYTES)).astype(np.uint8)

    def near(a, b, key):
        """Of candidate pairs under a key: those that it has to report."""
        shared = ((a ^ b).view(np.uint8).reshape(-1, BYTES) == 0) @ bit
        first = canonical[shared] == key >> 8 * chosen
        return (np.bitwise_count(shared) >= matches) & first & (np.bitwise_count(a ^ b) <= max_bits)

    def run(frames):
        for frame in whole_groups(frames, ["key", "lo", "hi"]):
            cuts = group_starts(frame, ["key", "lo", "hi"])
            fp, key = np.ascontiguousarray(frame["fp"].to_numpy(np.int64)).view(np.uint64), frame["key"].to_numpy(np.int64)
            part, across = frame["part"].to_numpy(), (frame["lo"] != frame["hi"]).to_numpy()
            left = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(frame))  # rows of the group from here on
            found = [np.zeros((2, 0), np.int64)]

            def test(i, j):
                meant = ~across[i] | (part[i] != part[j])
                i, j = i[meant], j[meant]
                ok = near(fp[i], fp[j], key[i])
                found.append(np.stack([fp[i[ok]], fp[j[ok]]]).view(np.int64))
                if sum(x.shape[1] for x in found) > 1 << 19:
                    found[:] = [np.stack(forest(*np.concatenate(found, axis=1)))]

            near_end = left <= 64  # these rows with the later ones of their groups, for all groups at once
            for shift in range(1, 64):
                i = np.flatnonzero(near_end & (left > shift))
                if not len(i):
                    break
                test(i, i + shift)
            for i in np.flatnonzero(~near_end):  # and the earlier rows of larger groups
                j = np.arange(i + 1, i + left[i])
                test(np.full(len(j), i), j)
            a, b = forest(*np.concatenate(found, axis=1))
            yield pd.DataFrame({"a": a, "b": b})

    rows = in_block_pairs(postings(fps, positions, chosen), ["key"], "fp", block, "merge")
    return rows.select("key", "lo", "hi", "part", "fp").mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id of every document: the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits, its own included.

    docs: doc_id and text; other columns are left out. Words are runs without ASCII white space, A-Z in
    lower case. A null, empty or blank text has fingerprint 0 and links like any other. Equal texts are one
    fingerprint from the start, so a group of copies costs one row in the index, whatever its size. Null
    doc_ids are never the smallest; a group of null ids alone has a null component_id. Repeated rows are
    kept. An empty table gives no rows.
    """
    marked = stored(fingerprints(docs, width, seed), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, max_bits))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = named.select("fp", "root", "least")
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(named.join(best, "root").select("fp", "component_id"), "classes")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
