"""Stretches of words that repeat with a period, found by minimizers on several scales."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylake.llm import tokens

SHORT = 32  # periods up to this one are found by direct scans of their lag
LEAST = 12  # words of a run
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _Text:
    """Word numbers of several texts, one after the other, with hashes of all their stretches.

    A number that occurs only once stands between texts, so no stretch that repeats spans two of them.
    Hashes are polynomials in 64 bits over random values of the words.
    """

    def __init__(self, words: np.ndarray):
        self.words, self.n = words, len(words)
        mixed = (words.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        base = np.full(self.n + 1, np.uint64(0xD6E8FEB86659FD93))
        base[0] = 1
        self.powers = np.multiply.accumulate(base)
        self.before = np.append(np.uint64(0), np.cumsum((mixed ^ (mixed >> np.uint64(32))) * self.powers[:-1], dtype=np.uint64))

    def alike(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Are the stretches at a < b equal?"""
        one, two = self.before[a + length] - self.before[a], self.before[b + length] - self.before[b]
        return one * self.powers[b - a] == two

    def grams(self, size: int) -> np.ndarray:
        """Hash of every stretch of ``size`` words, the same wherever it lies."""
        if self.n < size:
            return np.zeros(0, np.uint64)
        sums = self.before[size:] - self.before[:-size]
        sums = sums * self.powers[: len(sums)][::-1]
        return (sums ^ (sums >> np.uint64(31))) * MULTIPLIER

    def extend(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest stretch [start, end) with this period around each place where a word and that a period
        on are equal."""
        low, high = np.zeros(len(at), np.int64), self.n - period - at  # words that match from a place on
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.alike(at, at + period, middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        end = at + low + period
        low, high = np.zeros(len(at), np.int64), at.copy()  # and before it
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.alike(at - middle, at - middle + period, middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return at - low, end


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every window of ``width`` values."""
    pick, done = (np.minimum if least else np.maximum), 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def _smallest(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One run for each stretch, that with the smallest period: others have a multiple of it."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def _by_lag(words: np.ndarray, short: int, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of periods up to ``short`` with at least ``least`` words."""
    found = []
    for q in range(1, min(short, len(words) // 2) + 1):
        at = np.flatnonzero(words[q:] == words[:-q])
        if not len(at):
            continue
        heads = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
        sizes = np.diff(np.append(heads, len(at))) + q
        heads, sizes = heads[sizes >= max(least, 2 * q)], sizes[sizes >= max(least, 2 * q)]
        found.append((at[heads], at[heads] + sizes, np.full(len(heads), q)))
    return found


def _seeds(text: _Text, scale: int, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances in (scale, 2 * scale] of equal minimizers: stretches of scale / 4 words that have
    the least hash of a window of about scale words.

    Stretches inside a run of a period of at most half their size do not count. The others lie at least half
    their size apart where they are equal, so a minimizer meets a bounded number of equal ones.
    """
    size = scale // 4
    width = scale - size + 1
    hashes = text.grams(size)
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end, period = known
    inside = (period <= size // 2) & (end - start >= size)
    marks = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(marks, start[inside], 1)
    np.add.at(marks, end[inside] - size + 1, -1)
    most = np.iinfo(np.uint64).max
    hashes[np.cumsum(marks[:-1]) > 0] = most
    chosen = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), _sliding(hashes, width, True), np.zeros(width - 1, np.uint64)]), width, False)
    at = np.flatnonzero((chosen == hashes) & (hashes < most))
    at = at[np.argsort(hashes[at], kind="stable")]
    values, places, gaps = hashes[at], [], []
    for step in range(1, len(at)):
        near = (values[step:] == values[:-step]) & (at[step:] - at[:-step] <= 2 * scale)
        if not near.any():
            break
        gap = (at[step:] - at[:-step])[near]
        places.append(at[:-step][near][gap > scale])
        gaps.append(gap[gap > scale])
    return (np.concatenate(places), np.concatenate(gaps)) if places else (at[:0], at[:0])


def _joined(text: _Text, scale: int, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances in (scale, 2 * scale] by which a run falls into step with a second one of its
    period that it meets. Each gives a run of its own whose first period is periodic itself, so that it has
    no minimizer."""
    start, end, period = known
    short = (period <= scale // 8) & (end - start > scale)
    start, end, period = start[short], end[short], period[short]
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    places, gaps = [start[:0]], [start[:0]]
    for k in np.flatnonzero((period[1:] == period[:-1]) & (start[1:] <= end[:-1])).tolist():
        p, a, b = int(period[k]), int(start[k]), int(start[k + 1])
        shifts = a + np.arange(p)
        for at in shifts[text.alike(shifts, np.full(p, b), np.full(p, p))].tolist():
            first = scale + 1 + (b - at - scale - 1) % p
            last = min(2 * scale, int(end[k]) - a, int(end[k + 1]) - b)
            gaps.append(np.arange(first, last + 1, p))
            places.append(np.maximum(a, b - gaps[-1]))
    return np.concatenate(places), np.concatenate(gaps)


def _around(text: _Text, at: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs around seeds."""
    same = text.words[at] == text.words[at + gap]
    at, gap = at[same], gap[same]
    start, end = text.extend(at, gap)
    whole = end - start >= 2 * gap
    return _smallest(start[whole], end[whole], gap[whole])


def find_runs(words: np.ndarray, sizes: np.ndarray, short: int = SHORT, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """All runs of several texts: text, start in it, length and period, by text, start and period.

    words: word numbers (0 and up) of all texts together; sizes: the number of words of each text. A run is
    a longest stretch with smallest period q of at least 2 q and ``least`` words.

    Periods up to ``short`` come from scans of their lag. A run of a longer period q, scale < q <= 2 * scale,
    holds a whole window at the same place of its first two periods, so that their minimizers are q apart; or
    each of its first two periods lies in a run of one short period. Scales double, and only texts that are
    long enough meet the larger ones. Exact but for collisions of hashes of 64 bits.
    """
    n_texts, ends = len(sizes), np.cumsum(sizes)
    top = int(words.max(initial=0)) + 1
    own = np.insert(words, ends, top + np.arange(n_texts)) if n_texts else words
    begins = ends - sizes + np.arange(n_texts)
    found = _by_lag(own, short, min(least, max(2, short // 4)))
    runs = _smallest(*(np.concatenate(x) for x in zip(*found))) if found else (np.zeros(0, np.int64),) * 3
    text, scale = None, short
    chosen = np.arange(n_texts)
    while (sizes[chosen] > 2 * scale).any():
        if text is None or not (sizes[chosen] > 2 * scale).all():
            # the long texts alone, and their runs
            chosen = chosen[sizes[chosen] > 2 * scale]
            where = np.searchsorted(begins, runs[0], "right") - 1
            kept = np.isin(where, chosen)
            spans = np.cumsum(sizes[chosen] + 1)
            lead = np.append(0, spans)[:-1]
            place = np.arange(spans[-1]) + np.repeat(begins[chosen] - lead, sizes[chosen] + 1)
            text, shift = _Text(own[place]), begins[chosen] - lead
            slot = np.searchsorted(chosen, where[kept])
            local = tuple(x[kept] - (shift[slot] if k < 2 else 0) for k, x in enumerate(runs))
        at, gap = (np.concatenate(x) for x in zip(_seeds(text, scale, local), _joined(text, scale, local)))
        scale *= 2
        if not len(at):
            continue
        fresh = _around(text, at, gap)
        slot = np.searchsorted(lead, fresh[0], "right") - 1
        local = _smallest(*(np.concatenate(x) for x in zip(local, fresh)))
        fresh = (fresh[0] + shift[slot], fresh[1] + shift[slot], fresh[2])
        runs = _smallest(*(np.concatenate(x) for x in zip(runs, fresh)))
    start, end, period = runs
    good = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[good], end[good], period[good]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    which = np.searchsorted(begins, start, "right") - 1
    return which, start - begins[which], end - start, period


def repeated(sizes: np.ndarray, which: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """True for each word of the texts that some run holds after its first period."""
    begins = np.cumsum(sizes) - sizes
    marks = np.zeros(int(sizes.sum()) + 1, np.int64)
    np.add.at(marks, begins[which] + start + period, 1)
    np.add.at(marks, begins[which] + start + length, -1)
    return np.cumsum(marks[:-1]) > 0


def periodic_runs(docs: DataFrame, short: int = SHORT, least: int = LEAST) -> DataFrame:
    """The runs of every whole text, and the text without their repeats.

    docs: doc_id and text; other columns are left out. Words are what lies between ASCII blanks; a null or
    empty text has none. Repeated rows and null doc_ids are treated like any others; an empty table gives
    no rows.

    Returns doc_id, n_words, runs (array of start, length and period, in words, by start and period) and
    collapsed (the words that no run holds after its first period, joined by one space). One pass over the
    scan without a shuffle; a task treats about 200,000 words at a time, a longer text by itself, in time
    about n log n.
    """
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def run(frames):
        for doc_ids, texts in tokens.text_batches(frames, 1 << 20):
            words = [t.encode().split() for t in texts]
            sizes = np.array([len(w) for w in words], np.int64)
            flat = pa.array([w for ws in words for w in ws], pa.large_binary())
            which, start, length, period = find_runs(flat.dictionary_encode().indices.to_numpy().astype(np.int64), sizes, short, least)
            gone = repeated(sizes, which, start, length, period)
            cuts, ends = np.searchsorted(which, np.arange(len(texts) + 1)), np.cumsum(sizes)
            listed = list(zip(start.tolist(), length.tolist(), period.tolist()))
            rows = []
            for k, doc_id in enumerate(doc_ids):
                left = words[k]
                if cuts[k] < cuts[k + 1]:
                    left = [w for w, g in zip(left, gone[ends[k] - sizes[k] : ends[k]].tolist()) if not g]
                rows.append((doc_id, int(sizes[k]), listed[cuts[k] : cuts[k + 1]], b" ".join(left).decode()))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    fields = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {fields}"
    return docs.select("doc_id", F.col("text").cast("string")).mapInPandas(run, schema)


def longest() -> Column:
    """Of the column ``runs``: the longest, on ties that which starts first, then that of the smallest period."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r.alias("run"))))
    return best["run"]


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a period planted into a tenth of the texts, by a hash h of the id: if 10 divides h,
    each of the n words from number a = g % n on becomes word a + (i - a) % p, with g = h / 10 and
    p = 1 + (n - a) / (3 + g % 8), both rounded down. Texts of null ids stay."""
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    rows = docs.select("doc_id", F.col("text").cast("string"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    rows = rows.select("doc_id", "text", F.expr("h DIV 10").alias("g"), F.when(F.col("h") % 10 == 0, words).alias("w"))
    changed = """
        aggregate(array(named_struct('a', g % size(w), 'n', size(w))), '', (x, y) -> array_join(transform(w, (v, i) ->
            CASE WHEN i < y.a THEN v ELSE w[CAST(y.a + (i - y.a) % (1 + (y.n - y.a) DIV (3 + g % 8)) AS INT)] END), ' '))"""
    return rows.select("doc_id", F.when(F.size("w") > 0, F.expr(changed)).otherwise(F.col("text")).alias("text"))
