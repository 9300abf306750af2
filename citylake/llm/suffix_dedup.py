"""Removal of byte strings that occur twice, by a depth-limited radix sort of suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylake.llm.common import as_row, group_starts, of_row, released, stored, whole_groups

GRAM = 24  # bytes of the first digit
SLICE = 1 << 18  # window starts that are hashed at once
PART = 1 << 12  # runs with one first digit that a task compares at once

_rng = np.random.default_rng(20240229)
#: Byte values and multipliers of the two rolling hashes.
VALUES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
INVERSES = [pow(b, -1, 1 << 64) for b in BASES]


class _Rolling:
    """64-bit hashes of any substring of a byte array, from prefix sums of value * base^position."""

    powers: dict[tuple[int, int], np.ndarray] = {}

    def __init__(self, data: np.ndarray, which: int):
        self.which = which
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[which][data] * self._power(BASES[which], len(data)), out=self.sums[1:])
        self.back = self._power(INVERSES[which], len(data) + 1)

    @classmethod
    def _power(cls, base: int, n: int) -> np.ndarray:
        kept = cls.powers.get((base, 0))
        if kept is None or len(kept) < n:
            kept = np.full(max(n, 1 << 20), base, np.uint64)
            kept[0] = 1
            kept = cls.powers[base, 0] = np.multiply.accumulate(kept)
        return kept[:n]

    def __call__(self, starts, ends) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + np.asarray(ends - starts, np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) ^ (h >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


def _runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows that have their least gram in one place, for texts one after the other.

    The first digit of a window is the hash of the gram in it that is least, leftmost on ties, so two equal
    windows never lie in one run. Returns per run: first digit, text number, first start, last start + 1
    (in the text), and the digit of the run's whole string.
    """
    if len(data) < length:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    first, second = _Rolling(data, 0), _Rolling(data, 1)
    at = np.arange(len(data) - GRAM + 1)
    digit = first(at, at + GRAM)
    place = (1 << 21) - 1  # a slice is shorter than that, so the low bits can hold the place of a gram
    least = (_least(digit & ~np.uint64(place) | at.astype(np.uint64), length - GRAM + 1) & np.uint64(place)).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    inside = np.flatnonzero(np.arange(length, length + len(least)) <= bounds[1:][text])
    if not len(inside):
        return digit[:0], text[:0], at[:0], at[:0], digit[:0]
    new = np.ones(len(inside), bool)
    new[1:] = (least[inside[1:]] != least[inside[:-1]]) | (text[inside[1:]] != text[inside[:-1]])
    starts = inside[new]
    ends = np.append(inside[:-1][new[1:]], inside[-1]) + 1
    n = text[starts]
    return digit[least[starts]], n, starts - bounds[n], ends - bounds[n], second(starts, ends + length - 1)


def _slices(frames: Iterator[pd.DataFrame], length: int):
    """Texts as bytes, several short ones or a slice of a long one at a time: (rows, data, bounds, shift).
    Slices overlap by length - 1 bytes, so each window lies in just one."""
    rows, parts, size = [], [], 0
    for frame in frames:
        for row in frame.itertuples(index=False):
            raw = row.text.encode() if isinstance(row.text, str) else b""
            if len(raw) > SLICE:
                for a in range(0, max(1, len(raw) - length + 1), SLICE):
                    piece = np.frombuffer(raw[a : a + SLICE + length - 1], np.uint8)
                    yield [row], piece, np.array([0, len(piece)]), a
                continue
            if size + len(raw) > SLICE and rows:
                yield rows, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), 0
                rows, parts, size = [], [], 0
            rows.append(row)
            parts.append(raw)
            size += len(raw)
    if rows:
        yield rows, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), 0


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, h, s, e) of byte ranges, overlapping or not, that together are the bytes of each text which
    lie in a string of ``length`` bytes that also starts elsewhere. h is xxhash64 of the text.

    A most-significant-digit sort of all windows, cut at ``length`` bytes, in three passes. Digit 1 of a
    window is the least hash of its 24-byte grams, so that neighbours mostly share it and a pass moves one
    row for each run of neighbours, about one in 90 bytes. Digit 2 is the run's whole string: where two runs
    agree in both digits all their windows are repeated. Only runs that share digit 1 but not all of digit 2
    are opened, with one run of each class that they could equal; digit 3 is the whole window, compared in
    the task that has the runs of one first digit, or a part of them where there are many. After each
    pass, groups of one are dropped: nothing else holds their windows. What agrees in all digits is a
    repeated window. Digits are pairs of independent 64-bit hashes.

    Counting is combined before each shuffle, and rows meet counts, tables of their own, in joins whose
    large keys Spark can split, so a passage that most documents share does not fill a task.
    """
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumn("h", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digits(frames):
        for rows, data, bounds, _ in _slices(frames, length):
            values, counts = np.unique(_runs(data, bounds, length)[0], return_counts=True)
            yield pd.DataFrame({"g": _signed(values), "n": counts})

    def runs(frames):
        for rows, data, bounds, shift in _slices(frames, length):
            g, text, s, e, f = _runs(data, bounds, length)
            own = pd.DataFrame(rows).iloc[text].reset_index(drop=True)
            yield pd.DataFrame({"g": _signed(g), "f": _signed(f), "doc_id": own["doc_id"], "h": own["h"], "s": s + shift, "e": e + shift})

    shared = keyed.select("text").mapInPandas(released(digits), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g")
    shared = stored(shared, "digits")
    every = keyed.mapInPandas(released(runs), f"g long, f long, doc_id {kind}, h long, s long, e long")
    kept = stored(every.join(shared, "g"), "runs")

    classes = kept.groupBy("g", "f").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "h", "s", "e")).alias("one"))
    classes = stored(classes, "classes")
    alike = classes.where("n > 1").select("g", "f")
    whole = kept.join(alike, ["g", "f"]).select("doc_id", "h", "s", (F.col("e") + length - 1).alias("e"))
    open_ = classes.groupBy("g").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("k")).where("n = 1 and k > 1")
    open_ = stored(open_.select("g", "k"), "open")
    todo = classes.join(open_, "g").select("one.*", F.col("g"), (F.col("n") == 1).alias("ask"))
    todo = todo.groupBy("doc_id", "h").agg(F.collect_list(F.struct("g", "s", "e", "ask")).alias("runs"))
    opened = stored(_opened(keyed, todo, length, kind), "opened").join(open_, "g")
    opened = opened.withColumn("parts", F.ceil(F.col("k") / PART).cast("int"))
    opened = opened.withColumn("part", F.pmod(F.xxhash64("doc_id", "h", "s"), F.col("parts")).cast("int"))
    order = ["g", "part"]
    opened = opened.select(*order, "parts", "doc_id", "h", "s", "ask", "bytes").repartition(*order).sortWithinPartitions(*order)
    found = stored(_matched(opened, length, kind), "matched")
    across = found.where("g is not null")
    twice = across.groupBy("g", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "w")
    hits = across.where("ask").join(stored(twice, "twice"), ["g", "w"]).select("doc_id", "h", "s", "e")
    return whole.unionByName(found.where("g is null").select("doc_id", "h", "s", "e")).unionByName(hits)


def _opened(keyed: DataFrame, todo: DataFrame, length: int, kind: str) -> DataFrame:
    """The bytes of the runs to open; a run has at most length - GRAM + 1 windows. Repeated rows meet in the tasks
    of the join, where one of them is opened."""

    def run(frames):
        seen = set()
        for frame in frames:
            out = []
            for doc_id, h, text, *lists in frame.itertuples(index=False):
                same = None if pd.isna(doc_id) else doc_id, h
                if same in seen:
                    continue
                seen.add(same)
                raw = text.encode()
                out += [(g, doc_id, h, s, ask, raw[s : e + length - 1]) for g, s, e, ask in zip(*lists)]
            yield pd.DataFrame(out, columns=["g", "doc_id", "h", "s", "ask", "bytes"])

    key = [keyed["doc_id"].eqNullSafe(todo["doc_id"]), keyed["h"] == todo["h"]]
    lists = [F.col(f"runs.{k}").alias(name) for k, name in (("g", "gs"), ("s", "starts"), ("e", "ends"), ("ask", "asks"))]
    rows = keyed.join(todo, key).select(keyed["doc_id"], keyed["h"], "text", *lists)
    return rows.mapInPandas(released(run), f"g long, doc_id {kind}, h long, s long, ask boolean, bytes binary")


def _matched(opened: DataFrame, length: int, kind: str) -> DataFrame:
    """Digit 3 within the parts of a first digit: spans of repeated windows of the runs that ask, with g null.
    Where a first digit has several parts, also what the parts must be compared by: the windows that are
    single in a part (ask), and each of the others once."""

    def run(frames):
        for frame in _in_turn(whole_groups(frames, ["g", "part"])):
            sizes = frame["bytes"].map(len).to_numpy() - length + 1
            first = np.append(0, np.cumsum(sizes + length - 1))[:-1]
            row = np.repeat(np.arange(len(frame)), sizes)
            inside = np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(sizes))[:-1], sizes)
            at = first[row] + inside
            data = np.frombuffer(b"".join(frame["bytes"]), np.uint8)
            w = _Rolling(data, 1)(at, at + length)
            g = frame["g"].to_numpy(np.int64)
            own = mixed(w ^ mixed(g.view(np.uint64) + frame["part"].to_numpy(np.uint64))[row])
            _, one, which, count = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
            twice, ask = count[which] > 1, frame["ask"].to_numpy(bool)
            s = frame["s"].to_numpy(np.int64)[row] + inside
            on = np.flatnonzero(twice & ask[row])
            new = np.append(True, (np.diff(row[on]) != 0) | (np.diff(on) != 1))[: len(on)]
            start = on[new]
            end = np.append(on[:-1][new[1:]], on[-1:])
            yield _placed(frame, row[start], s[start], s[end] + length)
            split = frame["parts"].to_numpy()[row] > 1
            for some, asks in ((np.flatnonzero(split & ask[row] & ~twice), True), (one[split[one] & (twice[one] | ~ask[row[one]])], False)):
                if len(some):
                    yield _placed(frame, row[some], s[some], s[some] + length, g[row[some]], _signed(w[some]), asks)

    return opened.mapInPandas(released(run), f"doc_id {kind}, h long, s long, e long, g long, w long, ask boolean")


def _in_turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The groups of the frames again, about 2048 rows at a time, to hold the windows of few rows at once."""
    for frame in frames:
        begin = 0
        for end in group_starts(frame, ["g", "part"])[1:]:
            if end - begin >= 2048 or end == len(frame):
                yield frame.iloc[begin:end].reset_index(drop=True)
                begin = end


def _placed(frame, row, s, e, g=None, w=None, ask=None) -> pd.DataFrame:
    kinds = {"g": "Int64", "w": "Int64", "ask": "boolean"}
    own = frame[["doc_id", "h"]].iloc[row].reset_index(drop=True)
    return own.assign(s=s, e=e, g=g, w=w, ask=ask).astype(kinds)


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """Every row of ``docs`` with its text's kept bytes: all columns of docs, and n_bytes, n_removed, n_spans,
    kept (binary) and spans (start and end of each maximal removed run, in bytes).

    Texts are judged as UTF-8 bytes, each on the input as it is: a byte goes if some string of ``length``
    bytes around it starts anywhere else too, in the same text or another. Null is the empty text, and
    texts shorter than ``length`` keep everything. Rows that are repeated, with their ids or with others,
    are copies of each other and lose all. Null doc_ids are ids like any other. Columns of docs may have
    any names; those with a result's name are replaced. An empty table gives no rows.
    """
    spans = repeated_spans(docs, length).groupBy("doc_id", "h").agg(F.collect_set(F.struct("s", "e")).alias("cut"))  # copies repeat their spans
    left = docs.select(as_row(docs), F.xxhash64(F.col("text").cast("string")).alias("own"))
    rows = left.join(spans, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("h")), "left")
    out = ["n_bytes", "n_removed", "n_spans", "kept", "spans"]

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<s:long,e:long>>")
    def cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_cut(*row) for row in zip(text, starts, ends)], columns=out)

    cut = cut.asNondeterministic()  # so that a filter on its result does not run it a second time
    marked = rows.select("row", cut(F.col("row.text").cast("string"), "cut.s", "cut.e").alias("out"))
    return marked.select(*of_row(docs, out), "out.*")


def _cut(text: str | None, starts, ends) -> tuple:
    raw = text.encode() if isinstance(text, str) else b""
    if starts is None or not len(starts):
        return len(raw), 0, 0, raw, []
    order = np.argsort(starts, kind="stable")
    s, e = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    new = np.append(True, s[1:] > e[:-1])
    s, e = s[new], np.append(e[:-1][new[1:]], e[-1])
    kept = b"".join(raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)]))
    return len(raw), int((e - s).sum()), len(s), kept, [{"s": a, "e": b} for a, b in zip(s.tolist(), e.tolist())]
