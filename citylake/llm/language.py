"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citylake.llm.common import as_row, of_row, released

UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
BITS = 21  # of a code point; three fit into a long


def grams(text: str, orders: Sequence[int] = (1, 2, 3)) -> np.ndarray:
    """n-grams of a text's lower-case words, each word between blanks, as longs. Empty if it has no letter."""
    words = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, words)):
        return np.zeros(0, np.int64)
    codes = np.frombuffer(f" {words} ".encode("utf-32-le"), "<u4").astype(np.int64) + 1
    out = []
    for n in orders:
        key = codes[: len(codes) - n + 1].copy()
        for k in range(1, n):
            key = key << BITS | codes[k : len(codes) - n + 1 + k]
        out.append(key[codes[: len(key)] != 33] if n == 1 else key)  # a blank alone says nothing
    return np.concatenate(out)


def ranked(keys: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent keys, most frequent first; ties by key."""
    values, counts = np.unique(keys, return_counts=True)
    if len(values) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.lexsort((values, -counts))][:size]


def profiles(docs: DataFrame, label: str = "lang", size: int = 400, orders: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """(lang, gram, rank): the ``size`` most frequent n-grams of all texts of each label, from 0; ties by gram.

    docs: text and the label; rows where either is null, and texts without a letter, teach nothing. All of
    each text counts. Counts are summed in each task first, so what moves is bounded by the different
    n-grams of a task, however many rows one label or source has.
    """

    def count(frames):
        held: dict[str, list[np.ndarray]] = {}
        waiting = 0

        def out():
            for lang, parts in held.items():
                values, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": values, "n": counts})

        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"]):
                keys = grams(text, orders)
                held.setdefault(lang, []).append(keys)
                waiting += len(keys)
                if waiting > 1_000_000:
                    yield from out()
                    held, waiting = {}, 0
        yield from out()

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("lang")).dropna()
    counts = rows.mapInPandas(released(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # a limit on the row number itself is applied before the shuffle, so no task sorts all n-grams of a language
    first = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    return first.select("lang", "gram", (F.col("place") - 1).alias("rank"))


class Ranker:
    """Distances of a text's profile to those of the languages."""

    def __init__(self, rows: Sequence[tuple[str, int, int]], size: int):
        self.size, self.langs = size, sorted({r[0] for r in rows})
        self.keys = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)  # the last row: not in any profile
        at = {lang: k for k, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.keys, gram), at[lang]] = rank

    def predict(self, keys: np.ndarray) -> tuple[str, float]:
        """The language with the least out-of-place distance and how near it is, 0 to 1; ties by name. An
        n-gram that a profile lacks is out of place by the profile's size."""
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(keys, self.size)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        at[self.keys[at] != own] = len(self.keys)
        theirs = self.ranks[at]
        away = np.where(theirs < 0, self.size, np.minimum(self.size, np.abs(theirs - np.arange(len(own))[:, None])))
        total = away.sum(axis=0)
        best = int(np.argmin(total))
        return self.langs[best], float(1 - total[best] / (self.size * len(own)))


def predict(docs: DataFrame, learned: DataFrame, size: int = 400, orders: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """All columns of docs, and lang_pred (string) and score (double, 0 to 1), by text alone.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing was
    learned. Columns of docs with those two names are replaced. Repeated rows and null ids are kept; an
    empty table gives no rows. ``learned`` comes from ``profiles`` and has ``size`` rows for each language
    at most: only those are sent to the tasks.
    """
    rows = [(r["lang"], r["gram"], r["rank"]) for r in learned.collect()]
    kept = docs.sparkSession.sparkContext.broadcast((rows, size))
    made: list[Ranker] = []

    @F.pandas_udf("lang_pred string, score double")
    def judge(text: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Ranker(*kept.value))
        out = [made[0].predict(grams(t, orders)) if isinstance(t, str) else (UNKNOWN, 0.0) for t in text]
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    judge = judge.asNondeterministic()  # so that a filter on its result does not run it a second time
    marked = docs.select(as_row(docs), judge(F.col("text").cast("string")).alias("out"))
    return marked.select(*of_row(docs, ["lang_pred", "score"]), "out.*")


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls into the fold that nothing is learned from; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))
