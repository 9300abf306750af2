"""Quality rules: text statistics, and a log-likelihood ratio of hashed n-grams between target and corpus."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylake.llm.common import as_row, of_row

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
BUCKETS = 1 << 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def hashed(text: str, orders: Sequence[int] = (3, 4)) -> np.ndarray:
    """Buckets of a text's byte n-grams, all of them, A-Z as they are."""
    data = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
    out = []
    for n in orders:
        if len(data) < n:
            continue
        key = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            key = key << np.uint64(8) | data[k : len(data) - n + 1 + k]
        out.append((key * MULTIPLIER) >> np.uint64(48))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text.

    Words are runs without ASCII white space; word_chars counts code points in them. A line with a word
    that equals an earlier line of the text is a duplicate. n_repeat_words counts words that lie in a
    window of three words which the text has twice or more.
    """
    raw = text.encode()
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, repeats = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line.strip(BLANKS):
            seen.add(line)
    again = 0
    if len(words) > 3:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        _, which, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        start = count[which] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(start)] |= start
        again = int(covered.sum())
    return len(words), len(text) - blanks, symbols, repeats, again


def bucket_counts(texts: DataFrame, orders: Sequence[int] = (3, 4)) -> DataFrame:
    """(bucket, n) over all n-grams of all texts. Each task sends one count a bucket."""

    def count(frames):
        total = np.zeros(BUCKETS, np.int64)
        for frame in frames:
            for text in frame["text"]:
                if isinstance(text, str):
                    total += np.bincount(hashed(text, orders), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInPandas(count, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def _filled(counts: DataFrame) -> np.ndarray:
    """At most one row a bucket: a bounded table."""
    out = np.zeros(BUCKETS)
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def ratio(target: DataFrame, corpus: DataFrame, orders: Sequence[int] = (3, 4)) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | corpus) of each bucket, both with one added to every count."""
    t, c = _filled(bucket_counts(target, orders)) + 1, _filled(bucket_counts(corpus, orders)) + 1
    return np.log(t / t.sum()) - np.log(c / c.sum())


def trusted(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """The target: documents labelled quality 1 and not toxic, at most ``most`` of them, those whose ids hash
    lowest. The bound is of the labelled ids, so that they can be sent to all tasks; whole texts count."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    good = good.orderBy(F.xxhash64("_id"), "_id").limit(most)
    return docs.join(F.broadcast(good), F.col("doc_id") == F.col("_id"), "left_semi")


def judge(
    docs: DataFrame, weights: np.ndarray, threshold: float = -0.25, least_words: int = 50, most_repeated: int = 50, orders: Sequence[int] = (3, 4)
) -> DataFrame:
    """All columns of docs, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    llr (double) and kept.

    base_failed: fewer than ``least_words`` words, or over ``most_repeated`` percent of them in repeated
    windows. llr is the mean weight of the text's n-grams, 0 if it has none. kept: not base_failed and llr
    at or above ``threshold``, for every text alike. A null text has no words. Columns of docs with those
    names are replaced. Repeated rows and null ids are kept; an empty table gives no rows.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    table = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf(", ".join(f"{n} long" for n in names) + ", llr double")
    def measure(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            t = t if isinstance(t, str) else ""
            at = hashed(t, orders)
            out.append((*statistics(t), float(table.value[at].mean()) if len(at) else 0.0))
        return pd.DataFrame(out, columns=[*names, "llr"])

    measure = measure.asNondeterministic()  # so that a filter on its result does not run it a second time
    marked = docs.select(as_row(docs), measure(F.col("text").cast("string")).alias("out"))
    marked = marked.select(*of_row(docs, [*names, "llr", "base_failed", "kept"]), "out.*")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    marked = marked.withColumn("base_failed", failed)
    return marked.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
