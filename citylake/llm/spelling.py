"""Spelling variants: words one edit apart, found by walking a trie that is a table of edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylake.llm.common import stored

FIRST = 4  # code points of the first level after an edit; each level after it is twice as long
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2^64."""
    both = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(n, np.uint64(b))
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


def _begin(level: int) -> int:
    """Code points that the levels before this one take."""
    return FIRST * ((1 << level) - 1)


class _Places:
    """The places of some words at which a walk can stand, from ``low`` of a word's length on, and hashes of
    the words' stretches. A node is a prefix together with the length of the words it leads to."""

    def __init__(self, words: list[str], backward: bool, low: Callable[[np.ndarray], np.ndarray], high: int):
        text = "".join(w[::-1] for w in words) if backward else "".join(words)
        self.codes = np.append(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), np.uint32(0)).astype(np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        up, self.down = _powers(1 << int(len(text) + 1).bit_length())
        mixed = (self.codes[:-1].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) | np.uint64(1)
        self.sums = np.append(np.uint64(0), np.cumsum(mixed * up[: len(text)], dtype=np.uint64))
        lows = np.minimum(np.maximum(low(lengths), 0), lengths + high)
        counts = lengths + high - lows
        self.which = np.repeat(np.arange(len(words)), counts)
        self.depth = np.arange(len(self.which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lows, counts)
        self.length = lengths[self.which]
        self.start = (np.cumsum(lengths) - lengths)[self.which]
        self.at = self.start + self.depth

    def stretch(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.down[at]

    def prefix(self, depth: np.ndarray) -> np.ndarray:
        return self.stretch(self.start, depth)

    def node(self, depth: np.ndarray, longer: int = 0) -> np.ndarray:
        """Nodes of words of the own length, or of longer ones."""
        return _mixed(self.prefix(depth) + (self.length + longer).astype(np.uint64))

    def skipped(self, longer: int = 0) -> np.ndarray:
        """Hash of the node at each place and of the first level behind one more code point of a word of the
        own length, or of a longer one that has it inserted there."""
        skip = 1 - longer
        size = np.minimum(FIRST, self.length - self.depth - skip)
        return _mixed(self.node(self.depth, longer) + self.stretch(self.at + skip, size) * np.uint64(BASE))

    def rest(self, skip: int) -> pa.Array:
        """For each place the hashes of the levels after the first, ``skip`` code points on; null without any."""
        left, values, held, level = self.length - self.depth - skip, [], [], 1
        while level == 1 or _begin(level) < left.max(initial=0):
            held.append(left > _begin(level))
            at = np.where(held[-1], self.at + skip + _begin(level), 0)
            values.append(self.stretch(at, np.where(held[-1], np.minimum(FIRST << level, left - _begin(level)), 0)))
            level += 1
        held, values = np.array(held).T, np.array(values).T
        offsets = pa.array(np.append(0, np.cumsum(held.sum(1))).astype(np.int32), mask=np.append(~held[:, 0], False))
        return pa.ListArray.from_arrays(offsets, _long(values[held]))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _mapped(words: DataFrame, schema: str, columns: Callable[[list[str], pa.Array], list], chars: int = 1 << 18) -> DataFrame:
    """Rows made from batches of words of about ``chars`` code points."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("word").to_pylist()
            cuts = np.flatnonzero(np.diff(np.cumsum([0, *map(len, texts)]) // chars)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
                if a < b:
                    yield pa.RecordBatch.from_arrays(columns(texts[a:b], batch.column("n").slice(a, b - a)), names=names)

    return words.select("word", "n").mapInArrow(run, schema)


def _merged(rows: DataFrame) -> DataFrame:
    """Rows to be met in a sort-merge join, at every size. Spark sizes them by the compressed bytes of the table
    they are made from, and takes ``mapInArrow`` to give a row for each word, not one for each of its places; by
    that it would broadcast many times its threshold, through the driver."""
    return rows.hint("merge")


def _starts(words: DataFrame, backward: bool) -> DataFrame:
    """Walks that are about to spend their edit, at each place of a word from its middle on: by a replaced code
    point, and by one inserted before the place. ``ch`` is the word's own there (-1 at its end)."""

    def columns(texts, n):
        parts = []
        for longer in (0, 1):
            p = _Places(texts, backward, lambda x: (x + backward) // 2, longer)
            which = pa.array(p.which)
            char = np.where(p.depth < p.length, p.codes[p.at], -1).astype(np.int32)
            own = [pa.array(texts, pa.string()).take(which), n.take(which), pa.array(char), pa.array(np.full(len(which), longer == 1))]
            parts.append([_long(p.skipped(longer)), *own, p.rest(1 - longer)])
        return [pa.concat_arrays(c) for c in zip(*parts)]

    return _mapped(words, "key long, word string, n long, ch int, inserted boolean, rest array<long>", columns)


def _branches(words: DataFrame, backward: bool) -> DataFrame:
    """Edges of any one code point and the first level behind it."""

    def columns(texts, n):
        p = _Places(texts, backward, lambda x: (x - 1) // 2, 0)
        size = 1 + np.minimum(FIRST, p.length - p.depth - 1)
        return [_long(p.skipped()), pa.array(p.codes[p.at].astype(np.int32)), _long(p.node(p.depth + size))]

    return _mapped(words, "key long, other int, node long", columns)


def _hops(words: DataFrame, backward: bool, level: int) -> DataFrame:
    """Edges of a later level: node, hash of the code points taken, and the node they lead to."""

    def columns(texts, n):
        p = _Places(texts, backward, lambda x: np.maximum((x - 1) // 2, 0) + 1 + _begin(level), 0)
        size = np.minimum(FIRST << level, p.length - p.depth)
        return [_long(p.node(p.depth)), _long(p.stretch(p.at, size)), _long(p.node(p.depth + size))]

    return _mapped(words, "node long, label long, child long", columns)


def _ends(words: DataFrame, backward: bool) -> DataFrame:
    """The node that each whole word is."""

    def columns(texts, n):
        p = _Places(texts, backward, lambda x: x, 1)
        return [_long(p.node(p.depth)), pa.array(texts, pa.string()), n]

    return _mapped(words, "node long, near string, near_n long", columns)


def _walked(words: DataFrame, backward: bool, levels: int) -> DataFrame:
    """Pairs (word, n, near, near_n) with an edit in the second half of the word (backward: in the first), each
    once: ``near`` has a larger code point at one place, or one code point more."""
    edges = stored(_branches(words, backward).distinct(), "edges")
    other = F.when(F.col("inserted"), F.col("other") != F.col("ch")).otherwise(F.col("other") > F.col("ch"))
    states = _starts(words, backward).join(_merged(edges), "key").where(other).select("word", "n", "node", "rest")
    for level in range(1, levels):
        edges = stored(_hops(words, backward, level).distinct(), "edges")
        live = F.coalesce(F.size("rest"), F.lit(0)) >= level  # others have arrived; their keys meet no edge and lie apart
        states = states.withColumn("label", F.when(live, F.get("rest", F.lit(level - 1))).otherwise(F.xxhash64("word", "node")))
        states = states.join(_merged(edges), ["node", "label"], "left").where(~live | F.col("child").isNotNull())
        states = states.select("word", "n", F.when(live, F.col("child")).otherwise(F.col("node")).alias("node"), "rest")
    pairs = states.drop("rest").join(_merged(_ends(words, backward)), "node").where(F.levenshtein("word", "near", 1) == 1)
    if backward:  # an insertion into equal code points around the middle is found forward
        half = F.expr("length(word) DIV 2")
        pairs = pairs.where(F.substring("word", F.lit(1), half) != F.substring("near", F.lit(1), half))
    return pairs.select("word", "n", "near", "near_n")


def near_words(words: DataFrame) -> DataFrame:
    """All ordered pairs of words that differ by one inserted, deleted or replaced code point: word, n, near, near_n.

    words: word and n, each word once, without nulls; other columns are left out.

    A state is a walk through the trie: a word, how far it is read, a node, and whether the edit is spent. States
    and edges meet in joins. Walks start at a word's own prefixes from its middle on, since before it words share
    too few nodes: with an edit in the first half the words are walked from their ends, in a trie of its own. The
    first join spends the edit on another code point (or one more) and takes the 4 that follow; each later one takes
    the next stretch of the word, 8 code points, then 16 and so on, so that the joins are few however long a word is.
    A walk that stands at the end of a word is a pair, compared exactly, so that no collision of hashes counts. A
    pair is walked once, from its shorter or lesser word. A state meets at most one edge for each code point; the
    edges are tables, so that Spark can split a node at which very many words stand.
    """
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    levels = 1
    while _begin(levels) < (longest + 1) // 2 + 1:
        levels += 1
    found = [stored(_walked(words, backward, levels), "near") for backward in (False, True)]
    pairs = found[0].unionByName(found[1])
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): follow (word, form) rows, at most one for a word and without circles, to the last. Each
    round doubles the steps taken."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("last"))
        now = stored(now.join(_merged(on), "root", "left").select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """Each word with its usual form: word, form, root, n, n_near and form_n.

    words: word and n (how often it occurs); other columns are left out. Rows of one word are added up, rows
    with a null are left out; an empty table gives no rows. n_near counts the words one edit away. The form is
    that with the largest n, on ties the smallest in code-point order, if its n is at least ``factor`` (over 1)
    times the word's own; root follows forms to the last. Words without a form are their own root.
    """
    known = words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    known = stored(known, "words")
    near = near_words(known).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    usual = -F.col("best").getField("col1") >= F.lit(factor) * F.col("n")
    near = near.select("word", "n_near", F.when(usual, F.col("best.near")).alias("form"), F.when(usual, -F.col("best").getField("col1")).alias("form_n"))
    near = stored(near, "forms")
    rows = known.join(_merged(near), "word", "left").join(_merged(roots(near.where("form is not null"))), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def misspelled_words(docs: DataFrame, least_length: int = 7, least: int = 2) -> DataFrame:
    """Word counts (word, n) of whole texts, with planted misspellings.

    Words are the longest runs of A-Z, a-z and U+00C0 to U+00FF, in lower case (A-Z only). Where the CRC-32 of
    ``<doc_id>:<word>`` is divisible by 31, the word's code point at that number modulo its length is left out.
    Words of fewer than ``least_length`` code points or ``least`` occurrences are left out. Null texts have no
    words; words of null ids stay as they are. Counts are added up before the shuffle.
    """
    lower = F.translate(F.col("run"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # a run is found whole, from its first letter on, if it is long enough
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0)))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", runs.alias("run"))
    rows = rows.select(lower.alias("run"), F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), lower).cast("binary")).alias("h"))
    cut: Column = F.expr("CAST(h % length(run) AS INT)")
    without = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))
    rows = rows.select(F.when(F.col("h") % 31 == 0, without).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
