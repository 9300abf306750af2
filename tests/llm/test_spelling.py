"""Spelling variants against brute force, on whole small tables, awkward rows and words made to be hard."""

import random
import re
import zlib
from collections import Counter

import pytest
from test_llm import SF, awkward, none, odd, shipped, table  # noqa: F401

import __spark_entry__ as entry
from citylake.llm import spelling

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = re.compile("[A-Z]+")


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUNS.findall(text or ""):
            w = UPPER.sub(lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{w}".encode()) if doc_id is not None else 1
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def grouped(n, factor=10):
    """Two words are one edit apart if they are equal but for one place, or one with a place left out is the other."""
    places = {}
    for w in n:
        for k in range(len(w)):
            places.setdefault(w[:k] + "\0" + w[k + 1 :], []).append(w)
    near = {w: set() for w in n}
    for same in places.values():
        for a in same:
            near[a].update(b for b in same if b != a)
    for w in n:
        for k in range(len(w)):
            less = w[:k] + w[k + 1 :]
            if less in n:
                near[w].add(less)
                near[less].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def listed(rows):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rows.collect())


def test_variants_of_the_query(spark, table):
    assert listed(entry.queries()["op12_spelling"](spark, SF)) == grouped(counted(zip(table.doc_id, table.text)))


def test_variants_of_awkward_rows(spark, odd, none):
    assert listed(spelling.variants(spelling.misspelled_words(odd))) == grouped(counted((r[0], r[1]) for r in awkward()))
    assert listed(spelling.variants(spelling.misspelled_words(none))) == []


@pytest.mark.parametrize("letters", ["ab", "abcdé\U0001f600"])
def test_variants_of_dense_words(spark, letters):
    """Words of all lengths from none up, among few letters, so that most have near words; chains of forms."""
    rng = random.Random(len(letters))
    n = {"": 3, letters[0]: 40}
    for _ in range(1500):
        n["".join(rng.choice(letters) for _ in range(rng.randrange(14)))] = 10 ** rng.randrange(6) + rng.randrange(3)
    for _ in range(20):
        w = [rng.choice(letters) for _ in range(rng.choice([20, 33, 70]))]
        n["".join(w)] = 100_000
        for _ in range(6):
            k = rng.randrange(len(w))
            n["".join(w[:k] + rng.choice([[], [rng.choice(letters)], [w[k], rng.choice(letters)]]) + w[k + 1 :])] = rng.randrange(1, 20_000)
    rows = [(w, c, "x") for w, c in n.items()] + [(None, 5, "x"), ("null", None, "x")]
    words = spark.createDataFrame(rows, "word string, n long, near string").repartition(3)
    assert listed(spelling.variants(words)) == grouped(n)


def test_variants_of_long_words(spark):
    """Words of thousands of code points, among them a third of all that begin alike."""
    rng = random.Random(4)
    long = "".join(rng.choice("abc") for _ in range(5000))
    n = {long: 1000, long[:77] + long[78:]: 5, long[:4000] + "z" + long[4000:]: 7, long + "y": 1, "q" + long: 2, "a" * 3000: 50, "a" * 3001: 5, "a" * 3002: 600}
    n |= {f"samebeginning{k}": k + 1 for k in range(3000)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert listed(spelling.variants(words)) == grouped(n)


def test_repeated_words_are_added_up(spark):
    words = spark.createDataFrame([("pattern", 40), ("pattern", 60), ("patern", 10), ("patterns", 11)], "word string, n long")
    assert listed(spelling.variants(words)) == grouped({"pattern": 100, "patern": 10, "patterns": 11})


def test_no_join_broadcasts(spark, monkeypatch):
    """Spark would size walks and ends by their words' compressed bytes, and send many times that through the driver."""
    plans, stored = [], spelling.stored

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(spelling, "stored", lambda df, name: stored(planned(df), name))
    long = "ab" * 20
    n = {"pattern": 100, "patern": 10, "paten": 1, "patterns": 1, long: 500, long + "a": 5, long[:9] + long[10:]: 7}
    rows = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert listed(rows) == grouped(n)
    planned(rows)
    assert set(re.findall(r"\w+Join\b", "\n".join(plans))) == {"SortMergeJoin"}
