"""Runs of words against brute force, on whole small tables, awkward rows and strings made to be hard."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from test_llm import SF, WORDS, awkward, none, odd, shipped, table  # noqa: F401

import __spark_entry__ as entry
from citylake.llm import periodic_runs


def runs_of(words, least=12):
    """(start, length, period) of all runs, by start and period: every lag's stretches of equal words."""
    codes = {w: k for k, w in enumerate(dict.fromkeys(words))}
    x, n, found = np.array([codes[w] for w in words]), len(words), {}
    for q in range(1, n // 2 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], x[q:] == x[:-q], [False]]).astype(int)))
        for s, e in zip(edges[::2].tolist(), (edges[1::2] + q).tolist()):
            if e - s >= 2 * q:
                found.setdefault((s, e), q)
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= least)


def left_of(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def with_period(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def digest(doc_id, text):
    words = with_period(doc_id, WORDS.findall(text or ""))
    runs = runs_of(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(left_of(words, runs)),
    )


def found(texts, short=32):
    flat = [w for t in texts for w in t]
    codes = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    which, start, length, period = periodic_runs.find_runs(np.array([codes[w] for w in flat], np.int64), np.array([len(t) for t in texts], np.int64), short)
    out = [[] for _ in texts]
    for k, *run in zip(which.tolist(), start.tolist(), length.tolist(), period.tolist()):
        out[k].append(tuple(run))
    return out


def hard(rng):
    """Strings with nested, overlapping, broken and meeting runs."""
    kind = rng.randrange(6)
    word = lambda k, size: "".join(rng.choice("abcdefgh"[:k]) for _ in range(size))
    if kind == 0:
        return word(rng.randrange(1, 4), rng.randrange(400))
    if kind == 1:
        return "".join(word(8, rng.randrange(60)) + word(2, rng.randrange(1, 90)) * rng.randrange(1, 5) for _ in range(3))
    if kind == 2:  # runs of one short period that meet out of step
        u = word(2, rng.randrange(1, 5))
        return "".join((u * 200)[rng.randrange(9) :][: rng.randrange(30, 180)] for _ in range(rng.randrange(2, 5)))
    if kind == 3:
        a, b = "a", "ab"
        for _ in range(12):
            a, b = b, b + a
        return b[rng.randrange(50) :]
    if kind == 4:
        t = word(1, rng.randrange(5, 70)) + "b"
        t = t * rng.randrange(1, 6) + word(2, rng.randrange(20))
        return (t + "c") * rng.randrange(1, 4)
    t = list((word(8, rng.randrange(2, 150)) * 9)[: rng.randrange(20, 500)])
    for _ in range(rng.randrange(3)):
        t[rng.randrange(len(t))] = "z"
    return "".join(t)


@pytest.mark.parametrize("short", [8, 16, 32])
def test_runs_of_hard_strings(short):
    rng = random.Random(short)
    for _ in range(40):
        texts = [hard(rng) for _ in range(rng.randrange(1, 6))] + [""]
        assert found(texts, short) == [runs_of(t) for t in texts]


def test_runs_of_a_long_text():
    rng = random.Random(5)
    some = [f"w{rng.randrange(50)}" for _ in range(20_000)]
    text = some[:9000] + some[1000:9000] + some[9000:] + ["x", "y"] * 3000 + ["x"] + ["x", "y"] * 2000
    runs = found([text])[0]
    assert {(1000, 16000, 8000), (28000, 6001, 2), (34001, 4000, 2)} <= set(runs)
    assert set(range(101, 4000, 2)) <= {q for _, _, q in runs}  # where the two of period 2 meet, out of step


def test_runs_of_the_query(spark, table):
    got = [tuple(r) for r in entry.queries()["op13_periodic_runs"](spark, SF).orderBy("doc_id").collect()]
    assert got == [digest(i, t) for i, t in zip(table.doc_id.tolist(), table.text)]
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_of_awkward_rows(spark, odd, none):
    rows = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(odd).collect()]
    want = []
    for doc_id, text, *_ in awkward():
        words = WORDS.findall(text or "")
        long = len(words) > 5000
        runs = [(0, len(words), 7919)] if long else runs_of(words)
        want.append((doc_id, len(words), runs, left_of(words, runs)))
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
    assert periodic_runs.periodic_runs(none).collect() == []


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(300)] + [(None, "a b"), (5, None), (7, ""), (8, " \n")]
    got = periodic_runs.planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (doc_id, text), r in zip(rows, got):
        assert WORDS.findall(r["text"] or "") == with_period(doc_id, WORDS.findall(text or ""))
