"""Brown class-based bigram language model: every word seen in training has a class."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylake.llm.common import group_starts, released, stored, whole_groups
from citylake.llm.tokens import text_batches

END = b""  # no word is empty, so the end token has this name
SEED = 42  # of the XXH64 keys, that of Spark's xxhash64


def words(text: str) -> list[bytes]:
    """A text's tokens: runs without ASCII white space, A-Z in lower case, and then the end."""
    tokens = text.encode().lower().split()
    tokens.append(END)
    return tokens


def _coded(texts: list[str], piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Tokens of the texts as numbers, the number of tokens of each text, and the words by number. About ``piece``
    characters at a time, so that few tokens are objects of their own."""
    numbers: dict[bytes, int] = {}
    sizes, parts, held, size = [], [], [], 0

    def add():
        coded = pa.array(held, pa.large_binary()).dictionary_encode()
        own = [numbers.setdefault(w, len(numbers)) for w in coded.dictionary.to_pylist()]
        parts.append(np.array(own, np.int32)[coded.indices.to_numpy()])

    for text in texts:
        own = words(text)
        held += own
        sizes.append(len(own))
        size += len(text)
        if size >= piece:
            add()
            held, size = [], 0
    if held:
        add()
    return np.concatenate(parts), np.array(sizes, np.int64), list(numbers)


def _deflated(codes: np.ndarray) -> bytes:
    """Token numbers by planes of their bytes, the low bytes first, compressed; with their number before."""
    planes = codes.astype("<i4").view(np.uint8).reshape(-1, 4).T
    return len(codes).to_bytes(8, "little") + pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def _inflated(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw[8:], 4 * size), np.uint8).reshape(4, size)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def key_of(word: bytes) -> int:
    """A word's key as a signed number, as Spark's xxhash64 gives it."""
    k = xxhash.xxh64_intdigest(word, SEED)
    return k - (1 << 64) if k >> 63 else k


def blocks(docs: DataFrame, chars: int = 16 << 20) -> DataFrame:
    """The corpus as a table in the shared folder: (block, doc_ids, sizes, held, codes, words, n).

    A block is about ``chars`` characters of one task's rows: the tokens as numbers of the block's own word
    list, deflated, that list, and each word's count in the block's training texts. docs: doc_id, text and
    held, whether a document is held out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames):
        number = TaskContext.get().partitionId() << 32
        held: dict = {}

        def watched():
            for frame in frames:
                held.setdefault("next", []).extend(frame["held"].tolist())
                yield frame

        for doc_ids, texts in text_batches(watched(), chars):
            out = np.array(held["next"][: len(doc_ids)], bool)
            del held["next"][: len(doc_ids)]
            codes, sizes, names = _coded(texts)
            n = np.bincount(codes[np.repeat(~out, sizes)], minlength=len(names))
            raw = _deflated(codes)
            yield pd.DataFrame({"block": [number], "doc_ids": [doc_ids], "sizes": [sizes], "held": [out], "codes": [raw], "words": [names], "n": [n]})
            number += 1

    schema = f"block long, doc_ids array<{kind}>, sizes array<long>, held array<boolean>, codes binary, words array<binary>, n array<long>"
    return stored(docs.select("doc_id", F.col("text").cast("string").alias("text"), "held").mapInPandas(released(run), schema), "blocks")


def _keyed(texts: DataFrame) -> DataFrame:
    """What the counts of a block's tokens need: its word list as keys."""
    return texts.select("block", "sizes", "held", "codes", F.transform("words", lambda w: F.xxhash64(w)).alias("keys"), "n")


@dataclass
class Model:
    """Counts of a class bigram model. Classes: 0 the end of a text, 1 to K those of words, K + 1 words unseen
    in training. ``names`` are the most frequent words, the end first, and ``classes`` their classes, followed
    by the number of the last class, K + 1."""

    names: list[bytes]
    classes: np.ndarray
    tokens: int
    kinds: int
    between: np.ndarray  # how often a class follows another, all but the most frequent words in class K + 1
    follows: np.ndarray | None = None  # log10 P(class | class before)
    of_class: np.ndarray | None = None  # training tokens of each class

    @property
    def last(self) -> int:
        return int(self.classes[-1])


def _xlogx(x):
    return x * np.log(np.maximum(x, 1))


def _by_row(size: int, row: np.ndarray, col: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(row, kind="stable")
    cuts = np.searchsorted(row[order], np.arange(1, size))
    return list(zip(np.split(col[order], cuts), np.split(n[order], cuts)))


def exchange(size: int, a: np.ndarray, b: np.ndarray, n: np.ndarray, classes: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Classes of words by exchange: each word in turn goes to the class that gives the bigrams the highest
    likelihood, until no word moves or for ``rounds`` rounds.

    Word b follows word a n times; pairs that are not listed never occur. Of the ``size`` words the first and
    the last keep classes of their own (the end, and all words that are not clustered). Returns each word's
    class, those two 0 and classes + 1, and how often a class follows another. Words start in turn, by
    frequency; ties go to the lowest class.
    """
    own = np.zeros(size, np.int64)
    own[1:-1] = 1 + np.arange(size - 2) % max(1, classes)
    own[-1] = classes + 1
    k = classes + 2
    at = np.arange(k)
    after, before = _by_row(size, a, b, n), _by_row(size, b, a, n)
    selves = np.bincount(a[a == b], n[a == b], size)
    between = np.bincount(own[a] * k + own[b], n, k * k).reshape(k, k)
    for _ in range(rounds):
        moved = 0
        for w in range(1, size - 1):
            old, self_ = own[w], selves[w]
            to = np.bincount(own[after[w][0]], after[w][1], k)
            from_ = np.bincount(own[before[w][0]], before[w][1], k)
            to[old] -= self_
            from_[old] -= self_
            between[old] -= to
            between[:, old] -= from_
            between[old, old] -= self_
            # what joining a class adds: its row and column change, the corner by both
            rows, cols = between.sum(1) + from_, between.sum(0) + to
            n_to, n_from = to.sum() + self_, from_.sum() + self_
            now, corner = _xlogx(between), between[at, at]
            gain = _xlogx(between + to[None, :]).sum(1) + _xlogx(between + from_[:, None]).sum(0) - now.sum(1) - now.sum(0)
            gain -= _xlogx(corner + to[at]) + _xlogx(corner + from_[at]) - _xlogx(corner)
            gain += _xlogx(corner + to[at] + from_[at] + self_)
            gain -= _xlogx(rows + n_to) - _xlogx(rows) + _xlogx(cols + n_from) - _xlogx(cols)
            new = 1 + int(np.argmax(gain[1 : classes + 1]))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            between[new] += to
            between[:, new] += from_
            between[new, new] += self_
            moved += new != old
            own[w] = new
        if not moved:
            break
    return own, between


def joining(between: np.ndarray, words: int, word: np.ndarray, before: np.ndarray, after: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class from 1 to K that each of ``words`` words would join by the gain of ``exchange``, every word
    judged by itself against the same table ``between`` of the clustered words' classes.

    Rows: the word's number (ascending), the classes before and after it, and how often. Gains that differ by
    less than a millionth are ties, which go to the lowest class.
    """
    k = len(between)
    best = k - 1
    gain = np.zeros((words, best - 1))
    table = between[1:best]
    for other, counts in ((after, table), (before, between[:, 1:best].T)):
        code, at = np.unique(word * k + other, return_inverse=True)
        m = np.bincount(at, n)
        for lo in range(0, len(code), 20_000):
            part = code[lo : lo + 20_000]
            x = counts[:, part % k].T
            add = _xlogx(x + m[lo : lo + 20_000, None]) - _xlogx(x)
            starts = np.flatnonzero(np.append(True, np.diff(part // k) != 0))
            gain[(part // k)[starts]] += np.add.reduceat(add, starts)
    to = np.bincount(word * k + after, n, words * k).reshape(words, k)[:, 1:best]
    from_ = np.bincount(word * k + before, n, words * k).reshape(words, k)[:, 1:best]
    corner = between[np.arange(1, best), np.arange(1, best)]
    gain += _xlogx(corner + to + from_) - _xlogx(corner + to) - _xlogx(corner + from_) + _xlogx(corner)
    total = np.bincount(word, n, words)[:, None]
    for sums, more in ((between.sum(1)[1:best], from_), (between.sum(0)[1:best], to)):
        gain -= _xlogx(sums + more + total) - _xlogx(sums + more)
    return 1 + np.argmax(np.round(gain, 6), axis=1)


def _numbers(row, heads: np.ndarray, values: np.ndarray, rest: int) -> np.ndarray:
    """For the words of a block the value of their key in ``heads`` (sorted), else ``rest``."""
    keys = np.asarray(row.keys)
    at = np.minimum(np.searchsorted(heads, keys), len(heads) - 1)
    return np.where(heads[at] == keys, values[at], rest)


def _tokens(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's tokens as numbers of its word list, the tokens' first places by text, the texts' sizes, and
    whether a token is in a training text."""
    codes, sizes = _inflated(row.codes), np.asarray(row.sizes)
    starts = np.append(0, np.cumsum(sizes)[:-1])
    return codes, starts, sizes, np.repeat(~np.asarray(row.held, bool), sizes)


def _before(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The value of the token before each token; before a text's first stands the end, 0."""
    out = np.append(0, values[:-1])
    out[starts] = 0
    return out


def bigrams(texts: DataFrame, names: list[bytes]) -> DataFrame:
    """(a, b, n) over all training texts: numbers of neighbouring tokens, a text's first after the end token.
    Words that are not in ``names`` share the number after the last. Counted in each task first."""
    keys = np.array([key_of(w) for w in names])
    order = np.argsort(keys)
    shared = texts.sparkSession.sparkContext.broadcast((keys[order], order))
    rest = len(names)

    def run(frames: Iterator[pd.DataFrame]):
        heads, numbers = shared.value
        sums: dict[str, np.ndarray] = {"at": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}
        for frame in frames:
            for row in frame.itertuples(index=False):
                codes, starts, _, train = _tokens(row)
                ids = _numbers(row, heads, numbers, rest)[codes]
                at, n = np.unique((_before(ids, starts) * (rest + 1) + ids)[train], return_counts=True)
                all_, back = np.unique(np.append(sums["at"], at), return_inverse=True)
                sums = {"at": all_, "n": np.bincount(back, np.append(sums["n"], n), len(all_)).astype(np.int64)}
        yield pd.DataFrame({"a": sums["at"] // (rest + 1), "b": sums["at"] % (rest + 1), "n": sums["n"]})

    return _keyed(texts).mapInPandas(released(run), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def fit(texts: DataFrame, head: float = 1.0, classes: float = 2.0) -> Model:
    """Exchange clustering of the most frequent training words: ``head`` times the root of the number V of
    different ones, into ``classes`` times the fourth root of V classes; both grow with the corpus.

    Only these words and the bigrams among them reach the driver, at most head² * V pairs and in practice
    those that occur; every other word gets its class in ``known``.
    """
    lists = texts.select(F.explode(F.arrays_zip("words", "n")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.n").alias("n"))
    counts = stored(lists.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, kinds = int(total["n"] or 0), int(total["v"])
    top = counts.where(F.length("word") > 0).orderBy(F.desc("c"), "word").limit(math.ceil(head * math.sqrt(kinds))).collect()
    names = [END, *[bytes(r["word"]) for r in top]]
    pairs = bigrams(texts, names).toArrow()
    k = min(math.ceil(classes * kinds**0.25), len(top))
    own, between = exchange(len(names) + 1, *(pairs[c].to_numpy() for c in ("a", "b", "n")), k)
    return Model(names, own, tokens, kinds, between)


def known(texts: DataFrame, model: Model) -> DataFrame:
    """(block, number, key, c, class) of every word of every block's list: its count in the training texts, and
    its class.

    A word that was not clustered takes the class with the best exchange gain by its own counts of (class
    before, class after), summed over the corpus; words are told apart by 64-bit keys. Each block sends one
    row for a word, with the word's contexts in it, so the hottest word has as many rows as there are blocks.
    """
    spark, k, last = texts.sparkSession, len(model.between), model.last
    keys = np.array([key_of(w) for w in model.names])
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], model.classes[:-1][order], model.between))
    code = np.dtype("<u2" if k * k < 1 << 16 else "<u4")

    def contexts(frames):
        heads, own, _ = shared.value
        for frame in frames:
            for row in frame.itertuples(index=False):
                codes, starts, _, train = _tokens(row)
                class_ = _numbers(row, heads, own, last)[codes]
                before = _before(class_, starts)
                rare = np.flatnonzero(train & (class_ == last))  # never the last token: that is the end
                rare = rare[np.argsort(codes[rare], kind="stable")]
                raw = (before[rare] * k + class_[rare + 1]).astype(code).tobytes()
                n = np.asarray(row.n)
                ends = np.cumsum(np.bincount(codes[rare], minlength=len(n))) * code.itemsize
                begins = np.append(0, ends[:-1])
                for lo in range(0, len(n), 50_000):
                    part = slice(lo, lo + 50_000)
                    cut = [raw[i:j] for i, j in zip(begins[part].tolist(), ends[part].tolist())]
                    yield pd.DataFrame({"block": row.block, "number": np.arange(lo, lo + len(cut)), "key": np.asarray(row.keys)[part], "n": n[part], "around": cut})

    def run(frames):
        heads, own, between = shared.value
        for frame in whole_groups(frames, ["key"]):
            starts = group_starts(frame, ["key"])
            sizes = np.diff(starts)
            keys, n = frame["key"].to_numpy()[starts[:-1]], np.add.reduceat(frame["n"].to_numpy(), starts[:-1])
            at = np.minimum(np.searchsorted(heads, keys), len(heads) - 1)
            class_ = np.where((heads[at] == keys) & (n > 0), own[at], last)
            rare = (heads[at] != keys) & (n > 0)
            if rare.any():
                around = np.frombuffer(b"".join(frame["around"]), code).astype(np.int64)
                many = np.add.reduceat(frame["around"].str.len().to_numpy(), starts[:-1])[rare] // code.itemsize
                both, m = np.unique(np.repeat(np.arange(len(many)), many) * (k * k) + around, return_counts=True)
                class_[rare] = joining(between, len(many), both // (k * k), both % (k * k) // k, both % k, m)
            yield pd.DataFrame(
                {
                    "block": frame["block"].to_numpy(), "number": frame["number"].to_numpy(), "key": frame["key"].to_numpy(),
                    "c": np.repeat(n, sizes), "class": np.repeat(class_, sizes),
                }
            )

    rows = _keyed(texts).mapInPandas(released(contexts), "block long, number int, key long, n long, around binary")
    rows = rows.repartition("key").sortWithinPartitions("key")
    return rows.mapInPandas(released(run), "block long, number int, key long, c long, class int")


def classed(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The blocks with the count (``c``) and class of each word of their lists, as ``known`` gives them. A table
    in the shared folder."""
    at = F.shiftleft(F.col("number").cast("long"), 32) + F.col("class")  # one number moves for both
    by_block = vocabulary.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "c"))).alias("w"))
    class_ = F.transform("w.at", lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    by_block = by_block.select("block", F.col("w.c").alias("c"), class_.alias("class"))
    return stored(texts.drop("words", "n").join(by_block, "block"), "classed")


def transitions(rows: DataFrame, last: int) -> DataFrame:
    """(a, b, n) over all training texts: how often class b follows class a. Words that occur once count in
    their class and, ``last`` + 1 classes further on, as what an unseen word would have been."""
    size = 2 * (last + 1)

    def run(frames):
        total = np.zeros(size * size, np.int64)
        for frame in frames:
            for row in frame.itertuples(index=False):
                codes, starts, _, train = _tokens(row)
                class_, c = np.asarray(row[-1]), np.asarray(row.c)
                marked = np.where((c == 1) & (class_ > 0) & (class_ < last), class_ + last + 1, class_)[codes]
                total += np.bincount((_before(marked, starts) * size + marked)[train], minlength=size * size)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"a": at // size, "b": at % size, "n": total[at]})

    return rows.select("sizes", "held", "codes", "c", "class").mapInPandas(released(run), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def completed(model: Model, rows: DataFrame) -> Model:
    """The model with the transitions of all classes, over every token of the training texts.

    An unseen word follows a class as often as words that occur just once do, and is followed by what follows
    those. The other classes share the rest, by counts of which each class that has words has 0.5 more.
    """
    last = model.last
    size = last + 1
    n = np.zeros((2 * size, 2 * size))
    for r in transitions(rows, last).collect():
        n[r["a"], r["b"]] = r["n"]
    once_before = n[size:].sum(0)
    columns = n[:size] + n[size:]
    columns[last] = once_before  # in place of the unseen words, which training texts do not have
    unseen = (columns[:, size:].sum(1) + 0.5) / (columns.sum(1) + 1)
    counts = columns[:, :size] + columns[:, size:]
    of_class = (n[:, :size] + n[:, size:]).sum(0)
    used = of_class[:last] > 0
    if not used.any():  # no training texts: all is unseen
        unseen[:] = 1
    share = np.where(used, counts[:, :last] + 0.5, 0.0)
    share /= np.maximum(share.sum(1, keepdims=True), 0.5)
    p = np.column_stack([(1 - unseen)[:, None] * share, unseen])
    with np.errstate(divide="ignore"):
        return replace(model, follows=np.log10(p), of_class=of_class)


def score(rows: DataFrame, model: Model, mix: float = 0.9) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text of the blocks.

    A token's probability is mix * P(class | class before) * P(token | class) + (1 - mix) * P(token), the
    latter (c + 1) / (N + V + 1); a word's share of its class is c over the class's tokens, and all words
    unseen in training are one kind. base_score is by the latter alone. Logarithms to base 10.
    """
    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        m = shared.value
        for frame in frames:
            for row in frame.itertuples(index=False):
                codes, starts, sizes, train = _tokens(row)
                c, own = np.asarray(row.c, np.float64), np.asarray(row[-1])
                base = np.log10((c + 1) / (m.tokens + (m.kinds + 1)))
                emit = np.log10(np.where(c > 0, c / np.maximum(m.of_class[own], 1), 1.0))
                class_ = own[codes]
                p = mix * 10.0 ** (m.follows[_before(class_, starts), class_] + emit[codes]) + (1 - mix) * 10.0 ** base[codes]
                out = pd.DataFrame(
                    {
                        "doc_id": list(row.doc_ids), "held_out": np.asarray(row.held, bool), "n_tokens": sizes,
                        "n_known": np.add.reduceat((c > 0)[codes].astype(np.int64), starts), "train_tokens": m.tokens,
                        "base_score": np.add.reduceat(base[codes], starts), "score": np.add.reduceat(np.log10(p), starts),
                    }
                )
                out["doc_id"] = out["doc_id"].astype(object)
                yield out

    return rows.select("doc_ids", "sizes", "held", "codes", "c", "class").mapInPandas(
        released(run), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def held_out(doc_id: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the fold that is scored but not learned from; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def perplexities(docs: DataFrame, head: float = 1.0, classes: float = 2.0) -> DataFrame:
    """Learn from the documents that are not held out, and score all; see ``fit``, ``known`` and ``score``.

    docs: doc_id and text; other columns are left out. A null or empty text is the end token alone. Repeated
    rows and null ids are scored like any others. An empty table gives no rows; if all are held out, N and V
    are 0 and every word is unseen. Word counts, classes and transitions cover all training texts, whatever
    their number; a word that every text has is one row from each block, and copies are counted as they are.
    """
    texts = blocks(docs.select("doc_id", "text", held_out().alias("held")))
    model = fit(texts, head, classes)
    rows = classed(texts, known(texts, model))
    return score(rows, completed(model, rows))
