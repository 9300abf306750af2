"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylake.llm import tokens

NONE = np.int32(1 << 30)  # rank of a pair that has no merge
LONG = 64  # bytes from which a pre-token is merged by itself


class Merges:
    """The merges of a byte-level vocabulary file, and how many symbols they leave.

    A sequence's lowest-ranked pair merges first. A token is made by one merge only, and its parts by
    earlier ones (checked), so no merge can bring back a pair of the same or a lower rank: all places of
    a sequence's lowest pair merge at once, and the sequences of a batch do so side by side.
    """

    def __init__(self, path: str):
        _known_rules(path)
        ids, merges, self.added = tokens.vocabulary(path)
        a, b, self.into = (np.array([ids[t] for t in ts], np.int64) for ts in ([m[0] for m in merges], [m[1] for m in merges], [m[0] + m[1] for m in merges]))
        self.size = max(ids.values()) + 1
        made = np.full(self.size, -1, np.int64)
        made[self.into] = np.arange(len(merges))
        if len(np.unique(self.into)) < len(merges) or (np.maximum(made[a], made[b]) >= np.arange(len(merges))).any():
            raise ValueError(f"{path}: a token must be made by one merge, after its parts")
        keys = a * self.size + b
        order = np.argsort(keys)
        self.rank_of, self.keys, self.into = order.astype(np.int32), keys[order], self.into.astype(np.int32)
        self.first = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        self.of_bytes = self.ranks(np.repeat(self.first, 256), np.tile(self.first, 256))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of[at], NONE)

    def left_over(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence of bytes; the sequences lie one after the other, none is empty."""
        out = lengths.copy()
        long = lengths >= LONG
        if long.any():
            ends = np.cumsum(lengths)
            for k in np.flatnonzero(long):
                out[k] = self._alone(data[ends[k] - lengths[k] : ends[k]])
            data, lengths = data[np.repeat(~long, lengths)], lengths[~long]
        out[~long] = self._together(data, lengths)
        return out

    def _together(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out, which = lengths.copy(), np.arange(len(lengths))
        symbols, lengths = self.first[data], lengths.copy()
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(lengths) - 1] = True
        rank = np.full(len(symbols), NONE)
        at = np.flatnonzero(~last)
        rank[at] = self.of_bytes[data[at].astype(np.int32) * 256 + data[at + 1]]
        while len(lengths):
            lowest = np.minimum.reduceat(rank, np.cumsum(lengths) - lengths)
            live = lowest < NONE
            if not live.all():
                out[which[~live]] = lengths[~live]
                kept = np.repeat(live, lengths)
                symbols, last, rank = symbols[kept], last[kept], rank[kept]
                which, lengths, lowest = which[live], lengths[live], lowest[live]
                if not len(lengths):
                    break
            at = _apart(np.flatnonzero(rank == np.repeat(lowest, lengths)), lambda x: x + 1)
            symbols[at] = self.into[rank[at]]
            last[at] = last[at + 1]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            lengths = np.add.reduceat(kept, np.cumsum(lengths) - lengths, dtype=np.int64)
            symbols, last, rank = symbols[kept], last[kept], rank[kept]
            at = at - np.arange(len(at))
            rank[at[last[at]]] = NONE
            at = np.concatenate([at, at[at > 0] - 1])
            at = at[~last[at]]
            rank[at] = self.ranks(symbols[at], symbols[at + 1])
        return out

    def _alone(self, data: np.ndarray) -> int:
        """The same for one long sequence, whose places wait by rank, so that a round costs what it merges."""
        n = len(data)
        symbols, here = self.first[data], np.ones(n, bool)
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def offer(at: np.ndarray) -> None:
            rank = self.ranks(symbols[at], symbols[after[at]])
            at, rank = at[rank < NONE], rank[rank < NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for part, r in zip(np.split(at, cuts), rank[np.append(0, cuts)].tolist() if len(rank) else []):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(part)

        offer(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[here[at]]
            at = at[after[at] < n]
            at = at[self.ranks(symbols[at], symbols[after[at]]) == r]
            at = _apart(at, after.__getitem__)
            gone = after[at]
            symbols[at], here[gone] = self.into[r], False
            after[at] = after[gone]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            earlier = before[at]
            offer(np.unique(np.concatenate([inner, earlier[earlier >= 0]])))
        return int(here.sum())


def _apart(at: np.ndarray, after: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Places of one pair in order, without those that overlap a place taken before: of a chain of places,
    each the next symbol of the one before, the first, the third and so on."""
    chained = at[1:] == after(at[:-1])
    if not chained.any():
        return at
    k = np.arange(len(at))
    head = np.maximum.accumulate(np.where(np.append(True, ~chained), k, 0))
    return at[(k - head) % 2 == 0]


def _known_rules(path: str) -> None:
    """Raise if the file asks for anything but plain byte-level pairs, for which the rules here hold."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    cut, model = data.get("pre_tokenizer") or {}, data["model"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    odd = ["dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"]
    added = any(t.get(k) for t in data["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain or data.get("normalizer") or model.get("type") != "BPE" or any(model.get(k) for k in odd) or added:
        raise ValueError(f"{path}: not a plain byte-level vocabulary")


class Counter:
    """Token counts of whole texts, in blocks of about ``block`` characters whatever a text's length."""

    def __init__(self, path: str, block: int = 2 << 20):
        import regex
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        self.plain_pieces = regex.compile(tokens.PATTERN).findall
        self.library = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.new = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])
        self.added = regex.compile("|".join(map(regex.escape, sorted(self.merges.added, key=len, reverse=True)))) if self.merges.added else None
        self.block = block

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens. Versions of Unicode differ in code points that only newer ones assign; a text with one
        that Python's tables lack is cut by the library itself."""
        if not text.isascii() and self.new[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return [text[a:b] for _, (a, b) in self.library(text)]
        return self.plain_pieces(text)

    def _blocks(self, text: str) -> Iterator[str]:
        """A plain text cut before spaces that follow a non-space: no pre-token crosses such a place."""
        start = 0
        while len(text) - start > self.block:
            cut = tokens.BEFORE_SPACE.search(text, start + self.block)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:] if start else text

    def count(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        held: list[str] = []
        owner: list[int] = []
        sizes: list[int] = []
        waiting = 0
        for k, text in enumerate(texts):
            plain = [text]
            if self.added and self.added.search(text):
                plain = self.added.split(text)
                total[k] += len(plain) - 1
            for part in plain:
                for block in self._blocks(part):
                    found = self.pieces(block)
                    held += found
                    owner.append(k)
                    sizes.append(len(found))
                    waiting += len(block)
                    if waiting >= self.block:
                        self._add(total, held, owner, sizes)
                        held, owner, sizes, waiting = [], [], [], 0
        self._add(total, held, owner, sizes)
        return total

    def _add(self, total: np.ndarray, held: list[str], owner: list[int], sizes: list[int]) -> None:
        if not held:
            return
        coded = pa.array(held, pa.large_string()).dictionary_encode()
        _, places, values = coded.dictionary.buffers()
        places = np.frombuffer(places, np.int64, len(coded.dictionary) + 1)
        counts = self.merges.left_over(np.frombuffer(values, np.uint8, places[-1]), np.diff(places))
        sums = np.append(0, np.cumsum(counts[coded.indices.to_numpy()]))
        ends = np.cumsum(sizes)
        np.add.at(total, owner, sums[ends] - sums[ends - sizes])


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """One for each worker."""
    return Counter(path)


def count_tokens(docs: DataFrame, limit: int = 512, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more tokens than ``limit``) of each whole text.

    docs: doc_id and text; other columns are left out. A null or empty text has no bytes and no tokens. The
    string of an added token is one token. Repeated rows and null doc_ids are counted like any others; an
    empty table gives no rows. A file with other rules than plain byte-level pairs is an error.

    One pass over the scan without a shuffle: a task counts what it has read, so no key or source can fill
    one. The distinct pre-tokens of about two million characters are merged together; longer texts are
    counted in blocks. A pre-token of n bytes, even one without a place to cut, costs about n log n.
    """
    path = vocabulary or tokens.default_vocabulary()
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]

    def run(frames):
        count = counter(path).count
        for doc_ids, texts in tokens.text_batches(frames, 2 << 20):
            found = count(texts)
            rows = {"doc_id": pd.Series(doc_ids, dtype=object), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": found, "over_limit": found > limit}
            yield pd.DataFrame(rows, columns=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select("doc_id", F.col("text").cast("string")).mapInPandas(run, schema)
