"""Ids of a byte-level BPE vocabulary file, for whole texts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

# The pre-tokenizer's pattern of these vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

AFTER_SPACE = re.compile(r"\s ")
BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1
    bytes stand for themselves, the others follow from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]]:
    """Token bytes → id, merges in order, and added tokens → id."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    stands = byte_alphabet()
    raw = lambda token: bytes(stands[c] for c in token)
    added = {t["content"]: t["id"] for t in data["added_tokens"]}
    ids = {raw(t): i for t, i in data["model"]["vocab"].items() if t not in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    return ids, [(raw(a), raw(b)) for a, b in pairs], added


class Encoder:
    """Texts → ids, a batch at a time.

    A text is cut before every space that follows a non-space: no piece of the pre-tokenizer crosses such
    a place, nor does its look-ahead, so each cut part has ids of its own. The distinct parts of a batch
    are encoded once, in one call, and told apart again by the tokens that begin with a space. Texts with
    wider blanks or added tokens are encoded one by one. Nothing is kept from batch to batch.
    """

    def __init__(self, plain: Callable[[str], list[int]], ids: dict[bytes, int], added: dict[str, int]):
        self.plain, self.added = plain, added
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.spaced = np.zeros(max([*ids.values(), *added.values()], default=0) + 1, bool)
        self.spaced[[i for t, i in ids.items() if t[:1] == b" "]] = True

    def one(self, text: str) -> list[int]:
        """Ids of any text."""
        if self.split is None or not self.split.search(text):
            return self.plain(text) if text else []
        return [i for p in self.split.split(text) if p for i in ([self.added[p]] if p in self.added else self.plain(p))]

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct parts, each led by a space, and where each begins and ends."""
        odd = [k for k, p in enumerate(parts) if not p or p[-1].isspace()]
        apart = [np.array(self.plain(" " + parts[k]), "<u4") for k in odd]
        odd_set = set(odd)
        joined = [p for k, p in enumerate(parts) if k not in odd_set]
        ids = np.array(self.plain(" " + " ".join(joined)) if joined else [], "<u4")
        starts, ends = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        usual = np.ones(len(parts), bool)
        usual[odd] = False
        at = np.flatnonzero(self.spaced[ids])
        starts[usual], ends[usual] = at, np.append(at[1:], len(ids)) if len(at) else at
        lengths = np.array([len(x) for x in apart], np.int64)
        ends[odd] = len(ids) + np.cumsum(lengths)
        starts[odd] = ends[odd] - lengths
        return np.concatenate([ids, *apart]), starts, ends

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of each text's ids."""
        alone: dict[int, np.ndarray] = {}
        heads: list[list[int]] = []
        tails: list[str] = []
        for k, text in enumerate(texts):
            if AFTER_SPACE.search(text) or (self.split is not None and self.split.search(text)):
                alone[k] = np.array(self.one(text), "<u4")
                head, gap, tail = "", "", ""
            else:
                head, gap, tail = text.partition(" ")
            heads.append(self.plain(head) if head else [])
            tails.append(tail if gap else None)
        cut = pc.split_pattern(pa.array(tails, pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        ids, starts, ends = self._parts(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy()
        lengths = (ends - starts)[which]
        before = np.append(0, np.cumsum(lengths))
        where = np.repeat(starts[which] - before[:-1], lengths)
        where += np.arange(len(where))
        body = ids[where]
        parts = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(cut), 0).to_numpy()))
        from_, to = before[parts[:-1]], before[parts[1:]]
        sizes = to - from_ + np.array([len(h) for h in heads], np.int64)
        for k, own in alone.items():
            sizes[k] = len(own)
        offsets = np.append(0, np.cumsum(sizes))
        flat = np.empty(offsets[-1], "<u4")
        for k, (a, head) in enumerate(zip(offsets.tolist(), heads)):
            if k in alone:
                flat[a : a + len(alone[k])] = alone[k]
            else:
                flat[a : a + len(head)] = head
                flat[a + len(head) : offsets[k + 1]] = body[from_[k] : to[k]]
        return flat, offsets


def text_batches(frames: Iterable[pd.DataFrame], chars: int = 3 << 20) -> Iterator[tuple[list, list[str]]]:
    """(doc ids, texts) of the rows, null ids as None and null texts as empty, in batches of about
    ``chars`` characters; a longer text is a batch of its own."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for frame in frames:
        for doc_id, text in zip(frame["doc_id"].array, frame["text"].array):
            ids.append(None if pd.isna(doc_id) else doc_id)
            texts.append(text if isinstance(text, str) else "")
            size += len(texts[-1])
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file; one for each worker. The merges of these files are in id order,
    so the compiled rank encoder gives the same ids as the file's own library (see the tests)."""
    import tiktoken

    ids, _, added = vocabulary(path)
    ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})
    return Encoder(ranks.encode_ordinary, ids, added)
