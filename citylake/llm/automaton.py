"""Byte-pair encoding by a token automaton, built merge by merge."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylake.llm import tokens

NEVER = 1 << 60
MEMORY = 2_000_000  # entries of a table that is filled as it is used; then it begins anew


class Automaton:
    """Deterministic automaton over tokens that accepts just the sequences which the merges make.

    It begins as one state with an arc for every byte. Each merge (u, v) → w, in order, is one gadget: the
    state that the u-arcs lead to loses its v-arc, and every state that has a u-arc and could go on with v
    gets a w-arc to where v leads. All arcs of a token lead to one state, so a state is known by the token
    that enters it. When w is made its state is v's state of that moment, and the two part from then on:
    it is kept as a link to v and the moment, not copied, so the whole table has one entry for each merge.

    A byte string has just one accepted path. So the last arc of each prefix is decided by the states
    before it: of the tokens that end there, the one that its state has an arc for.
    """

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = ids
        size = max(ids.values()) + 1
        self.labels: list[bytes] = [b""] * size
        for label, i in ids.items():
            self.labels[i] = label
        self.copied = [-1] * size  # the token whose state this token's state was copied from
        self.made = [NEVER] * size  # and when; bytes have been there from the start
        self.first = [-1] * size  # the arc that this token's arcs replaced
        self.cut: dict[int, int] = {}  # state and lost arc → when
        for moment, (u, v) in enumerate(merges):
            self._gadget(moment, ids[u], ids[v], ids[u + v])
        self.arcs: dict[int, bool] = {}
        self.places: dict[bytes, int] = {b"": 0}  # beginnings of tokens
        for label in ids:
            for n in range(1, len(label) + 1):
                self.places.setdefault(label[:n], len(self.places))
        self.read = list(self.places)
        self.options: list[list[tuple[int, int]] | None] = [None] * len(self.read)
        self.moves: dict[int, int] = {}

    def _gadget(self, moment: int, u: int, v: int, w: int) -> None:
        self.cut.setdefault(u << 32 | v, moment)
        if self.made[w] == NEVER:
            self.copied[w], self.first[w], self.made[w] = v, u, moment

    def _lost(self, state: int, arc: int, by: int) -> bool:
        """Whether the state has lost the arc by then: itself, or as what it was copied from, before the copy."""
        until = NEVER
        while state >= 0:
            at = self.cut.get(state << 32 | arc)
            if at is not None and at < until and at <= by:
                return True
            until = min(until, self.made[state])
            state = self.copied[state]
        return False

    def has_arc(self, state: int, arc: int) -> bool:
        """Whether the state that token ``state`` enters has an arc for the token: the byte arc was there
        from the start, and each merge on the way to the token found the arc that it replaces."""
        key = state << 32 | arc
        known = self.arcs.get(key)
        if known is None:
            by, a, known = NEVER, arc, True
            while a >= 0 and known:
                known = not self._lost(state, a, by)
                by, a = self.made[a], self.first[a]
            if len(self.arcs) >= MEMORY:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def _move(self, place: int, byte: int) -> int:
        """Where a byte leads: the longest end of what has been read that some token begins with."""
        tail = self.read[place] + bytes((byte,))
        while tail not in self.places:
            tail = tail[1:]
        to = self.places[tail]
        if self.options[to] is None:  # tokens that end here, longest first
            ends = ((self.ids.get(tail[k:]), len(tail) - k) for k in range(len(tail)))
            self.options[to] = [(i, n) for i, n in ends if i is not None]
        if len(self.moves) >= MEMORY:
            self.moves.clear()
        self.moves[place << 8 | byte] = to
        return to

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-split piece: a table step for each byte, then back along the chosen arcs."""
        last, sizes, place = [-1] * (len(piece) + 1), [0] * (len(piece) + 1), 0
        moves, arcs, options = self.moves, self.arcs, self.options
        for end, byte in enumerate(piece, 1):
            to = moves.get(place << 8 | byte)
            place = self._move(place, byte) if to is None else to
            for token, size in options[place]:
                before = last[end - size]
                if before < 0:  # the start state has every arc
                    if end == size:
                        break
                    continue
                known = arcs.get(before << 32 | token)
                if self.has_arc(before, token) if known is None else known:
                    break
            last[end], sizes[end] = token, size
        out, n = [], len(piece)
        while n:
            out.append(last[n])
            n -= sizes[n]
        return out[::-1]


class Codec:
    """Whole texts to ids and back, with the automaton of a vocabulary file."""

    def __init__(self, path: str):
        ids, merges, added = tokens.vocabulary(path)
        self.automaton = Automaton(ids, merges)
        self.pieces = regex.compile(tokens.PATTERN).findall
        self.encoder = tokens.Encoder(self._plain, ids, added)
        self.labels = self.automaton.labels + [b""] * (max(added.values(), default=0) + 1 - len(self.automaton.labels))
        for token, i in added.items():
            self.labels[i] = token.encode()

    def _plain(self, text: str) -> list[int]:
        known: dict[str, list[int]] = {}
        out: list[int] = []
        for p in self.pieces(text):
            ids = known.get(p)
            if ids is None:
                ids = known[p] = self.automaton.encode(p.encode())
            out += ids
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text that the arcs' labels spell; broken characters become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One for each worker."""
    return Codec(path)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian 32-bit) of each whole text; see ``round_trip``."""
    return round_trip(docs, vocabulary).drop("decoded")


def decode(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and decoded text of rows with doc_id and ids; null ids decode as empty."""
    path = vocabulary or tokens.default_vocabulary()

    def run(frames):
        spell = codec(path).decode
        for frame in frames:
            texts = [spell(np.frombuffer(b, "<u4")) if isinstance(b, bytes) else "" for b in frame["ids"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "decoded": texts})

    return rows.select("doc_id", "ids").mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode whole texts by the automaton, then decode the ids: doc_id, n_tokens, ids and decoded.

    docs: doc_id and text; other columns are left out. A null or empty text has no ids and decodes as empty.
    The strings of added tokens become their ids. Repeated rows and null doc_ids are kept as they are; an
    empty table gives no rows. One pass over the scan without a shuffle, in batches of bounded size.
    """
    path = vocabulary or tokens.default_vocabulary()
    names = ["doc_id", "n_tokens", "ids", "decoded"]

    def run(frames):
        own = codec(path)
        for doc_ids, texts in tokens.text_batches(frames, 6 << 20):  # larger batches hold fewer distinct parts
            ids, offsets = own.encoder.batch(texts)
            for first in range(0, len(doc_ids), 256):
                rows = []
                for k in range(first, min(first + 256, len(doc_ids))):
                    part = ids[offsets[k] : offsets[k + 1]]
                    rows.append((doc_ids[k], len(part), part.tobytes(), own.decode(part)))
                yield pd.DataFrame(rows, columns=names, dtype=object)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string"
    return docs.select("doc_id", F.col("text").cast("string")).mapInPandas(run, schema)
